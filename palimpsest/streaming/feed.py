"""Change feeds and push synchronisation as streams.

A notification is (proot, txn, ts); receivers ignore those whose transaction number is
not above the last one they saw for the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FEED = "proot long, txn long, seq long"


def fresh(notifications: DataFrame) -> DataFrame:
    """Batch form: rows whose txn is above all earlier ones of the root (earlier by seq)."""
    w = Window.partitionBy("proot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return notifications.withColumn("_last", F.max("txn").over(w)).where("_last is null or txn > _last").drop("_last")


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    keep = []
    for txn in rows["txn"].tolist():
        keep.append(last is None or txn > last)
        last = txn if keep[-1] else last
    state.update((last,))
    yield rows[keep][["proot", "txn", "seq"]]


def fresh_stream(notifications: DataFrame) -> DataFrame:
    """Streaming form: the last number of each root is the state."""
    return notifications.groupBy("proot").applyInPandasWithState(_keep, FEED, "last long", "append", GroupStateTimeout.NoTimeout)


def push(server: str | None, client: list[str], base: str | None, ancestors: set[str]) -> tuple[str, str | None]:
    """What a server does with a client's pushed path: ("ignore" | "fast-forward" | "rebase", new current)."""
    if not client:
        return "ignore", server
    if server is None or server == base or server in ancestors:
        return "fast-forward", client[-1]
    return "rebase", None
