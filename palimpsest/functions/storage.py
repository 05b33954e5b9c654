"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that a join may broadcast: packed integers take a few bits in files and a hundred bytes in the driver's hash table.
BROADCAST = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and one machine does everything (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.setdefault("PALIMPSEST_LOCAL_SHARED", "") or tempfile.mkdtemp(prefix="palimpsest-")
        os.environ["PALIMPSEST_LOCAL_SHARED"] = at
        at = f"file://{at}"
    return at.rstrip("/")


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """No join planned meanwhile broadcasts a table of more than BROADCAST bytes, unless a hint says so."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    most = min(BROADCAST, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    try:
        for k in keys:
            spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read back; what the driver broadcasts for it does not follow the input."""
    path = f"{shared_dir(df.sparkSession)}/palimpsest/{what}-{uuid.uuid4().hex}"
    with small_broadcasts(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
