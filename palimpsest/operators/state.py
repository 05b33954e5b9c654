"""State of a document at a revision, and what is derived from two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored
from palimpsest.operators.recurse import chains, longest


def state_at(revisions: DataFrame, starts: DataFrame, base: str | None = None) -> DataFrame:
    """Each item as its nearest ancestor wrote it; starts: (proot, branch, backing, start) and, with base, that column.

    A revision writes whole items, so the nearest writer is one argmin by depth. With a
    base the walk ends below it; a base that is no ancestor leaves the full state.
    """
    paths = chains(revisions, starts)
    if base:
        stop = paths.where(F.col("revid") == F.col(base)).select("proot", "branch", F.col("depth").alias("stop"))
        paths = paths.join(stop, ["proot", "branch"], "left").where("stop is null or depth < stop")
    writes = revisions.select("backing", "revid", "item", "value", "k", F.col("branch").alias("kind"))
    near = paths.join(writes, ["backing", "revid"]).groupBy("proot", "branch", "item")
    return near.agg(F.min_by(F.struct("value", "k", "kind", "revid"), "depth").alias("w")).select("proot", "branch", "item", "w.value", "w.k", "w.kind", "w.revid")


def attributes(state: DataFrame) -> DataFrame:
    """Long form: (…, item, attr, type, value) with canonical text values; types are those of the item format (1 integer, 3 text, 17 set of integers)."""
    tags = "concat_ws(',', transform(array_sort(array_distinct(array(k % 5, k % 3))), t -> cast(t as string)))"
    rows = f"inline(array(struct('k' as attr, 1 as type, cast(k as string) as val), struct('kind' as attr, 3 as type, kind as val), struct('tags' as attr, 17 as type, {tags} as val)))"
    return state.selectExpr("proot", "branch", "item", rows)


def overlay(under: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """under with the rows of over added or in place of its own (same columns)."""
    return over.unionByName(under.join(over.select(*keys), keys, "left_anti"))


def same_graph(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys (without the last, the item) and whether both sides hold equal items; missing on both sides is equal."""
    rest = [c for c in a.columns if c not in keys]
    both = a.select(*keys, F.struct(*rest).alias("x")).join(b.select(*keys, F.struct(*rest).alias("y")), keys, "full")
    return both.groupBy(*keys[:-1]).agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


def states(revisions: DataFrame, value: str) -> DataFrame:
    """(backing, revid, state): the full state of every revision, a map from item to the value of its nearest writer.

    Doubling: what the nearest 1, 2, 4, … revisions wrote, over what as many before them wrote; a round is one join.
    """
    now = revisions.select("backing", "revid", F.col("parent").alias("before"), F.create_map("item", value).alias("state"))
    reach, most = 1, longest(revisions)
    now = stored(now, "states")
    while reach < most:
        older = now.selectExpr("backing", "revid before", "before further", "state older")
        both = now.join(older, ["backing", "before"], "left")
        grown = "if(older is null, state, map_concat(state, map_filter(older, (x, v) -> not map_contains_key(state, x))))"
        now, reach = stored(both.selectExpr("backing", "revid", "further before", f"{grown} state"), "states"), 2 * reach
    return now.select("backing", "revid", "state")
