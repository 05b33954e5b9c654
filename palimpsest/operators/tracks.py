"""Undo timelines: command chains, current nodes, coalescing and compaction plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.predicates import glob_to_regex
from palimpsest.operators.recurse import chains, closure
from palimpsest.operators.state import states


def with_parents(commands: DataFrame) -> DataFrame:
    """commands with the sequence number of the command before on the same track."""
    return commands.withColumn("parent_seq", F.lag("seq").over(Window.partitionBy("track").orderBy("seq")))


def positions(commands: DataFrame, current: DataFrame, pattern: str) -> DataFrame:
    """Nodes of all tracks that match the pattern: what can be undone by sequence, then what can be redone by sequence.

    current: (track, current). Gives track, seq, is_redo and each track's position; the order over several
    tracks is (is_redo, seq), which a reader sorts by range, so no task gathers all nodes.
    """
    c = commands.where(F.col("track").rlike(glob_to_regex(pattern))).join(current, "track", "left")
    c = c.withColumn("is_redo", F.col("seq") > F.coalesce("current", F.lit(0)))
    return c.withColumn("position", F.row_number().over(Window.partitionBy("track").orderBy("is_redo", "seq"))).select("track", "seq", "is_redo", "position")


def coalesce_ops(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent set-version commands where one begins as the other ended become one (islands by running sum of breaks)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    c = commands.withColumn("brk", F.when(F.col("old").eqNullSafe(F.lag("new").over(w)) & F.lag("seq").over(w).isNotNull(), 0).otherwise(1))
    c = c.withColumn("island", F.sum("brk").over(w))
    return c.groupBy(*keys, "island").agg(F.min_by("old", "seq").alias("old"), F.max_by("new", "seq").alias("new"), F.min("seq").alias("first_seq"), F.count("*").alias("n_commands"))


def compaction_plan(commands: DataFrame, cut: int) -> DataFrame:
    """Dead and live revisions of each root: those only commands up to the cut mention are dead; the newest dead one stays if none lives."""
    named = commands.selectExpr("proot", "seq", "inline(array(struct(new as revid, true as is_new), struct(old as revid, false as is_new)))").where("revid is not null")
    named = named.withColumn("live", F.col("seq") > cut)
    by = named.groupBy("proot", "revid").agg(F.bool_or("live").alias("live"))
    newest = named.where("is_new and not live").groupBy("proot").agg(F.max_by("revid", "seq").alias("newest_dead"))
    some = by.groupBy("proot").agg(F.bool_or("live").alias("any_live"))
    out = by.join(some, "proot").join(newest, "proot", "left")
    return out.select("proot", "revid", (F.col("live") | (~F.col("any_live") & F.col("revid").eqNullSafe(F.col("newest_dead")))).alias("live"))


def rewritten(revisions: DataFrame, kept: DataFrame, gone: DataFrame, tops: DataFrame, refers: str, target: str) -> DataFrame:
    """(backing, revid, item, k, value): the snapshots that replace deltas whose parent is deleted.

    kept and gone: (backing, revid, …) of what stays and goes; tops: (backing, top), the root item. An item refers to
    ``target`` where ``refers`` holds; items that the root item does not reach are left out.
    """
    torn = kept.select("backing", "revid", "parent").join(gone.select("backing", F.col("revid").alias("parent")), ["backing", "parent"], "left_semi")
    paths = chains(revisions.select("backing", "revid", "parent"), torn.select("backing", F.col("revid").alias("start")))
    near = paths.join(revisions.select("backing", "revid", "item", "k", "value"), ["backing", "revid"]).groupBy("backing", "start", "item")
    full = near.agg(F.min_by(F.struct("k", "value"), "depth").alias("w")).selectExpr("struct(backing, start) graph", "item", "w.k", "w.value")
    edges = full.where(refers).selectExpr("graph", "item src", f"{target} dst")
    starts = torn.join(tops, "backing").selectExpr("struct(backing, revid as start) graph", "top start")
    inside = closure(edges, starts, "graph").selectExpr("graph", "node item").distinct()
    return full.join(inside, ["graph", "item"], "left_semi").selectExpr("graph.backing", "graph.start revid", "item", "k", "value")


def migrated(revisions: DataFrame, handler: Callable[[DataFrame], DataFrame], is_snapshot: Column) -> DataFrame:
    """(backing, revid, item, new, is_snapshot): every revision rewritten by a handler.

    The handler maps (backing, revid, parent, item, …) to (backing, revid, parent, item, new). Snapshots stay snapshots: full states.
    A delta keeps the items whose new value differs from the migrated parent's.
    """
    written = handler(revisions)
    full = states(written, "new")
    snapshots = full.where(is_snapshot).selectExpr("backing", "revid", "explode(state) as (item, new)").withColumn("is_snapshot", F.lit(True))
    before = full.selectExpr("backing", "revid parent", "state")
    deltas = written.where(~is_snapshot).join(before, ["backing", "parent"], "left")
    deltas = deltas.where("state is null or not map_contains_key(state, item) or not (state[item] <=> new)")
    return snapshots.unionByName(deltas.selectExpr("backing", "revid", "item", "new", "false is_snapshot"))
