"""The one place for recursion: first-parent chains by pointer doubling, closures by levels.

No query recurses on the driver: a loop runs a logarithmic number of joins for chains
and as many as the graph is deep for closures; every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored


def longest(revisions: DataFrame, key: str = "backing") -> int:
    """No chain of revisions is longer than the largest log."""
    return revisions.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def chains(revisions: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """All first-parent ancestors of each start, itself included.

    revisions: (backing, revid, parent); starts: any columns and (backing, start).
    Adds revid and depth, which is at most ``limit`` where one is given.  Jump tables of distance
    1, 2, 4, … are written: log2(n) small tables for a chain of n revisions.  Every path then
    either takes or leaves each jump, so all paths come from one job with one join per table.
    """
    jumps = [stored(revisions.where("parent is not null").select("backing", F.col("revid").alias("at"), F.col("parent").alias("to")), "jump")]
    most = longest(revisions) - 1
    most = most if limit is None else min(most, limit)
    while 1 << len(jumps) <= most:
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        jumps.append(stored(a.join(b, (F.col("a.backing") == F.col("b.backing")) & (F.col("a.to") == F.col("b.at"))).select("a.backing", "a.at", F.col("b.to").alias("to")), "jump"))
    own = [f"`{c}`" for c in starts.columns]
    paths = starts.select("*", F.col("start").alias("revid"), F.lit(0).cast("long").alias("depth"))
    for k, jump in enumerate(jumps if most > 0 else []):
        j = jump.select(F.col("backing").alias("j_backing"), "at", "to")
        both = paths.join(j, (F.col("backing") == F.col("j_backing")) & (F.col("revid") == F.col("at")), "left")
        paths = both.selectExpr(*own, f"inline(filter(array(struct(revid as revid, depth as depth), struct(to as revid, depth + {1 << k} as depth)), x -> x.revid is not null))")
    return stored(paths if limit is None else paths.where(F.col("depth") <= limit), "paths")


#: Steps of a closure that one job takes.
HOPS = 6


def closure(edges: DataFrame, starts: DataFrame, key: str = "backing") -> DataFrame:
    """All nodes reachable from each start, itself included, with the least number of steps.

    edges: (key, src, dst); starts: (key, start).  Breadth first, HOPS steps to a job: within a job
    nodes may be met again, between jobs only nodes not met before go on, so merges and cycles end.
    """
    edges = edges.select(key, "src", "dst")
    front = stored(starts.select(key, "start", F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0).cast("long")), "level")
    met, done = [front], 0
    while True:
        step, found = front, None
        for _ in range(HOPS):
            step = step.join(edges, [key]).where(F.col("node") == F.col("src")).select(key, "start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
            found = step if found is None else found.unionByName(step)
        seen = met[0]
        for part in met[1:]:
            seen = seen.unionByName(part)
        fresh = found.groupBy(key, "start", "node").agg(F.min("depth").alias("depth")).join(seen.select(key, "start", "node"), [key, "start", "node"], "left_anti")
        met, done = [*met, stored(fresh, "level")], done + HOPS
        front = met[-1].where(F.col("depth") == done)
        if front.isEmpty():
            out = met[0]
            for part in met[1:]:
                out = out.unionByName(part)
            return out
        if len(met) == 9:
            met = [stored(seen, "seen"), met[-1]]
            front = met[-1].where(F.col("depth") == done)


def parents(revisions: DataFrame) -> DataFrame:
    """(backing, src, dst, merge) for parents and merge parents."""
    return revisions.selectExpr("backing", "revid src", "inline(array(struct(parent as dst, false as merge), struct(merge_parent as dst, true as merge)))").where("dst is not null")


def levels(edges: DataFrame, nodes: DataFrame, key: str = "backing") -> DataFrame:
    """Longest distance of each node from a node without incoming order (edges: src after dst); nodes on a cycle are left out.

    A node is free when all it comes after are done; only nodes after the last level are
    looked at, so each step costs what it finds.
    """
    order = edges.select(key, "src", "dst")
    level = nodes.select(key, "node").join(order.select(key, F.col("src").alias("node")).distinct(), [key, "node"], "left_anti")
    done, parts, depth = None, 0, 0
    while True:
        level = stored(level.withColumn("level", F.lit(depth).cast("long")), "free")
        if level.isEmpty():
            return done if done is not None else level
        done, parts, depth = level if done is None else done.unionByName(level), parts + 1, depth + 1
        if parts == 8:
            done, parts = stored(done, "done"), 1
        after = order.join(level.select(key, F.col("node").alias("dst")), [key, "dst"], "left_semi").select(key, "src").distinct()
        needs = order.join(after, [key, "src"], "left_semi")
        waits = needs.join(done.select(key, F.col("node").alias("dst")), [key, "dst"], "left_anti").select(key, "src").distinct()
        level = after.join(waits, [key, "src"], "left_anti").select(key, F.col("src").alias("node"))
