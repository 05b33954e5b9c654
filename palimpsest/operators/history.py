"""Branch histories and revision graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored
from palimpsest.operators.recurse import HOPS, chains, closure, levels, parents


def head_paths(revisions: DataFrame, branches: DataFrame, at: str = "head", limit: int | None = None) -> DataFrame:
    """(proot, branch, backing, start, revid, depth) for the first-parent chain of every branch."""
    return chains(revisions.select("backing", "revid", "parent"), branches.select("proot", "branch", "backing", F.col(at).alias("start")), limit)


def within_result(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Parents as listed with the rows: null where the parent is not itself listed."""
    have = rows.select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("revid").alias("p"))
    out = rows.join(have, [*[F.col(k) == F.col(f"h_{k}") for k in keys], F.col("parent") == F.col("p")], "left")
    return out.select(*keys, "revid", F.col("p").alias("parent"))


def branch_history(paths: DataFrame, revisions: DataFrame, parent_branches: bool = False) -> DataFrame:
    """Default listing: the head's chain while it stays on the branch; with parent_branches the whole chain.

    A branch whose head lies on another branch has an empty history, as it is anchored on its own rows.
    """
    r = revisions.select("backing", "revid", "parent", F.col("branch").alias("on_branch"))
    rows = paths.join(r, ["backing", "revid"])
    foreign = rows.where("on_branch <> branch").groupBy("proot", "branch").agg(F.min("depth").alias("stop"))
    rows = rows.join(foreign, ["proot", "branch"], "left")
    rows = rows.where("stop is null or stop > 0") if parent_branches else rows.where("stop is null or depth < stop")
    return within_result(rows.select("proot", "branch", "revid", "parent"), ["proot", "branch"])


def divergent_history(revisions: DataFrame, branches: DataFrame, parent_branches: bool = True) -> DataFrame:
    """The listing with divergent revisions, from a branch's newest revision down.

    The row after x is the next lower one that is either on x's branch or x's parent,
    so the listing is a chain along greatest(previous on the branch, parent) and needs no
    ordered scan of a whole log. Without parent_branches it ends before the first row of
    another branch.
    """
    before = F.lag("revid").over(Window.partitionBy("backing", "branch").orderBy("revid"))
    linked = revisions.select("backing", "revid", "branch", "parent", before.alias("before")).select("backing", "revid", "branch", F.greatest("before", "parent").alias("parent"))
    newest = revisions.groupBy("backing", "branch").agg(F.max("revid").alias("start"))
    paths = chains(linked.select("backing", "revid", "parent"), branches.select("proot", "branch", "backing").join(newest, ["backing", "branch"]))
    if not parent_branches:
        on = linked.select("backing", "revid", F.col("branch").alias("on_branch"))
        stop = paths.join(on, ["backing", "revid"]).where("on_branch <> branch").groupBy("proot", "branch").agg(F.min("depth").alias("stop"))
        paths = paths.join(stop, ["proot", "branch"], "left").where("stop is null or depth < stop")
    return paths.select("proot", "branch", "revid")


def ancestors(revisions: DataFrame, starts: DataFrame) -> DataFrame:
    """Closure over parents and merge parents (backing, start, node, depth)."""
    return closure(parents(revisions).select("backing", "src", "dst"), starts)


def common_ancestor(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """First revision met breadth first from b (a parent before a merge parent) that is a's ancestor or a; null if none.

    pairs: (backing, a, b). The order among revisions of one level is the order in which
    a queue would reach them, carried as a path of 0 (parent) and 1 (merge parent) over the
    HOPS steps of a job and as a place in the last level before.  Pairs stop at their first hit.
    """
    pair = ["backing", "a", "b"]
    of_a = ancestors(revisions, pairs.select("backing", F.col("a").alias("start"))).select("backing", F.col("start").alias("a"), F.col("node"))
    edges = parents(revisions).select("backing", "src", "dst", F.col("merge").cast("int").cast("string").alias("turn"))
    fresh = stored(pairs.select(*pair, F.col("b").alias("node"), F.lit("").alias("path"), F.lit(0).cast("long").alias("depth")).distinct(), "bfs")
    found, seen, done = [], fresh, 0
    place = Window.partitionBy(*pair).orderBy("path")
    while True:
        hit = stored(fresh.join(of_a, ["backing", "a", "node"]).groupBy(*pair).agg(F.min_by("node", F.struct("depth", "path")).alias("ancestor")), "hit")
        found.append(hit)
        front = fresh.where(F.col("depth") == done).join(hit, pair, "left_anti")
        step = stored(front.withColumn("path", F.lpad(F.row_number().over(place).cast("string"), 10, "0")), "front")
        if step.isEmpty():
            break
        reached = None
        for _ in range(HOPS):
            on = step.join(edges, "backing").where("node = src")
            step = on.groupBy(*pair, F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).agg(F.min(F.concat("path", "turn")).alias("path")).select(*pair, "node", "path", "depth")
            reached = step if reached is None else reached.unionByName(step)
        first = reached.groupBy(*pair, "node").agg(F.min(F.struct("depth", "path")).alias("at")).select(*pair, "node", "at.path", "at.depth")
        fresh, done = stored(first.join(seen, [*pair, "node"], "left_anti"), "bfs"), done + HOPS
        seen = stored(seen.unionByName(fresh), "seen") if len(found) % 8 == 0 else seen.unionByName(fresh)
    return pairs.join(reduce(DataFrame.unionByName, found), pair, "left")


def topological(revisions: DataFrame) -> DataFrame:
    """(backing, node, level): parents have lower levels than their children."""
    return levels(parents(revisions).select("backing", "src", "dst"), revisions.select("backing", F.col("revid").alias("node")))
