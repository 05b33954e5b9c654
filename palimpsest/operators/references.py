"""References between objects and documents: inverse, visibility, reachability, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.recurse import closure


def resolve(refs: DataFrame, proots: DataFrame, branches: DataFrame) -> DataFrame:
    """refs (…, dst_proot, dst_branch or null) with target_branch: null where the root is missing or deleted or the branch is."""
    p = proots.where("not deleted").select(F.col("proot").alias("p"), "current_branch")
    b = branches.where("not deleted").select(F.col("proot").alias("q"), F.col("branch").alias("target_branch"))
    out = refs.join(p, F.col("dst_proot") == F.col("p"), "left").withColumn("want", F.when(F.col("p").isNotNull(), F.coalesce("dst_branch", "current_branch")))
    return out.join(b, (F.col("dst_proot") == F.col("q")) & (F.col("want") == F.col("target_branch")), "left").drop("p", "q", "want", "current_branch")


def referrers(refs: DataFrame, proots: DataFrame, branches: DataFrame) -> DataFrame:
    """Visible referrers: from current, live branches of live roots only. refs: (src_proot, src_branch, …)."""
    live = proots.where("not deleted").select(F.col("proot").alias("src_proot"), F.col("current_branch").alias("src_branch"))
    alive = branches.where("not deleted").select(F.col("proot").alias("src_proot"), F.col("branch").alias("src_branch"))
    return refs.join(live, ["src_proot", "src_branch"], "left_semi").join(alive, ["src_proot", "src_branch"], "left_semi")


def one_parent(children: DataFrame) -> DataFrame:
    """(proot, child, parent, seq) -> the last parent that took each child."""
    w = Window.partitionBy("proot", "child").orderBy(F.desc("seq"))
    return children.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def reachable(edges: DataFrame, roots: DataFrame, key: str = "proot") -> DataFrame:
    """(key, node) reachable from each root over all edges; targets that do not exist are included."""
    return closure(edges, roots, key).select(key, "node").distinct()


def collecting(revisions: DataFrame, period: int = 1000) -> DataFrame:
    """The revisions after which garbage is collected."""
    return revisions.where((F.col("revid") + 1) % period == 0)


def tokens(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, pos): lower-case runs of ASCII letters and digits; other non-ASCII characters belong to terms."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+"), F.lit(0))
    return docs.select(*key, F.posexplode(words).alias("pos", "term"))


def phrase(index: DataFrame, key: list[str], terms: list[str]) -> DataFrame:
    """Keys where the terms stand one after another; a last term ending in * is a prefix.

    Every term contributes (key, pos - its place); a key matches where some base has them all.
    """
    hit = None
    for n, t in enumerate(terms):
        ok = F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t
        hit = ok if hit is None else hit | ok
    place = F.array(*(F.when(F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t, F.lit(n)) for n, t in enumerate(terms)))
    x = index.where(hit).select(*key, "pos", F.explode(F.array_compact(place)).alias("n")).select(*key, (F.col("pos") - F.col("n")).alias("base"), "n")
    return x.groupBy(*key, "base").agg(F.count_distinct("n").alias("found")).where(F.col("found") == len(terms)).select(*key).distinct()


def boolean(index: DataFrame, key: list[str], every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """Keys with every term of ``every``, one of ``some`` (if given) and none of ``none``; one aggregation."""
    terms = [*every, *some, *none]
    g = index.where(F.col("term").isin(*terms)).groupBy(*key).agg(F.collect_set("term").alias("t"))
    ok = F.lit(True)
    for t in every:
        ok = ok & F.array_contains("t", t)
    for t in none:
        ok = ok & ~F.array_contains("t", t)
    if some:
        ok = ok & F.arrays_overlap("t", F.array(*map(F.lit, some)))
    return g.where(ok).select(*key)
