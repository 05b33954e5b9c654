"""Queries on synchronisation, interchange formats, attributed text and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec, sequences, text_runs
from palimpsest.operators import history, state
from palimpsest.operators.store import delta_layout
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog
from palimpsest.streaming import feed


def sync_1(spark: SparkSession, d: str) -> DataFrame:
    b = CommitLog(spark, d).branches.where("not deleted")
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "branch", F.col("current").cast("string"))))
    return b.groupBy("proot").agg(F.array_join(pairs, ",").alias("request"))


def _starts(m: CommitLog, trunk_only: bool) -> DataFrame:
    b = m.branches.where("proot = backing and not deleted")
    if trunk_only:
        b = b.join(m.proots.select("proot", F.col("current_branch").alias("branch")), ["proot", "branch"], "left_semi")
    return b.select("backing", F.col("current").alias("start")).distinct()


def sync_2(spark: SparkSession, d: str) -> DataFrame:
    """Revisions that a client that has the trunk lacks, each with its full graph."""
    m = CommitLog(spark, d)
    have = history.ancestors(m.revisions, _starts(m, True)).select("backing", "node").distinct()
    lacks = history.ancestors(m.revisions, _starts(m, False)).select("backing", "node").distinct().join(have, ["backing", "node"], "left_anti")
    full = state.states(m.revisions, "k").withColumnRenamed("revid", "node")
    return lacks.join(full, ["backing", "node"]).selectExpr("backing", "node", "explode(state) as (item, k)")


def sync_2_branches(spark: SparkSession, d: str) -> DataFrame:
    """The branches that a pull response lists: live ones that do not mirror another store's (cheap copies do)."""
    return CommitLog(spark, d).branches.where("not deleted and proot = backing").select("proot", "branch", "current", "head")


def sync_3(spark: SparkSession, d: str) -> DataFrame:
    """Mirror branches after a pull: upserted by (source, replicated branch)."""
    b = CommitLog(spark, d).branches.where("not deleted")
    old = b.where("head % 2 = 0").select("proot", "branch", F.lit("old").alias("state"), (F.col("head") - 1).alias("at"))
    new = b.where("head % 3 = 0").select("proot", "branch", F.lit("new").alias("state"), F.col("head").alias("at"))
    return state.overlay(old, new, ["proot", "branch"])


def sync_4(spark: SparkSession, d: str) -> DataFrame:
    """Which pushes of a branch's work are fast-forward for a server at the trunk's head."""
    m = CommitLog(spark, d)
    main = m.branches.join(m.proots.select("proot", F.col("current_branch").alias("branch")), ["proot", "branch"]).select("proot", F.col("head").alias("server"))
    on = history.head_paths(m.revisions, m.branches).select("proot", "branch", F.col("revid").alias("server"), F.lit(True).alias("yes"))
    return m.branches.join(main, "proot").join(on, ["proot", "branch", "server"], "left").select("proot", "branch", F.when(F.col("yes"), "fast-forward").otherwise("rebase").alias("action"))


def sync_5(spark: SparkSession, d: str) -> DataFrame:
    """What the server sends back for each pushed branch: the revisions of the trunk since the fork, in order, which the client rebases onto."""
    m = CommitLog(spark, d)
    trunk = m.proots.select("proot", F.col("current_branch").alias("t"))
    paths = history.head_paths(m.revisions, m.branches).join(trunk, "proot")
    main = paths.where("branch = t").select("proot", "revid")
    fork = paths.where("branch <> t").select("proot", "branch", "revid").join(main, ["proot", "revid"]).groupBy("proot", "branch").agg(F.max("revid").alias("base"))
    return fork.join(main, "proot").where("revid > base").select("proot", "branch", "base", "revid")


def sync_6(spark: SparkSession, d: str) -> DataFrame:
    """Revision payloads as JSON and back."""
    r = CommitLog(spark, d).revisions
    text = F.to_json(F.struct("rev", "parent", "item", "k"))
    back = F.from_json(text, "rev long, parent long, item int, k int")
    return r.select("backing", "revid", back.alias("b")).select("backing", "revid", "b.rev", "b.parent", "b.item", "b.k")


def sync_7(spark: SparkSession, d: str) -> DataFrame:
    e = CommitLog(spark, d).table("events").selectExpr("user_id proot", "cast(value as bigint) txn", "event_id seq")
    return feed.fresh(e)


def _item(proot: int, revid: int, item: int, k: int) -> dict:
    name = lambda x: f"{proot & 0xFFFFFFFF:08x}-0000-4000-8000-{x & 0xFFFFFFFFFFFF:012x}"
    return {"id": name(item), "attrs": {"count": (1, k), "share": (2, k / 8), "kind": (3, f"k{k}"), "next": (6, name((k * 3 + 1) % 20)), "tags": (17, [k % 5, k % 3]), "log": (33, [k, revid, None])}}


def cod_1(spark: SparkSession, d: str) -> DataFrame:
    """Every written item through the binary and the JSON format and back; the content's digest."""
    r = CommitLog(spark, d).revisions.select("backing", "revid", F.col("item"), "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for backing, revid, item, k in b.itertuples(index=False):
                x = _item(backing, revid, item, k)
                raw = codec.encode_item(x)
                ok = codec.encode_item(codec.decode_item(raw)) == raw and codec.encode_item(codec.from_json(codec.to_json(x))) == raw
                out.append((backing, revid, raw, ok))
            yield pd.DataFrame(out, columns=["backing", "revid", "raw", "ok"])

    return r.mapInPandas(run, "backing long, revid long, raw binary, ok boolean").select("backing", "revid", F.sha1("raw").alias("digest"), "ok")


def cod_3(spark: SparkSession, d: str) -> DataFrame:
    """Item JSON read by Spark: {attribute: {type: value}} to rows."""
    r = CommitLog(spark, d).revisions
    obj = F.to_json(F.struct(F.struct(F.col("k").alias("int")).alias("count"), F.struct(F.col("branch").alias("string")).alias("kind")))
    m = F.from_json(obj, "map<string, map<string, string>>")
    x = r.select("backing", "revid", F.explode(m).alias("attr", "v")).select("backing", "revid", "attr", F.explode("v").alias("type", "val"))
    return x


def cod_5(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines inside, as tree JSON (composites in their parents)."""
    m = CommitLog(spark, d)
    lines = m.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number (int)"), F.col("l_partkey").alias("part (reference)")))).alias("lines (composite-array)"))
    o = m.table("orders").join(lines, "o_orderkey", "left")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status (string)"), "lines (composite-array)")).alias("tree"))


def snk_1(spark: SparkSession, d: str) -> DataFrame:
    return delta_layout(CommitLog(spark, d).revisions, 20)


def exp_1(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a dot graph of revisions; merge edges are orange."""
    r = CommitLog(spark, d).revisions
    edge = F.expr("inline(array(struct(parent as p, '' as style), struct(merge_parent as p, ' [color=orange]' as style)))")
    x = r.select("backing", "revid", edge).where("p is not null")
    return x.select("backing", F.concat(F.lit("r"), "revid", F.lit(" -> r"), "p", "style", F.lit(";")).alias("line"))


def txt_1(spark: SparkSession, d: str) -> DataFrame:
    """Text differences between neighbouring turns of a conversation, checked by application."""
    from pyspark.sql import Window

    c = CommitLog(spark, d).table("conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, turn, old, new in b.itertuples(index=False):
                x, y = old.split(" "), new.split(" ")
                edits = sequences.diff(x, y)
                out.append((conv, turn, len(edits), sequences.apply(x, edits) == y))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "n_edits", "ok"])

    return c.select("conv_id", "turn", "before", "text").mapInPandas(run, "conv_id long, turn long, n_edits long, ok boolean")


def txt_2(spark: SparkSession, d: str) -> DataFrame:
    """Attributed text: the title words of parts get attributes; difference and application give the new text back."""
    p = CommitLog(spark, d).table("part").select("p_partkey", "p_name", "p_type", "p_size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, name, kind, size in b.itertuples(index=False):
                a = [(name, frozenset()), (" " + kind, frozenset({"b"}))]
                c = [(name[: size % 5], frozenset({"i"})), (name[size % 5 :] + "!", frozenset()), (" " + kind.lower(), frozenset({"b"}))]
                ops = text_runs.diff(a, c, "x")
                got = text_runs.apply(a, ops)
                out.append((key, len(ops), text_runs.plain(got), got == text_runs.compact(text_runs.plain(c), text_runs.marks(c))))
            yield pd.DataFrame(out, columns=["p_partkey", "n_ops", "text", "ok"])

    return p.mapInPandas(run, "p_partkey long, n_ops long, text string, ok boolean").select("p_partkey", "text", "ok")


def txt_4(spark: SparkSession, d: str) -> DataFrame:
    """Text of chunks, where each begins, and the longest run of equal attributes (islands)."""
    from pyspark.sql import Window

    c = CommitLog(spark, d).table("conversations").where("text is not null").select("conv_id", "turn", "role", F.length("text").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("start", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("island", F.sum(F.when(F.col("role").eqNullSafe(F.lag("role").over(w)), 0).otherwise(1)).over(w))
    runs = c.groupBy("conv_id", "island").agg(F.sum("n").alias("run"), F.max(F.col("start") + F.col("n")).alias("end"))
    return runs.groupBy("conv_id").agg(F.max("run").alias("longest_run"), F.max("end").alias("n_chars"))


QUERIES = {
    "sync_1_pull_request": sync_1, "sync_2_pull_response": sync_2, "sync_2_branch_list": sync_2_branches, "sync_3_apply_response": sync_3, "sync_4_push_action": sync_4, "sync_5_push_response": sync_5, "sync_6_payloads": sync_6, "sync_7_change_feed": sync_7,
    "cod_1_binary_round_trip": cod_1, "cod_3_json_rows": cod_3, "cod_5_tree_json": cod_5, "snk_1_delta_layout": snk_1, "exp_1_dot_graph": exp_1, "txt_1_text_diff": txt_1, "txt_2_attributed_text": txt_2, "txt_4_chunks": txt_4,
}
_C = "edges AS (SELECT backing, revid AS src, parent AS dst FROM revisions WHERE parent IS NOT NULL UNION SELECT backing, revid, merge_parent FROM revisions WHERE merge_parent IS NOT NULL)"
SQL = {
    "sync_1_pull_request": f"{M} SELECT proot, string_agg(branch || ':' || current, ',' ORDER BY branch || ':' || current) AS request FROM branches WHERE NOT deleted GROUP BY 1",
    "sync_2_pull_response": f"{M}, {_C}, ca AS (SELECT backing, current AS node FROM own WHERE NOT deleted UNION SELECT c.backing, e.dst FROM ca c JOIN edges e ON e.backing = c.backing AND e.src = c.node), ch AS (SELECT o.backing, o.current AS node FROM own o JOIN trunk t ON t.proot = o.proot AND t.branch = o.branch WHERE NOT o.deleted UNION SELECT c.backing, e.dst FROM ch c JOIN edges e ON e.backing = c.backing AND e.src = c.node), "
    "lk AS (SELECT * FROM ca EXCEPT SELECT * FROM ch), up AS (SELECT l.backing, l.node, l.node AS revid, 0 AS depth FROM lk l UNION ALL SELECT u.backing, u.node, r.parent, u.depth + 1 FROM up u JOIN revisions r ON r.backing = u.backing AND r.revid = u.revid WHERE r.parent IS NOT NULL) "
    "SELECT u.backing, u.node, r.item, arg_min(r.k, u.depth) AS k FROM up u JOIN revisions r ON r.backing = u.backing AND r.revid = u.revid GROUP BY 1, 2, 3",
    "sync_2_branch_list": f"{M} SELECT proot, branch, current, head FROM own WHERE NOT deleted",
    "sync_3_apply_response": f"{M}, b AS (SELECT * FROM branches WHERE NOT deleted) SELECT proot, branch, CASE WHEN head % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN head % 3 = 0 THEN head ELSE head - 1 END AS at FROM b WHERE head % 3 = 0 OR head % 2 = 0",
    "sync_4_push_action": f"{M} SELECT b.proot, b.branch, CASE WHEN EXISTS (SELECT 1 FROM chain c WHERE c.proot = b.proot AND c.branch = b.branch AND c.revid = t.head) THEN 'fast-forward' ELSE 'rebase' END AS action FROM branches b JOIN proots p ON p.proot = b.proot JOIN branches t ON t.proot = p.proot AND t.branch = p.current_branch",
    "sync_5_push_response": f"{M}, main AS (SELECT c.proot, c.revid FROM chain c JOIN proots p ON p.proot = c.proot AND p.current_branch = c.branch), fork AS (SELECT c.proot, c.branch, max(c.revid) AS base FROM chain c JOIN proots p ON p.proot = c.proot AND p.current_branch <> c.branch JOIN main ON main.proot = c.proot AND main.revid = c.revid GROUP BY 1, 2) SELECT f.proot, f.branch, f.base, m.revid FROM fork f JOIN main m ON m.proot = f.proot AND m.revid > f.base",
    "sync_6_payloads": f"{M} SELECT backing, revid, rev, parent, item, k FROM revisions",
    "sync_7_change_feed": "SELECT proot, txn, seq FROM (SELECT user_id AS proot, CAST(trunc(value) AS BIGINT) AS txn, event_id AS seq, max(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events) WHERE last IS NULL OR txn > last",
    "cod_3_json_rows": f"{M} SELECT backing, revid, 'count' AS attr, 'int' AS type, CAST(k AS VARCHAR) AS val FROM revisions UNION ALL SELECT backing, revid, 'kind', 'string', branch FROM revisions",
    "snk_1_delta_layout": f"{M}, run AS (SELECT backing, revid, revid AS delta_base FROM revisions WHERE parent IS NULL UNION ALL SELECT r.backing, r.revid, CASE WHEN r.revid - run.delta_base < 20 THEN run.delta_base ELSE r.revid END FROM run JOIN revisions r ON r.backing = run.backing AND r.parent = run.revid) SELECT * FROM run",
    "exp_1_dot_graph": f"{M} SELECT backing, 'r' || revid || ' -> r' || parent || ';' AS line FROM revisions WHERE parent IS NOT NULL UNION ALL SELECT backing, 'r' || revid || ' -> r' || merge_parent || ' [color=orange];' FROM revisions WHERE merge_parent IS NOT NULL",
    "txt_2_attributed_text": "SELECT p_partkey, p_name || '! ' || lower(p_type) AS text, TRUE AS ok FROM part",
    "txt_4_chunks": "WITH c AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS brk FROM conversations WHERE text IS NOT NULL), i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c), r AS (SELECT conv_id, island, sum(n) AS run, max(start + n) AS e FROM i GROUP BY 1, 2) SELECT conv_id, CAST(max(run) AS BIGINT) AS longest_run, CAST(max(e) AS BIGINT) AS n_chars FROM r GROUP BY 1",
}
