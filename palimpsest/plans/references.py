"""Queries on references, reachability, search and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import references as R
from palimpsest.operators import state
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog


def _paths(m: CommitLog) -> DataFrame:
    """References across roots, one per commit that writes one: to root k % (roots), to its branch 'view' where k % 4 = 0."""
    top = m.revisions.agg(F.max("backing").alias("top"))
    x = m.revisions.where("k % 3 = 2").join(F.broadcast(top))  # one row
    return x.selectExpr("backing src_proot", "branch src_branch", "revid", "item", "cast(k % (top + 1) as bigint) dst_proot", "if(k % 4 = 0, 'view', null) dst_branch")


def ref_1(spark: SparkSession, d: str) -> DataFrame:
    return _paths(CommitLog(spark, d)).select("src_proot", "revid", "item", "dst_proot")


def ref_2(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return _paths(m).where("dst_proot = 8").withColumnRenamed("src_proot", "backing").join(m.proots.select("proot", "backing"), "backing").select("backing", "proot", "revid", "item")


def ref_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return R.referrers(_paths(m), m.proots, m.branches).where("dst_branch is null").select("dst_proot", "src_proot", "item").distinct()


def ref_4(spark: SparkSession, d: str) -> DataFrame:
    """Univalued inverse: the one referrer, with the number of violations of uniqueness."""
    return ref_3(spark, d).groupBy("dst_proot").agg(F.min(F.struct("src_proot", "item")).alias("x"), (F.count("*") - 1).alias("violations")).select("dst_proot", "x.src_proot", "x.item", "violations")


def ref_5(spark: SparkSession, d: str) -> DataFrame:
    return _paths(CommitLog(spark, d)).groupBy("dst_proot").agg(F.count("*").alias("n_referrers"))


def ref_6(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return R.resolve(_paths(m), m.proots, m.branches).select("src_proot", "revid", "dst_proot", "target_branch")


def ref_7(spark: SparkSession, d: str) -> DataFrame:
    """A live view of an ordered relationship: visible targets keep their places, dead ones are counted."""
    m = CommitLog(spark, d)
    x = R.resolve(_paths(m), m.proots, m.branches).withColumn("pos", F.row_number().over(Window.partitionBy("src_proot", "src_branch").orderBy("revid")))
    alive = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target_branch").isNotNull(), F.struct("pos", "dst_proot")))), lambda s: F.concat_ws(":", s["pos"].cast("string"), s["dst_proot"].cast("string"))), ",")
    return x.groupBy("src_proot", "src_branch").agg(alive.alias("visible"), F.count_if(F.col("target_branch").isNull()).alias("n_dead"))


def ref_8(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    moves = m.revisions.where("k % 3 = 0").selectExpr("backing proot", "(k * 3 + 1) % 20 child", "item parent", "revid seq")
    return R.one_parent(moves).select("proot", "child", "parent")


def tag_1(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each part: lower-case words of its type and brand, as one description."""
    p = CommitLog(spark, d).table("part")
    tags = p.select("p_partkey", F.explode(F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tag"))
    return tags.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("description"))


def _graph(m: CommitLog) -> tuple[DataFrame, DataFrame, DataFrame]:
    main = m.branches.join(m.proots.select("proot", F.col("current_branch").alias("branch")), ["proot", "branch"])
    s = state.state_at(m.revisions, main.select("proot", "branch", "backing", F.col("head").alias("start"))).select("proot", "item", "k")
    edges = s.where("k % 3 < 2").selectExpr("proot", "item src", "(k * 3 + 1) % 20 dst")
    top = m.proots.join(m.revisions.where("revid = 0").select("backing", F.col("item").alias("start")), "backing").select("proot", "start")
    return s, edges, top


def gc_1(spark: SparkSession, d: str) -> DataFrame:
    _, edges, top = _graph(CommitLog(spark, d))
    return R.reachable(edges, top).select("proot", F.col("node").cast("long").alias("item"))


def gc_2(spark: SparkSession, d: str) -> DataFrame:
    s, edges, top = _graph(CommitLog(spark, d))
    return s.join(R.reachable(edges, top).select("proot", F.col("node").alias("item")), ["proot", "item"], "left_semi").select("proot", "item", "k")


def gc_3(spark: SparkSession, d: str) -> DataFrame:
    """Which commits collect garbage: every fiftieth of a log here; the model's own period is a thousand."""
    return R.collecting(CommitLog(spark, d).revisions, 50).select("backing", "revid")


def fts_1(spark: SparkSession, d: str) -> DataFrame:
    """Index of committed text: terms and how often each document has them."""
    t = R.tokens(CommitLog(spark, d).table("conversations"), ["conv_id", "turn"], "text")
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("n_terms"), F.count_distinct("term").alias("n_distinct"))


def fts_2(spark: SparkSession, d: str) -> DataFrame:
    t = R.tokens(CommitLog(spark, d).table("conversations"), ["conv_id", "turn"], "text")
    return R.phrase(t, ["conv_id", "turn"], ["of", "the"])


def fts_2_roots(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a phrase, repeated for every root that shares the backing store with the text (a store's texts are the conversations of its number)."""
    m = CommitLog(spark, d)
    return fts_2(spark, d).withColumnRenamed("conv_id", "backing").join(m.proots.select("proot", "backing"), "backing").select("proot", "backing", "turn")


def fts_2_boolean(spark: SparkSession, d: str) -> DataFrame:
    t = R.tokens(CommitLog(spark, d).table("conversations"), ["conv_id", "turn"], "text")
    return R.boolean(t, ["conv_id", "turn"], every=["the"], some=["with", "from"], none=["what"])


def fts_2_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = R.tokens(CommitLog(spark, d).table("conversations"), ["conv_id", "turn"], "text")
    return R.phrase(t, ["conv_id", "turn"], ["in", "th*"])


def att_1(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed import: one row per content, with the first page that has it."""
    p = CommitLog(spark, d).table("pages").select("page_id", F.sha1(F.encode("html", "utf-8")).alias("attachment"), F.octet_length("html").cast("long").alias("n_bytes"))
    return p.groupBy("attachment").agg(F.min("page_id").alias("first_page"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_pages"))


def att_2(spark: SparkSession, d: str) -> DataFrame:
    return att_1(spark, d).select("attachment", F.concat(F.substring("attachment", 1, 2), F.lit("/"), F.col("attachment")).alias("path"))


def cmp_6(spark: SparkSession, d: str) -> DataFrame:
    """Attachments that no kept page refers to."""
    p = CommitLog(spark, d).table("pages").select("page_id", F.sha1(F.encode("html", "utf-8")).alias("attachment"))
    return p.select("attachment").distinct().join(p.where("page_id % 3 <> 0").select("attachment"), "attachment", "left_anti")


_P = "paths AS (SELECT backing AS src_proot, branch AS src_branch, revid, item, k % (SELECT max(backing) + 1 FROM revisions) AS dst_proot, CASE WHEN k % 4 = 0 THEN 'view' END AS dst_branch FROM revisions WHERE k % 3 = 2), resolved AS (SELECT x.*, b.branch AS target_branch FROM paths x LEFT JOIN proots p ON p.proot = x.dst_proot AND NOT p.deleted LEFT JOIN branches b ON b.proot = p.proot AND NOT b.deleted AND b.branch = coalesce(x.dst_branch, p.current_branch))"
_V = _P + ", vis AS (SELECT DISTINCT x.dst_proot, x.src_proot, x.item FROM paths x JOIN proots p ON p.proot = x.src_proot AND NOT p.deleted AND p.current_branch = x.src_branch JOIN branches b ON b.proot = x.src_proot AND b.branch = x.src_branch AND NOT b.deleted WHERE x.dst_branch IS NULL)"
_G = "st AS (SELECT * FROM (SELECT c.proot, r.item, r.k, row_number() OVER (PARTITION BY c.proot, r.item ORDER BY c.depth) AS n FROM chain c JOIN proots p ON p.proot = c.proot AND p.current_branch = c.branch JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid) WHERE n = 1), e AS (SELECT proot, item AS src, (k * 3 + 1) % 20 AS dst FROM st WHERE k % 3 < 2), reach AS (SELECT p.proot, r.item AS node FROM proots p JOIN revisions r ON r.backing = p.backing AND r.revid = 0 UNION SELECT x.proot, e.dst FROM reach x JOIN e ON e.proot = x.proot AND e.src = x.node)"
_T = "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS t FROM conversations), t AS (SELECT conv_id, turn, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM w)"

QUERIES = {
    "ref_1_index": ref_1, "ref_2_to_root": ref_2, "ref_3_referring_objects": ref_3, "ref_4_univalued_inverse": ref_4, "ref_5_all_referring": ref_5, "ref_6_resolve_path": ref_6, "ref_7_dead_references": ref_7, "ref_8_one_parent": ref_8,
    "tag_1_descriptions": tag_1, "gc_1_reachable": gc_1, "gc_2_remove_unreachable": gc_2, "gc_3_cadence": gc_3, "fts_1_index": fts_1, "fts_2_phrase": fts_2, "fts_2_hits_of_roots": fts_2_roots, "fts_2_boolean": fts_2_boolean, "fts_2_prefix": fts_2_prefix,
    "att_1_import": att_1, "att_2_enumerate": att_2, "cmp_6_attachment_gc": cmp_6,
}
SQL = {
    "ref_1_index": f"{M}, {_P} SELECT src_proot, revid, item, dst_proot FROM paths",
    "ref_2_to_root": f"{M}, {_P} SELECT x.src_proot AS backing, p.proot, x.revid, x.item FROM paths x JOIN proots p ON p.backing = x.src_proot WHERE x.dst_proot = 8",
    "ref_3_referring_objects": f"{M}, {_V} SELECT * FROM vis",
    "ref_4_univalued_inverse": f"{M}, {_V} SELECT dst_proot, src_proot, item, n - 1 AS violations FROM (SELECT *, row_number() OVER (PARTITION BY dst_proot ORDER BY src_proot, item) AS r, count(*) OVER (PARTITION BY dst_proot) AS n FROM vis) WHERE r = 1",
    "ref_5_all_referring": f"{M}, {_P} SELECT dst_proot, count(*) AS n_referrers FROM paths GROUP BY 1",
    "ref_6_resolve_path": f"{M}, {_P} SELECT src_proot, revid, dst_proot, target_branch FROM resolved",
    "ref_7_dead_references": f"{M}, {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY src_proot, src_branch ORDER BY revid) AS pos FROM resolved) SELECT src_proot, src_branch, coalesce(string_agg(pos || ':' || dst_proot, ',' ORDER BY pos) FILTER (WHERE target_branch IS NOT NULL), '') AS visible, count(*) FILTER (WHERE target_branch IS NULL) AS n_dead FROM n GROUP BY 1, 2",
    "ref_8_one_parent": f"{M} SELECT backing AS proot, (k * 3 + 1) % 20 AS child, arg_max(item, revid) AS parent FROM revisions WHERE k % 3 = 0 GROUP BY 1, 2",
    "tag_1_descriptions": "SELECT p_partkey, string_agg(tag, ', ' ORDER BY tag) AS description FROM (SELECT p_partkey, lower(p_type) AS tag FROM part UNION SELECT p_partkey, lower(p_brand) FROM part) GROUP BY 1",
    "gc_1_reachable": f"{M}, {_G} SELECT proot, CAST(node AS BIGINT) AS item FROM reach",
    "gc_2_remove_unreachable": f"{M}, {_G} SELECT st.proot, st.item, st.k FROM st JOIN reach ON reach.proot = st.proot AND reach.node = st.item",
    "gc_3_cadence": f"{M} SELECT backing, revid FROM revisions WHERE (revid + 1) % 50 = 0",
    "fts_1_index": f"{_T} SELECT conv_id, turn, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM t GROUP BY 1, 2",
    "fts_2_phrase": f"{_T} SELECT DISTINCT a.conv_id, a.turn FROM t a JOIN t b USING (conv_id, turn) WHERE a.term = 'of' AND b.term = 'the' AND b.pos = a.pos + 1",
    "fts_2_hits_of_roots": f"{M}, {_T[5:]}, h AS (SELECT DISTINCT a.conv_id, a.turn FROM t a JOIN t b USING (conv_id, turn) WHERE a.term = 'of' AND b.term = 'the' AND b.pos = a.pos + 1) "
    "SELECT p.proot, p.backing, h.turn FROM h JOIN proots p ON p.backing = h.conv_id",
    "fts_2_boolean": f"{_T} SELECT conv_id, turn FROM t GROUP BY 1, 2 HAVING bool_or(term = 'the') AND bool_or(term IN ('with', 'from')) AND NOT bool_or(term = 'what')",
    "fts_2_prefix": f"{_T} SELECT DISTINCT a.conv_id, a.turn FROM t a JOIN t b USING (conv_id, turn) WHERE a.term = 'in' AND starts_with(b.term, 'th') AND b.pos = a.pos + 1",
    "att_1_import": "SELECT sha1(html) AS attachment, min(page_id) AS first_page, CAST(max(strlen(html)) AS BIGINT) AS n_bytes, count(*) AS n_pages FROM pages GROUP BY 1",
    "att_2_enumerate": "SELECT DISTINCT sha1(html) AS attachment, substr(sha1(html), 1, 2) || '/' || sha1(html) AS path FROM pages",
    "cmp_6_attachment_gc": "SELECT DISTINCT sha1(html) AS attachment FROM pages EXCEPT SELECT sha1(html) FROM pages WHERE page_id % 3 <> 0",
}
