"""Scans, projections, filters, joins, aggregates and set operations over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.dates import millis
from palimpsest.functions.predicates import glob_to_regex, type_is_valid
from palimpsest.operators import state
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog


def src_1(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    parts = [m.revisions.selectExpr("'revisions' name"), m.branches.selectExpr("'branches' name"), m.proots.selectExpr("'proots' name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").count().withColumnRenamed("count", "n_rows")


def src_2(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).proots.where("not deleted").select("proot")


def src_3(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).proots.where("deleted").select("proot")


def src_4(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    b = m.branches.groupBy("proot").agg(F.count("*").alias("n_branches"), F.array_join(F.array_sort(F.collect_list("branch")), ",").alias("branches"))
    return m.proots.join(b, "proot", "left").select("proot", "current_branch", "deleted", F.coalesce("n_branches", F.lit(0)).alias("n_branches"), F.coalesce("branches", F.lit("")).alias("branches"))


def src_5(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).branches.where("branch = 'view' and head = 60").select("branch", "proot")


def src_6(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).branches.where("proot = 7").select("branch", "head")


def src_7(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).proots.select("backing").distinct()


def src_8(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    stores = m.proots.where("proot <> backing").select("proot", "backing")
    return m.proots.select("proot").join(stores, "proot", "left").select("proot", F.coalesce("backing", "proot").alias("backing"))


def _resolved(m: CommitLog) -> DataFrame:
    name = m.revisions.select(F.col("backing").alias("pb"), F.col("revid").alias("p"), F.col("rev").alias("parent_rev"))
    merge = name.toDF("mb", "mp", "merge_rev")
    r = m.revisions.join(name, (F.col("backing") == F.col("pb")) & (F.col("parent") == F.col("p")), "left")
    return r.join(merge, (F.col("backing") == F.col("mb")) & (F.col("merge_parent") == F.col("mp")), "left").select("backing", "revid", "rev", "parent_rev", "merge_rev", "branch")


def src_9(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(CommitLog(spark, d)).where("revid = 10")


def src_10(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(CommitLog(spark, d))


def src_11(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return m.proots.join(m.revisions.where("revid = 0").select("backing", "item"), "backing").select("proot", F.col("item").alias("root_item"))


def src_12(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    tagged = m.branches.withColumn("metadata", F.create_map(F.lit("label"), F.col("branch"), F.lit("from"), F.coalesce("parent_branch", F.lit("none"))))
    return tagged.where(F.try_element_at("metadata", F.lit("from")) == "view").select("proot", "branch")


def src_13(spark: SparkSession, d: str) -> DataFrame:
    r = CommitLog(spark, d).revisions.groupBy("backing").agg(F.min("revid").alias("low"), F.max("revid").alias("high"), F.count("*").alias("used"))
    return r.select("backing", "low", "high", "used", F.size(F.sequence("low", "high")).cast("long").alias("dense"))


def src_14(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    wanted = m.table("events").select(F.col("event_id").alias("rev"))
    return m.revisions.join(wanted, "rev", "left_semi").select("rev", "backing", "revid")


def src_15(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    asked = m.proots.select("backing").distinct().select("backing", F.lit(65).cast("long").alias("revid"))
    have = m.revisions.select("backing", "revid", F.lit(True).alias("found"))
    return asked.join(have, ["backing", "revid"], "left").select("backing", F.coalesce("found", F.lit(False)).alias("has_revid"))


def src_16(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    size = m.revisions.groupBy("backing").agg(F.sum(F.length(F.col("k").cast("string")) + F.length("branch")).cast("long").alias("export_size"))
    return m.proots.join(size, "backing").select("proot", "export_size", F.when(F.col("backing") == F.col("proot"), F.col("export_size")).otherwise(0).alias("used_size"))


def src_17(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bytes per file of the event table."""
    t = CommitLog(spark, d).table("events").select("_metadata.file_name", "_metadata.file_size")
    return t.groupBy("file_name").agg(F.count("*").alias("n_rows"), F.max("file_size").alias("n_bytes"))


def src_18(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    line = F.concat_ws(" ", F.lit("backing"), F.col("backing").cast("string"), F.lit("revisions"), F.count("*").cast("string"), F.lit("newest"), F.max("revid").cast("string"))
    return m.revisions.groupBy("backing").agg(line.alias("line"))


def src_19(spark: SparkSession, d: str) -> DataFrame:
    b = CommitLog(spark, d).branches
    return b.groupBy("proot").agg(F.count("*").alias("n_all"), F.count_if(~F.col("deleted")).alias("n_live"), F.count_if(F.col("deleted")).alias("n_deleted"))


def snk_3(spark: SparkSession, d: str) -> DataFrame:
    """Final state of each branch after its log of set-version actions."""
    c = CommitLog(spark, d).commands
    return c.groupBy("proot", "branch").agg(F.max_by("new", "seq").alias("current"), F.max_by("old", "seq").alias("previous"), F.count("*").alias("n_actions"))


def snk_4(spark: SparkSession, d: str) -> DataFrame:
    """Last revision set for each branch inside each transaction, a hundred actions in order."""
    c = CommitLog(spark, d).commands.withColumn("txn", F.expr("(seq - 1) div 100"))
    return c.groupBy("txn", "proot", "branch").agg(F.max_by("new", "seq").alias("last_set"))


def _attrs(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    w = m.revisions.selectExpr("backing proot", "branch", "revid", "item", "k", "branch kind")
    return w


def prj_1(spark: SparkSession, d: str) -> DataFrame:
    """Names, types and values of the attributes of every written item (a map column turned into rows)."""
    w = _attrs(spark, d)
    attrs = F.create_map(F.lit("k"), F.struct(F.lit(1).alias("type"), F.col("k").cast("string").alias("val")), F.lit("kind"), F.struct(F.lit(3).alias("type"), F.col("kind").alias("val")))
    x = w.select("proot", "revid", F.explode(F.map_entries(attrs)).alias("e"))
    return x.select("proot", "revid", F.col("e.key").alias("attr"), F.col("e.value.type").alias("type"), F.col("e.value.val").alias("val"))


def prj_2(spark: SparkSession, d: str) -> DataFrame:
    """Any attribute as a list: nothing for null, one for a scalar, the elements of a set."""
    w = _attrs(spark, d).withColumn("scalar", F.when(F.col("k") % 4 != 0, F.col("k")))
    lists = F.array_sort(F.array_distinct(F.array(F.col("k") % 5, F.col("k") % 3)))
    values = F.when(F.col("k") % 2 == 0, lists).when(F.col("scalar").isNull(), F.expr("cast(array() as array<int>)")).otherwise(F.array("scalar"))
    return w.select("proot", "revid", F.size(values).cast("long").alias("n_values"), F.array_join(values.cast("array<string>"), ",").alias("list"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """One reference per written item: kind 6 composite, 5 inner, and paths to other roots (type 5 with a root)."""
    w = _attrs(spark, d)
    top = w.agg(F.max("proot").alias("top"))
    return w.join(F.broadcast(top)).selectExpr("proot", "revid", "item", "case k % 3 when 0 then 6 else 5 end type", "if(k % 3 < 2, (k * 3 + 1) % 20, null) dst_item", "if(k % 3 = 2, k % (top + 1), null) dst_proot")


def prj_3(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where("type & 15 = 6").select("proot", "item", "dst_item").distinct()


def prj_4(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where("type & 15 = 5 and dst_proot is null").select("proot", "item", "dst_item").distinct()


def prj_5(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where("dst_item is not null").select("proot", "item", "dst_item").distinct()


def prj_6(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where("type & 15 = 5 and dst_proot is not null").select("proot", "revid", "dst_proot")


def prj_7(spark: SparkSession, d: str) -> DataFrame:
    """Attachments: content-addressed page bodies by the page that refers to them."""
    p = CommitLog(spark, d).table("pages")
    return p.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("attachment"))


def prj_8(spark: SparkSession, d: str) -> DataFrame:
    """Full-text content of an item: its text attributes by name, joined by a space."""
    w = _attrs(spark, d)
    return w.select("proot", "revid", F.concat_ws(" ", F.col("kind"), F.concat(F.lit("item"), F.col("item").cast("string"))).alias("content"))


def prj_9(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    s = state.state_at(m.revisions.where("item in (1, 2, 3)").unionByName(m.revisions.where("item not in (1, 2, 3)").withColumn("item", F.lit(None).cast("int"))), m.branches.select("proot", "branch", "backing", F.col("head").alias("start")))
    return s.where("item is not null").select("proot", "branch", "item", "k")


def flt_1(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).table("orders").where("o_totalprice > 200000 and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


def flt_2(spark: SparkSession, d: str) -> DataFrame:
    """Smart group: a target collection with a predicate, as a view."""
    CommitLog(spark, d).table("customer").createOrReplaceTempView("smart_target")
    return spark.sql("SELECT c_custkey, c_nationkey FROM smart_target WHERE c_acctbal > 5000")


def flt_3(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).table("part").where("p_name = 'large ring'").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


def flt_4(spark: SparkSession, d: str) -> DataFrame:
    """Libraries: objects reachable from live roots whose entity is a library, with the content type they hold."""
    m = CommitLog(spark, d)
    libs = spark.createDataFrame([("view", "bookmark"), ("click", "note"), ("purchase", "music")], "branch string, library string")
    return m.branches.where("not deleted").join(F.broadcast(libs), "branch").join(m.proots.where("not deleted").select("proot"), "proot", "left_semi").groupBy("library").agg(F.count("*").alias("n_members"))


def flt_5(spark: SparkSession, d: str) -> DataFrame:
    """Violations of graph validity in the trunk's state: inner references without a target item."""
    m = CommitLog(spark, d)
    s = state.state_at(m.revisions, m.proots.select("proot", F.col("current_branch").alias("branch")).join(m.branches, ["proot", "branch"]).select("proot", "branch", "backing", F.col("head").alias("start")))
    refs = s.where("k % 3 < 2").selectExpr("proot", "item", "(k * 3 + 1) % 20 dst")
    return refs.join(s.select("proot", F.col("item").alias("dst")), ["proot", "dst"], "left_anti").select("proot", "item", "dst")


def flt_6(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 256).select(F.col("id").cast("int").alias("type"), type_is_valid(F.col("id").cast("int")).alias("valid"))


def flt_7(spark: SparkSession, d: str) -> DataFrame:
    """Constraint violations per property as rows."""
    li = CommitLog(spark, d).table("lineitem")
    bad = F.array_compact(F.array(F.when(F.col("l_discount") > 0.09, "discount"), F.when(F.col("l_quantity") > 49, "quantity"), F.when(F.col("l_tax") < 0, "tax")))
    return li.select(F.explode(bad).alias("property")).groupBy("property").agg(F.count("*").alias("n_violations"))


def flt_8(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).commands.where(F.col("track").rlike(glob_to_regex("user.1?.*e*"))).select("track").distinct()


def join_1(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    hits = m.revisions.where("k = 42").select("backing", "revid")
    return m.revisions.join(hits, ["backing", "revid"], "left_semi").join(m.proots.select("proot", "backing"), "backing").select("proot", "revid")


def join_2(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return m.proots.select("proot", "backing").join(m.branches.select("proot", "branch", "head"), "proot").join(m.revisions.select("backing", F.col("revid").alias("head"), "rev"), ["backing", "head"]).select("backing", "proot", "branch", "rev")


def join_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    live = m.proots.where("not deleted").select("proot", F.lit(1).alias("present"))
    return m.proots.select("proot", "backing").join(live, "proot", "left").groupBy("backing").agg(F.coalesce(F.sum("present"), F.lit(0)).alias("n")).where("n = 0").select("backing")


def join_4(spark: SparkSession, d: str) -> DataFrame:
    """Live revisions whose parent is garbage (revisions before number 20) and that are no full snapshot (every 50th is one)."""
    r = CommitLog(spark, d).revisions
    p = r.select("backing", F.col("revid").alias("parent"), (F.col("revid") < 20).alias("garbage"))
    return r.join(p, ["backing", "parent"], "left").where("garbage and revid >= 20 and revid % 50 <> 0").select("backing", "revid", "parent")


def join_5(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    head = c.groupBy("track").agg(F.max("seq").alias("head"), F.max(F.when(F.col("k") % 2 == 0, F.col("seq"))).alias("current"))
    gone = c.select(F.col("seq").alias("head"), "track", (F.col("k") % 13 == 0).alias("headdeleted"))
    cur = c.select(F.col("seq").alias("current"), "track", F.col("new").alias("current_revision"))
    return head.join(gone, ["track", "head"], "left").where("not headdeleted").join(cur, ["track", "current"], "left").select("track", "head", "current", "current_revision")


def join_6(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    p = c.select("proot", F.col("new").alias("old"), F.col("seq").alias("parent_seq"))
    return c.join(p, ["proot", "old"], "left").select("seq", "parent_seq")


def join_7(spark: SparkSession, d: str) -> DataFrame:
    r = CommitLog(spark, d).revisions
    top = r.where("branch = 'view'").groupBy("backing").agg(F.max("revid").alias("top"))
    return r.join(top, "backing").where("revid <= top").groupBy("backing").agg(F.count("*").alias("n"), F.max("top").alias("top"))


def join_8(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    ids = m.commands.select("proot", F.col("new").alias("head"), "seq")
    return m.branches.join(ids, ["proot", "head"], "left").select("proot", "branch", F.coalesce("seq", F.lit(-1)).alias("head_id"))


def agg_1(spark: SparkSession, d: str) -> DataFrame:
    r = CommitLog(spark, d).revisions
    return r.groupBy("backing", "branch").agg(F.count("*").alias("n"), F.max("revid").alias("high"), F.min("revid").alias("low"), F.sum("k").alias("sum_k")).where("n > 10")


def agg_2(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).revisions.select("backing", "branch").distinct()


def agg_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return m.proots.groupBy("backing").agg(F.array_join(F.array_sort(F.collect_list("proot")).cast("array<string>"), ",").alias("proots"))


def agg_4(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).commands.groupBy("proot").agg(F.max_by("track", "seq").alias("last_track"), F.max("seq").alias("last_seq"))


def sort_1(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).revisions.select("backing", "revid", "rev").orderBy("backing", F.desc("revid"))


def lim_1(spark: SparkSession, d: str) -> DataFrame:
    return CommitLog(spark, d).revisions.where("backing = 5 and branch = 'view'").orderBy(F.desc("revid")).limit(1).select("backing", "revid")


def set_1(spark: SparkSession, d: str) -> DataFrame:
    sets = _attrs(spark, d).select("proot", "revid", F.array(F.col("k") % 5, F.col("k") % 3, F.lit(7)).alias("a"), F.array(F.col("item") % 5, F.lit(7)).alias("b"))
    out = {"minus": F.array_except("a", "b"), "common": F.array_intersect("a", "b"), "either": F.array_union("a", "b")}
    return sets.select("proot", "revid", *(F.array_join(F.array_sort(x).cast("array<string>"), ",").alias(n) for n, x in out.items()))


def set_2(spark: SparkSession, d: str) -> DataFrame:
    r = CommitLog(spark, d).revisions
    live = r.where("k % 2 = 0").select("backing", "revid").unionByName(r.where("revid < 5").select("backing", "revid")).distinct()
    return live.join(r.where("k % 3 = 0").select("backing", "revid"), ["backing", "revid"], "left_anti")


def fn_scalars(spark: SparkSession, d: str) -> DataFrame:
    """The scalar families of the model: text, hashes, encodings, dates, bits, lists, maps, JSON."""
    r = CommitLog(spark, d).revisions
    name = F.concat_ws("-", "branch", F.col("k").cast("string"))
    return r.select(
        "backing", "revid",
        F.upper("branch").alias("f_upper"), F.substring("branch", 1, 2).alias("f_prefix"), F.startswith("branch", F.lit("v")).alias("f_starts"),
        F.sha1(F.encode(name, "utf-8")).alias("f_sha1"), F.base64(F.encode(name, "utf-8")).alias("f_base64"), F.lower(F.hex(F.encode(name, "utf-8"))).alias("f_hex"),
        millis("ts").alias("f_ms"),
        F.col("k").bitwiseAND(15).alias("f_mask"), F.element_at(F.split(name, "-"), 2).alias("f_split"),
        F.array_join(F.slice(F.sequence(F.lit(1), F.lit(9)), F.col("k") % 5 + 1, 3).cast("array<string>"), ",").alias("f_slice"),
        F.get_json_object(F.to_json(F.struct("k", "branch")), "$.branch").alias("f_json"), F.round(F.col("k") / 7, 3).alias("f_round"),
    )


_W = "w AS (SELECT backing AS proot, branch, revid, item, k, branch AS kind FROM revisions)"
_R = _W + ", refs AS (SELECT proot, revid, item, CASE k % 3 WHEN 0 THEN 6 ELSE 5 END AS type, CASE WHEN k % 3 < 2 THEN (k * 3 + 1) % 20 END AS dst_item, CASE WHEN k % 3 = 2 THEN k % (SELECT max(proot) + 1 FROM w) END AS dst_proot FROM w)"
_RES = "res AS (SELECT r.backing, r.revid, r.rev, p.rev AS parent_rev, q.rev AS merge_rev, r.branch FROM revisions r LEFT JOIN revisions p ON p.backing = r.backing AND p.revid = r.parent LEFT JOIN revisions q ON q.backing = r.backing AND q.revid = r.merge_parent)"
_ST = "st AS (SELECT * FROM (SELECT c.proot, c.branch, r.item, r.k, row_number() OVER (PARTITION BY c.proot, c.branch, r.item ORDER BY c.depth) AS n FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid) WHERE n = 1)"

QUERIES = {
    "src_1_open_store": src_1, "src_2_live_roots": src_2, "src_3_deleted_roots": src_3, "src_4_root_info": src_4, "src_5_root_of_branch": src_5, "src_6_branch_head": src_6, "src_7_backing_stores": src_7, "src_8_backing_of_root": src_8,
    "src_9_single_revision": src_9, "src_10_all_revisions": src_10, "src_11_root_item": src_11, "src_12_branches_by_metadata": src_12, "src_13_used_range": src_13, "src_14_revision_ids": src_14, "src_15_has_revision": src_15,
    "src_16_sizes": src_16, "src_17_file_statistics": src_17, "src_18_report": src_18, "src_19_branch_sets": src_19, "snk_3_fold_actions": snk_3, "snk_4_last_current": snk_4,
    "prj_1_attributes": prj_1, "prj_2_as_list": prj_2, "prj_3_composites": prj_3, "prj_4_inner_references": prj_4, "prj_5_all_inner": prj_5, "prj_6_referenced_roots": prj_6, "prj_7_attachments": prj_7, "prj_8_text_content": prj_8, "prj_9_restricted_state": prj_9,
    "flt_1_predicate": flt_1, "flt_2_smart_group": flt_2, "flt_3_by_identifier": flt_3, "flt_4_libraries": flt_4, "flt_5_graph_validity": flt_5, "flt_6_type_validity": flt_6, "flt_7_violations": flt_7, "flt_8_glob": flt_8,
    "join_1_fan_out": join_1, "join_2_heads_of_backing": join_2, "join_3_orphan_backings": join_3, "join_4_delta_on_garbage": join_4, "join_5_track_state": join_5, "join_6_command_parent": join_6, "join_7_scalar_subquery": join_7, "join_8_scalar_lookup": join_8,
    "agg_1_counts_having": agg_1, "agg_2_distinct": agg_2, "agg_3_group_lists": agg_3, "agg_4_argmax": agg_4, "sort_1_descending": sort_1, "lim_1_first_row": lim_1, "set_1_value_sets": set_1, "set_2_revision_sets": set_2, "fn_scalars": fn_scalars,
}
SQL = {
    "src_1_open_store": f"{M} SELECT 'revisions' AS name, count(*) AS n_rows FROM revisions UNION ALL SELECT 'branches', count(*) FROM branches UNION ALL SELECT 'proots', count(*) FROM proots",
    "src_2_live_roots": f"{M} SELECT proot FROM proots WHERE NOT deleted",
    "src_3_deleted_roots": f"{M} SELECT proot FROM proots WHERE deleted",
    "src_4_root_info": f"{M} SELECT p.proot, p.current_branch, p.deleted, count(b.branch) AS n_branches, coalesce(string_agg(b.branch, ',' ORDER BY b.branch), '') AS branches FROM proots p LEFT JOIN branches b ON b.proot = p.proot GROUP BY 1, 2, 3",
    "src_5_root_of_branch": f"{M} SELECT branch, proot FROM branches WHERE branch = 'view' AND head = 60",
    "src_6_branch_head": f"{M} SELECT branch, head FROM branches WHERE proot = 7",
    "src_7_backing_stores": f"{M} SELECT DISTINCT backing FROM proots",
    "src_8_backing_of_root": f"{M} SELECT proot, backing FROM proots",
    "src_9_single_revision": f"{M}, {_RES} SELECT * FROM res WHERE revid = 10",
    "src_10_all_revisions": f"{M}, {_RES} SELECT * FROM res",
    "src_11_root_item": f"{M} SELECT p.proot, r.item AS root_item FROM proots p JOIN revisions r ON r.backing = p.backing AND r.revid = 0",
    "src_12_branches_by_metadata": f"{M} SELECT proot, branch FROM branches WHERE parent_branch = 'view'",
    "src_13_used_range": f"{M} SELECT backing, min(revid) AS low, max(revid) AS high, count(*) AS used, max(revid) - min(revid) + 1 AS dense FROM revisions GROUP BY 1",
    "src_14_revision_ids": f"{M} SELECT rev, backing, revid FROM revisions",
    "src_15_has_revision": f"{M} SELECT backing, bool_or(revid = 65) AS has_revid FROM revisions GROUP BY 1",
    "src_16_sizes": f"{M} SELECT p.proot, s.n AS export_size, CASE WHEN p.proot = p.backing THEN s.n ELSE 0 END AS used_size FROM proots p JOIN (SELECT backing, CAST(sum(length(CAST(k AS VARCHAR)) + length(branch)) AS BIGINT) AS n FROM revisions GROUP BY 1) s ON s.backing = p.backing",
    "src_18_report": f"{M} SELECT 'backing ' || backing || ' revisions ' || count(*) || ' newest ' || max(revid) AS line, backing FROM revisions GROUP BY backing",
    "src_19_branch_sets": f"{M} SELECT proot, count(*) AS n_all, count(*) FILTER (WHERE NOT deleted) AS n_live, count(*) FILTER (WHERE deleted) AS n_deleted FROM branches GROUP BY 1",
    "snk_3_fold_actions": f"{M} SELECT proot, branch, arg_max(new, seq) AS current, any_value(last_old) AS previous, count(*) AS n_actions FROM (SELECT *, last_value(old) OVER (PARTITION BY proot, branch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_old FROM commands) GROUP BY 1, 2",
    "snk_4_last_current": f"{M} SELECT (seq - 1) // 100 AS txn, proot, branch, arg_max(new, seq) AS last_set FROM commands GROUP BY 1, 2, 3",
    "prj_1_attributes": f"{M}, {_W} SELECT proot, revid, 'k' AS attr, 1 AS type, CAST(k AS VARCHAR) AS val FROM w UNION ALL SELECT proot, revid, 'kind', 3, kind FROM w",
    "prj_2_as_list": f"{M}, {_W}, l AS (SELECT proot, revid, CASE WHEN k % 2 = 0 THEN list_sort(list_distinct([k % 5, k % 3])) WHEN k % 4 = 0 THEN [] ELSE [k] END AS v FROM w) SELECT proot, revid, CAST(len(v) AS BIGINT) AS n_values, array_to_string(v, ',') AS list FROM l",
    "prj_3_composites": f"{M}, {_R} SELECT DISTINCT proot, item, dst_item FROM refs WHERE type = 6",
    "prj_4_inner_references": f"{M}, {_R} SELECT DISTINCT proot, item, dst_item FROM refs WHERE type = 5 AND dst_proot IS NULL",
    "prj_5_all_inner": f"{M}, {_R} SELECT DISTINCT proot, item, dst_item FROM refs WHERE dst_item IS NOT NULL",
    "prj_6_referenced_roots": f"{M}, {_R} SELECT proot, revid, dst_proot FROM refs WHERE dst_proot IS NOT NULL",
    "prj_7_attachments": "SELECT page_id, sha1(html) AS attachment FROM pages",
    "prj_8_text_content": f"{M}, {_W} SELECT proot, revid, kind || ' item' || item AS content FROM w",
    "prj_9_restricted_state": f"{M}, {_ST} SELECT proot, branch, item, k FROM st WHERE item IN (1, 2, 3)",
    "flt_1_predicate": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderpriority = '1-URGENT'",
    "flt_2_smart_group": "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000",
    "flt_3_by_identifier": "SELECT p_partkey, p_name FROM part WHERE p_name = 'large ring' ORDER BY p_partkey LIMIT 1",
    "flt_4_libraries": f"{M} SELECT l.library, count(*) AS n_members FROM branches b JOIN (VALUES ('view', 'bookmark'), ('click', 'note'), ('purchase', 'music')) l(branch, library) USING (branch) JOIN proots p ON p.proot = b.proot AND NOT p.deleted WHERE NOT b.deleted GROUP BY 1",
    "flt_5_graph_validity": f"{M}, {_ST}, t AS (SELECT st.* FROM st JOIN proots p ON p.proot = st.proot AND p.current_branch = st.branch) SELECT t.proot, t.item, (t.k * 3 + 1) % 20 AS dst FROM t WHERE t.k % 3 < 2 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.proot = t.proot AND u.item = (t.k * 3 + 1) % 20)",
    "flt_6_type_validity": "SELECT CAST(x AS INT) AS type, (x & 15) BETWEEN 1 AND 7 AND (x & 240) IN (0, 16, 32) AS valid FROM (SELECT unnest(range(0, 256)) AS x)",
    "flt_7_violations": "SELECT property, count(*) AS n_violations FROM (SELECT 'discount' AS property FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'quantity' FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'tax' FROM lineitem WHERE l_tax < 0) GROUP BY 1",
    "flt_8_glob": f"{M} SELECT DISTINCT track FROM commands WHERE track GLOB 'user.1?.*e*'",
    "join_1_fan_out": f"{M} SELECT p.proot, r.revid FROM revisions r JOIN proots p ON p.backing = r.backing WHERE r.k = 42",
    "join_2_heads_of_backing": f"{M} SELECT p.backing, p.proot, b.branch, r.rev FROM proots p JOIN branches b ON b.proot = p.proot JOIN revisions r ON r.backing = p.backing AND r.revid = b.head",
    "join_3_orphan_backings": f"{M} SELECT backing FROM proots GROUP BY backing HAVING bool_and(deleted)",
    "join_4_delta_on_garbage": f"{M} SELECT backing, revid, parent FROM revisions WHERE parent < 20 AND revid >= 20 AND revid % 50 <> 0",
    "join_5_track_state": f"{M}, h AS (SELECT track, max(seq) AS head, max(CASE WHEN k % 2 = 0 THEN seq END) AS current FROM commands GROUP BY 1) SELECT h.track, h.head, h.current, c.new AS current_revision FROM h JOIN commands d ON d.track = h.track AND d.seq = h.head LEFT JOIN commands c ON c.track = h.track AND c.seq = h.current WHERE d.k % 13 <> 0",
    "join_6_command_parent": f"{M} SELECT c.seq, p.seq AS parent_seq FROM commands c LEFT JOIN commands p ON p.proot = c.proot AND p.new = c.old",
    "join_7_scalar_subquery": f"{M} SELECT r.backing, count(*) AS n, max(t.top) AS top FROM revisions r JOIN (SELECT backing, max(revid) AS top FROM revisions WHERE branch = 'view' GROUP BY 1) t USING (backing) WHERE r.revid <= t.top GROUP BY 1",
    "join_8_scalar_lookup": f"{M} SELECT b.proot, b.branch, coalesce(c.seq, -1) AS head_id FROM branches b LEFT JOIN commands c ON c.proot = b.proot AND c.new = b.head",
    "agg_1_counts_having": f"{M} SELECT backing, branch, count(*) AS n, max(revid) AS high, min(revid) AS low, CAST(sum(k) AS BIGINT) AS sum_k FROM revisions GROUP BY 1, 2 HAVING count(*) > 10",
    "agg_2_distinct": f"{M} SELECT DISTINCT backing, branch FROM revisions",
    "agg_3_group_lists": f"{M} SELECT backing, string_agg(CAST(proot AS VARCHAR), ',' ORDER BY proot) AS proots FROM proots GROUP BY 1",
    "agg_4_argmax": f"{M} SELECT proot, arg_max(track, seq) AS last_track, max(seq) AS last_seq FROM commands GROUP BY 1",
    "sort_1_descending": f"{M} SELECT backing, revid, rev FROM revisions ORDER BY backing, revid DESC",
    "lim_1_first_row": f"{M} SELECT backing, revid FROM revisions WHERE backing = 5 AND branch = 'view' ORDER BY revid DESC LIMIT 1",
    "set_1_value_sets": f"{M}, e AS (SELECT backing AS proot, revid, unnest([k % 5, k % 3, 7]) AS x, item % 5 AS b FROM revisions), n AS (SELECT DISTINCT * FROM e), u AS (SELECT proot, revid, x FROM n UNION SELECT proot, revid, b FROM n) SELECT p.proot, p.revid, p.minus, p.common, q.either FROM (SELECT proot, revid, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (WHERE x <> b AND x <> 7), '') AS minus, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (WHERE x = b OR x = 7), '') AS common FROM n GROUP BY 1, 2) p JOIN (SELECT proot, revid, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS either FROM u GROUP BY 1, 2) q USING (proot, revid)",
    "set_2_revision_sets": f"{M} (SELECT backing, revid FROM revisions WHERE k % 2 = 0 UNION SELECT backing, revid FROM revisions WHERE revid < 5) EXCEPT SELECT backing, revid FROM revisions WHERE k % 3 = 0",
    "fn_scalars": f"{M} SELECT backing, revid, upper(branch) AS f_upper, substr(branch, 1, 2) AS f_prefix, starts_with(branch, 'v') AS f_starts, sha1(branch || '-' || k) AS f_sha1, base64(encode(branch || '-' || k)) AS f_base64, lower(hex(branch || '-' || k)) AS f_hex, CAST(round_even(epoch_us(ts) / 1000.0, 0) AS BIGINT) AS f_ms, k & 15 AS f_mask, split_part(branch || '-' || k, '-', 2) AS f_split, array_to_string(range(1, 10)[k % 5 + 1 : k % 5 + 3], ',') AS f_slice, branch AS f_json, round(k / 7.0, 3) AS f_round FROM revisions",
}
