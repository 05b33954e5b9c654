"""Queries on undo timelines and history compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.operators import tracks as T
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog


def _current(c: DataFrame) -> DataFrame:
    """Each track's current command: its last one with an even number k."""
    return c.groupBy("track").agg(F.max(F.when(F.col("k") % 2 == 0, F.col("seq"))).alias("current"), F.max("seq").alias("head"))


def trk_1(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    s = _current(c).join(c.select("track", F.col("seq").alias("head"), (F.col("k") % 13 == 0).alias("gone")), ["track", "head"])
    return s.select("track", F.when(~F.col("gone"), F.col("head")).alias("head"), F.when(~F.col("gone"), F.col("current")).alias("current"))


def trk_2(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    return T.positions(c, _current(c).select("track", "current"), "user.1*")


def trk_3(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    return _current(c).withColumn("pattern", F.concat(F.regexp_extract("track", "^user[.][0-9]+", 0), F.lit(".*"))).groupBy("pattern").agg(F.max("current").alias("current"), F.max_by("track", "current").alias("track"))


def trk_4(spark: SparkSession, d: str) -> DataFrame:
    """Going to the oldest node of each track: how many commands are undone, from which to which."""
    c = CommitLog(spark, d).commands
    p = c.join(_current(c).select("track", "current"), "track").where("seq <= current")
    return p.groupBy("track").agg(F.count("*").alias("n_undone"), F.max("seq").alias("first_undone"), F.min("seq").alias("last_undone"))


def trk_4_redo(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    p = c.join(_current(c).select("track", "current"), "track").where("current is null or seq > current")
    return p.groupBy("track").agg(F.count("*").alias("n_redone"), F.min("seq").alias("first_redone"), F.max("seq").alias("last_redone"))


def trk_5(spark: SparkSession, d: str) -> DataFrame:
    """Divergent navigation from the trunk's head to every other head of its root: undo to where their chains meet, then redo."""
    m = CommitLog(spark, d)
    p = history.head_paths(m.revisions, m.branches).join(m.proots.select("proot", F.col("current_branch").alias("t")), "proot")
    a = p.where("branch = t").selectExpr("proot", "revid", "depth undo")
    both = p.where("branch <> t").selectExpr("proot", "branch", "revid", "depth redo").join(a, ["proot", "revid"])
    return both.groupBy("proot", "branch").agg(F.min_by("revid", "undo").alias("meets_at"), F.min("undo").alias("n_undo"), F.min("redo").alias("n_redo"))


def trk_6(spark: SparkSession, d: str) -> DataFrame:
    """Inverse of each track as a group: old and new swapped, in reverse order."""
    c = CommitLog(spark, d).commands
    w = Window.partitionBy("track").orderBy(F.desc("seq"))
    return c.select("track", F.row_number().over(w).alias("position"), F.col("new").alias("old"), F.col("old").alias("new"))


def trk_7(spark: SparkSession, d: str) -> DataFrame:
    c = T.with_parents(CommitLog(spark, d).commands)
    return c.where("parent_seq is not null").select("track", "parent_seq", F.col("seq").alias("child_seq"))


def trk_8(spark: SparkSession, d: str) -> DataFrame:
    return T.coalesce_ops(CommitLog(spark, d).commands, ["proot", "branch"]).select("proot", "branch", "old", "new", "first_seq", "n_commands")


def trk_9(spark: SparkSession, d: str) -> DataFrame:
    c = T.with_parents(CommitLog(spark, d).commands)
    return c.select("track", F.col("seq").alias("head"), F.col("seq").alias("current"), F.coalesce("parent_seq", F.lit(-1)).alias("parent"))


def trk_10(spark: SparkSession, d: str) -> DataFrame:
    """Head and current of each track after one undo."""
    c = T.with_parents(CommitLog(spark, d).commands)
    s = _current(c).join(c.select("track", F.col("seq").alias("current"), "parent_seq"), ["track", "current"])
    return s.select("track", "head", F.coalesce("parent_seq", F.lit(-1)).alias("current"))


def trk_11(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of selective undo commands: the undone command, the type and the flag."""
    c = CommitLog(spark, d).commands
    meta = F.to_json(F.create_map(F.lit("base"), F.col("seq").cast("string"), F.lit("type"), F.lit("undo"), F.lit("inversed"), F.lit("true")))
    return c.select("track", "seq", F.get_json_object(meta, "$.base").alias("base"), F.get_json_object(meta, "$.inversed").alias("inversed"))


def trk_12(spark: SparkSession, d: str) -> DataFrame:
    """Which commands apply as they are: those whose old revision is the branch's current one."""
    m = CommitLog(spark, d)
    c = m.commands.join(m.branches.select("proot", "branch", "current"), ["proot", "branch"])
    return c.select("seq", F.col("old").eqNullSafe(F.col("current")).alias("applies_directly"))


def trk_13(spark: SparkSession, d: str) -> DataFrame:
    c = CommitLog(spark, d).commands
    named = F.when(F.col("branch") == "view", "Viewed %s").when(F.col("branch") == "click", "Clicked %s").otherwise("Changed %s")
    return c.select("seq", F.replace(named, F.lit("%s"), F.concat(F.lit("item "), (F.col("k") % 20).cast("string"))).alias("description"))


def trk_14(spark: SparkSession, d: str) -> DataFrame:
    c = T.with_parents(CommitLog(spark, d).commands.where("k % 13 <> 0"))
    return c.select("track", "seq", "parent_seq")


def cmp_1(spark: SparkSession, d: str) -> DataFrame:
    """Branches left after finalising: those flagged go, and all of a deleted root."""
    m = CommitLog(spark, d)
    return m.branches.where("not deleted").join(m.proots.where("deleted").select("proot"), "proot", "left_anti").select("proot", "branch")


def cmp_2(spark: SparkSession, d: str) -> DataFrame:
    """Roots that become compactable: those of listed branches that are flagged deleted."""
    m = CommitLog(spark, d)
    return m.branches.where("branch = 'error' and deleted").select("proot", "backing").distinct()


def cmp_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    live = m.proots.where("not deleted").select("backing")
    return m.proots.select("backing").distinct().join(live, "backing", "left_anti")


def cmp_4(spark: SparkSession, d: str) -> DataFrame:
    """Kept revisions without a live set: first-parent chains of all live heads of the backing store."""
    m = CommitLog(spark, d)
    live = m.branches.where("not deleted").join(m.proots.where("deleted").select("proot"), "proot", "left_anti")
    return history.head_paths(m.revisions, live).select("backing", "revid").distinct()


def cmp_4_range(spark: SparkSession, d: str) -> DataFrame:
    """Kept revisions with a live set (k > 90): the range from the least live one to the newest."""
    r = CommitLog(spark, d).revisions
    low = r.where("k > 90").groupBy("backing").agg(F.min("revid").alias("low"))
    return r.join(low, "backing").where("revid >= low").groupBy("backing").agg(F.min("revid").alias("low"), F.max("revid").alias("high"), F.count("*").alias("n"))


def cmp_5(spark: SparkSession, d: str) -> DataFrame:
    """What survivors whose parent goes (it lies before the least live one, as in cmp_4_kept_range) are rewritten as: full states without unreachable items."""
    r = CommitLog(spark, d).revisions
    low = r.where("k > 90").groupBy("backing").agg(F.min("revid").alias("low"))
    kept = r.join(low, "backing").where("revid >= low")
    gone = r.join(low, "backing").where("revid < low").select("backing", "revid")
    tops = r.where("revid = 0").selectExpr("backing", "item top")
    return T.rewritten(r, kept, gone, tops, "k % 3 < 2", "(k * 3 + 1) % 20").select("backing", "revid", "item", "k")


def cmp_7(spark: SparkSession, d: str) -> DataFrame:
    """Finalising deleted roots: what is left of each backing store."""
    m = CommitLog(spark, d)
    left = m.proots.where("not deleted").groupBy("backing").agg(F.count("*").alias("n_roots"))
    return m.revisions.groupBy("backing").agg(F.count("*").alias("n")).join(left, "backing", "left").selectExpr("backing", "coalesce(n_roots, 0) n_roots", "if(n_roots is null, 0, n) n_revisions")


def cmp_8(spark: SparkSession, d: str) -> DataFrame:
    return T.compaction_plan(CommitLog(spark, d).commands, 1500)


def cmp_9(spark: SparkSession, d: str) -> DataFrame:
    """Tracks after commands up to a number are gone: emptied ones disappear, a lost current command becomes null."""
    c = CommitLog(spark, d).commands
    s = _current(c).where("head > 1500")
    return s.select("track", "head", F.when(F.col("current") > 1500, F.col("current")).alias("current"))


def mig_1(spark: SparkSession, d: str) -> DataFrame:
    """Migration of all revisions to a new version by a handler: k becomes a coarser share, one attribute is added; every twentieth revision is a snapshot."""
    r = CommitLog(spark, d).revisions
    handler = lambda x: x.selectExpr("backing", "revid", "parent", "item", "struct(k div 25 as share, k >= 50 as large) new")
    out = T.migrated(r.select("backing", "revid", "parent", "item", "k"), handler, F.col("revid") % 20 == 0)
    return out.selectExpr("backing", "revid", "item", "new.share", "new.large", "2 version", "is_snapshot")


_CU = "cu AS (SELECT track, max(CASE WHEN k % 2 = 0 THEN seq END) AS current, max(seq) AS head FROM commands GROUP BY 1)"
_WP = "wp AS (SELECT *, lag(seq) OVER (PARTITION BY track ORDER BY seq) AS parent_seq FROM commands)"
_KEPT = "kept AS (SELECT DISTINCT c.backing, c.revid FROM chain c JOIN branches b ON b.proot = c.proot AND b.branch = c.branch AND NOT b.deleted JOIN proots p ON p.proot = c.proot AND NOT p.deleted)"

QUERIES = {
    "trk_1_track_state": trk_1, "trk_2_nodes": trk_2, "trk_3_current_of_pattern": trk_3, "trk_4_undo_list": trk_4, "trk_4_redo_list": trk_4_redo, "trk_5_divergent_navigation": trk_5, "trk_6_inverse": trk_6, "trk_7_children": trk_7, "trk_8_coalesce": trk_8,
    "trk_9_record": trk_9, "trk_10_after_undo": trk_10, "trk_11_selective_metadata": trk_11, "trk_12_direct_or_selective": trk_12, "trk_13_descriptions": trk_13, "trk_14_live_commands": trk_14,
    "cmp_1_finalise_roots": cmp_1, "cmp_2_finalise_branches": cmp_2, "cmp_3_orphan_backings": cmp_3, "cmp_4_kept_chains": cmp_4, "cmp_4_kept_range": cmp_4_range, "cmp_5_rewrites": cmp_5, "cmp_7_finalise_deletions": cmp_7, "cmp_8_plan": cmp_8, "cmp_9_tracks_left": cmp_9, "mig_1_migrate": mig_1,
}
SQL = {
    "trk_1_track_state": f"{M}, {_CU} SELECT cu.track, CASE WHEN c.k % 13 <> 0 THEN cu.head END AS head, CASE WHEN c.k % 13 <> 0 THEN cu.current END AS current FROM cu JOIN commands c ON c.track = cu.track AND c.seq = cu.head",
    "trk_2_nodes": f"{M}, {_CU}, x AS (SELECT c.track, c.seq, c.seq > coalesce(cu.current, 0) AS is_redo FROM commands c JOIN cu USING (track) WHERE track GLOB 'user.1*') SELECT *, CAST(row_number() OVER (PARTITION BY track ORDER BY is_redo, seq) AS INT) AS position FROM x",
    "trk_3_current_of_pattern": f"{M}, {_CU} SELECT regexp_extract(track, '^user[.][0-9]+') || '.*' AS pattern, max(current) AS current, arg_max(track, current) AS track FROM cu GROUP BY 1",
    "trk_4_undo_list": f"{M}, {_CU} SELECT track, count(*) AS n_undone, max(seq) AS first_undone, min(seq) AS last_undone FROM commands JOIN cu USING (track) WHERE seq <= current GROUP BY 1",
    "trk_4_redo_list": f"{M}, {_CU} SELECT track, count(*) AS n_redone, min(seq) AS first_redone, max(seq) AS last_redone FROM commands JOIN cu USING (track) WHERE current IS NULL OR seq > current GROUP BY 1",
    "trk_5_divergent_navigation": f"{M} SELECT b.proot, b.branch, arg_min(a.revid, a.depth) AS meets_at, CAST(min(a.depth) AS BIGINT) AS n_undo, CAST(min(b.depth) AS BIGINT) AS n_redo "
    "FROM chain b JOIN proots p ON p.proot = b.proot AND p.current_branch <> b.branch JOIN chain a ON a.proot = b.proot AND a.branch = p.current_branch AND a.revid = b.revid GROUP BY 1, 2",
    "trk_6_inverse": f"{M} SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS INT) AS position, new AS old, old AS new FROM commands",
    "trk_7_children": f"{M}, {_WP} SELECT track, parent_seq, seq AS child_seq FROM wp WHERE parent_seq IS NOT NULL",
    "trk_8_coalesce": f"{M}, b AS (SELECT *, CASE WHEN lag(seq) OVER w IS NOT NULL AND old IS NOT DISTINCT FROM lag(new) OVER w THEN 0 ELSE 1 END AS brk FROM commands WINDOW w AS (PARTITION BY proot, branch ORDER BY seq)), i AS (SELECT *, sum(brk) OVER (PARTITION BY proot, branch ORDER BY seq) AS island FROM b) SELECT proot, branch, first(old ORDER BY seq) AS old, last(new ORDER BY seq) AS new, min(seq) AS first_seq, count(*) AS n_commands FROM i GROUP BY proot, branch, island",
    "trk_9_record": f"{M}, {_WP} SELECT track, seq AS head, seq AS current, coalesce(parent_seq, -1) AS parent FROM wp",
    "trk_10_after_undo": f"{M}, {_CU}, {_WP} SELECT cu.track, cu.head, coalesce(wp.parent_seq, -1) AS current FROM cu JOIN wp ON wp.track = cu.track AND wp.seq = cu.current",
    "trk_11_selective_metadata": f"{M} SELECT track, seq, CAST(seq AS VARCHAR) AS base, 'true' AS inversed FROM commands",
    "trk_12_direct_or_selective": f"{M} SELECT c.seq, c.old IS NOT DISTINCT FROM b.current AS applies_directly FROM commands c JOIN branches b ON b.proot = c.proot AND b.branch = c.branch",
    "trk_13_descriptions": f"{M} SELECT seq, CASE branch WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' ELSE 'Changed' END || ' item ' || (k % 20) AS description FROM commands",
    "trk_14_live_commands": f"{M}, l AS (SELECT track, seq, lag(seq) OVER (PARTITION BY track ORDER BY seq) AS parent_seq FROM commands WHERE k % 13 <> 0) SELECT * FROM l",
    "cmp_1_finalise_roots": f"{M} SELECT b.proot, b.branch FROM branches b JOIN proots p ON p.proot = b.proot AND NOT p.deleted WHERE NOT b.deleted",
    "cmp_2_finalise_branches": f"{M} SELECT DISTINCT proot, backing FROM branches WHERE branch = 'error' AND deleted",
    "cmp_3_orphan_backings": f"{M} SELECT DISTINCT backing FROM proots EXCEPT SELECT backing FROM proots WHERE NOT deleted",
    "cmp_4_kept_chains": f"{M}, {_KEPT} SELECT * FROM kept",
    "cmp_4_kept_range": f"{M}, l AS (SELECT backing, min(revid) AS low FROM revisions WHERE k > 90 GROUP BY 1) SELECT r.backing, min(r.revid) AS low, max(r.revid) AS high, count(*) AS n FROM revisions r JOIN l ON l.backing = r.backing AND r.revid >= l.low GROUP BY 1",
    "cmp_5_rewrites": f"""{M}, low AS (SELECT backing, min(revid) AS low FROM revisions WHERE k > 90 GROUP BY 1),
sv AS (SELECT r.backing, r.revid AS start FROM revisions r JOIN low USING (backing) WHERE r.revid >= low AND r.parent < low),
ch AS (SELECT s.backing, s.start, r.revid, r.parent, 0 AS depth FROM sv s JOIN revisions r ON r.backing = s.backing AND r.revid = s.start
  UNION ALL SELECT c.backing, c.start, r.revid, r.parent, c.depth + 1 FROM ch c JOIN revisions r ON r.backing = c.backing AND r.revid = c.parent),
st AS (SELECT * FROM (SELECT c.backing, c.start, r.item, r.k, row_number() OVER (PARTITION BY c.backing, c.start, r.item ORDER BY c.depth) AS n
  FROM ch c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid) WHERE n = 1),
e AS (SELECT backing, start, item AS src, (k * 3 + 1) % 20 AS dst FROM st WHERE k % 3 < 2),
reach AS (SELECT s.backing, s.start, r.item AS node FROM sv s JOIN revisions r ON r.backing = s.backing AND r.revid = 0
  UNION SELECT x.backing, x.start, e.dst FROM reach x JOIN e ON e.backing = x.backing AND e.start = x.start AND e.src = x.node)
SELECT st.backing, st.start AS revid, st.item, st.k FROM st JOIN reach r ON r.backing = st.backing AND r.start = st.start AND r.node = st.item""",
    "cmp_7_finalise_deletions": f"{M}, l AS (SELECT backing, count(*) AS n_roots FROM proots WHERE NOT deleted GROUP BY 1), n AS (SELECT backing, count(*) AS n FROM revisions GROUP BY 1) SELECT n.backing, coalesce(l.n_roots, 0) AS n_roots, CASE WHEN l.n_roots IS NULL THEN 0 ELSE n.n END AS n_revisions FROM n LEFT JOIN l USING (backing)",
    "cmp_8_plan": f"{M}, nm AS (SELECT proot, seq, new AS revid, TRUE AS is_new FROM commands UNION ALL SELECT proot, seq, old, FALSE FROM commands WHERE old IS NOT NULL), b AS (SELECT proot, revid, bool_or(seq > 1500) AS live FROM nm GROUP BY 1, 2), s AS (SELECT proot, bool_or(live) AS any_live FROM b GROUP BY 1), nd AS (SELECT proot, arg_max(revid, seq) AS newest FROM nm WHERE is_new AND seq <= 1500 GROUP BY 1) SELECT b.proot, b.revid, b.live OR (NOT s.any_live AND b.revid IS NOT DISTINCT FROM nd.newest) AS live FROM b JOIN s USING (proot) LEFT JOIN nd USING (proot)",
    "cmp_9_tracks_left": f"{M}, {_CU} SELECT track, head, CASE WHEN current > 1500 THEN current END AS current FROM cu WHERE head > 1500",
    "mig_1_migrate": f"""{M}, anc AS (SELECT backing, revid AS start, revid, parent, 0 AS depth FROM revisions
  UNION ALL SELECT a.backing, a.start, r.revid, r.parent, a.depth + 1 FROM anc a JOIN revisions r ON r.backing = a.backing AND r.revid = a.parent),
w AS (SELECT a.backing, a.start, a.depth, r.item, CAST(r.k // 25 AS BIGINT) AS share, r.k >= 50 AS large FROM anc a JOIN revisions r ON r.backing = a.backing AND r.revid = a.revid),
st AS (SELECT *, row_number() OVER (PARTITION BY backing, start, item ORDER BY depth) AS n FROM w),
pv AS (SELECT *, row_number() OVER (PARTITION BY backing, start, item ORDER BY depth) AS n FROM w WHERE depth > 0)
SELECT backing, start AS revid, item, share, large, 2 AS version, TRUE AS is_snapshot FROM st WHERE n = 1 AND start % 20 = 0
UNION ALL SELECT w.backing, w.start, w.item, w.share, w.large, 2, FALSE FROM w LEFT JOIN pv ON pv.backing = w.backing AND pv.start = w.start AND pv.item = w.item AND pv.n = 1
WHERE w.depth = 0 AND w.start % 20 <> 0 AND (pv.n IS NULL OR pv.share <> w.share OR pv.large <> w.large)""",
}
