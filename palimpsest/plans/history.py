"""Queries on branch histories and the revision graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import millis
from palimpsest.operators import history, recurse, state
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog


def snap_1(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return state.state_at(m.revisions, m.branches.select("proot", "branch", "backing", F.col("head").alias("start"))).select("proot", "branch", "item", "value", "k")


def snap_2(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    starts = m.branches.select("proot", "branch", "backing", F.col("head").alias("start"), (F.col("head") - 5).alias("base"))
    return state.state_at(m.revisions, starts, "base").select("proot", "branch", "item", "k", "revid")


def snap_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    live = m.branches.where("not deleted").select("proot", "branch", "backing", F.col("current").alias("start"))
    return state.state_at(m.revisions, live).select("proot", "branch", "item", "k", "kind")


def _trunk_and_branches(m: CommitLog) -> tuple[DataFrame, DataFrame]:
    """State of the trunk's head repeated for each other branch of the root, and the branch's own state."""
    s = state.state_at(m.revisions, m.branches.select("proot", "branch", "backing", F.col("head").alias("start"))).select("proot", "branch", "item", "k", "kind")
    trunk = m.proots.select("proot", F.col("current_branch").alias("branch"))
    others = m.branches.select("proot", "branch").join(trunk, ["proot", "branch"], "left_anti")
    base = s.join(trunk, ["proot", "branch"]).drop("branch").join(others, "proot").select("proot", "branch", "item", "k", "kind")
    return base, s.join(others, ["proot", "branch"], "left_semi")


def snap_4(spark: SparkSession, d: str) -> DataFrame:
    base, own = _trunk_and_branches(CommitLog(spark, d))
    return state.overlay(base, own, ["proot", "branch", "item"])


def snap_5(spark: SparkSession, d: str) -> DataFrame:
    base, own = _trunk_and_branches(CommitLog(spark, d))
    return state.overlay(base, own.where("k % 2 = 0"), ["proot", "branch", "item"])


def snap_6(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    cols = ["proot", "branch", "item", "k", "kind"]
    a = state.state_at(m.revisions, m.branches.select("proot", "branch", "backing", F.col("head").alias("start"))).select(*cols)
    b = state.state_at(m.revisions, m.branches.select("proot", "branch", "backing", F.col("current").alias("start"))).select(*cols)
    return state.same_graph(a, b, ["proot", "branch", "item"])


def snap_7(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.head_paths(m.revisions, m.branches, limit=3).select("proot", "branch", "revid", "depth")


def snap_8(spark: SparkSession, d: str) -> DataFrame:
    base, own = _trunk_and_branches(CommitLog(spark, d))
    old = base.select("proot", "branch", "item", F.struct("k", "kind").alias("old"))
    return own.join(old, ["proot", "branch", "item"], "left").where(~F.struct("k", "kind").eqNullSafe(F.col("old"))).select("proot", "branch", "item", "k", "kind")


def hist_1(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.branch_history(history.head_paths(m.revisions, m.branches), m.revisions)


def hist_2(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.branch_history(history.head_paths(m.revisions, m.branches), m.revisions, True)


def hist_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.divergent_history(m.revisions, m.branches, True)


def hist_3_only(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.divergent_history(m.revisions, m.branches, False)


def hist_4(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    redo = m.branches.where("current < head")
    paths = history.head_paths(m.revisions, redo).join(redo.select("proot", "branch", "current"), ["proot", "branch"])
    return paths.where("revid > current").select("proot", "branch", "revid", "depth")


def hist_5(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    w = Window.partitionBy("proot", "branch").orderBy(F.desc("depth"))
    return history.head_paths(m.revisions, m.branches).withColumn("position", F.row_number().over(w).cast("long")).select("proot", "branch", "revid", "position")


def hist_6(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    paths = history.head_paths(m.revisions, m.branches)
    first = paths.groupBy("proot", "branch").agg(F.max_by("revid", "depth").alias("first_revision"))
    own = history.branch_history(paths, m.revisions).groupBy("proot", "branch").agg(F.min("revid").alias("initial_revision"))
    return first.join(own, ["proot", "branch"], "left")


def hist_7(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    ts = m.revisions.select("backing", F.col("revid"), millis("ts").alias("ms"))
    live = m.branches.where("not deleted").join(ts.withColumnRenamed("revid", "head"), ["backing", "head"]).groupBy("proot").agg(F.max("ms").alias("modified_ms"))
    made = m.proots.join(ts.where("revid = 0").select("backing", F.col("ms").alias("created_ms")), "backing")
    return made.join(live, "proot", "left").selectExpr("proot", "created_ms", "modified_ms", "proot <> backing is_copy", "if(proot <> backing, backing, null) parent_root")


def hist_8(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    up = m.revisions.select("backing", F.col("revid").alias("current"), F.col("parent").alias("undo_revision"))
    paths = history.head_paths(m.revisions, m.branches).join(m.revisions.select("backing", "revid", "parent"), ["backing", "revid"])
    redo = paths.select("proot", "branch", F.col("parent").alias("current"), F.col("revid").alias("redo_revision"))
    return m.branches.join(up, ["backing", "current"]).join(redo, ["proot", "branch", "current"], "left").select("proot", "branch", "undo_revision", "redo_revision")


def hist_9(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    w = Window.partitionBy("proot", "branch").orderBy(F.desc("depth"))
    return history.head_paths(m.revisions, m.branches).select("proot", "branch", "revid", F.lag("revid").over(w).alias("previous_node"), F.lead("revid").over(w).alias("next_node"))


def hist_10(spark: SparkSession, d: str) -> DataFrame:
    """Set current to the revision three before the head: the head moves unless that is an ancestor of it."""
    m = CommitLog(spark, d)
    b = m.branches.select("proot", "branch", "head", F.greatest(F.col("head") - 3, F.lit(0)).alias("to"))
    on = history.head_paths(m.revisions, m.branches).select("proot", "branch", F.col("revid").alias("to"), F.lit(True).alias("is_ancestor"))
    out = b.join(on, ["proot", "branch", "to"], "left")
    return out.selectExpr("proot", "branch", "to new_current", "if(is_ancestor, head, to) new_head")


def hist_11(spark: SparkSession, d: str) -> DataFrame:
    """Replay of commits: after each one, the branch's head and the head it leaves behind as divergent."""
    m = CommitLog(spark, d)
    own = Window.partitionBy("backing", "branch").orderBy("revid")
    r = m.revisions.withColumn("old_head", F.lag("revid").over(own))
    return r.selectExpr("backing", "branch", "revid new_head", "old_head", "coalesce(old_head <> parent, false) leaves_divergent")


def hist_12(spark: SparkSession, d: str) -> DataFrame:
    """Where a branch or copy may start: revisions equal to or before the head of their branch."""
    m = CommitLog(spark, d)
    return history.head_paths(m.revisions, m.branches).groupBy("proot", "branch").agg(F.count("*").alias("allowed_starts"), F.max("revid").alias("newest_start"))


def _heads(m: CommitLog) -> DataFrame:
    return m.branches.where("proot = backing").select("backing", F.col("head").alias("start"))


def dag_1(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.ancestors(m.revisions, _heads(m)).groupBy("backing", "start").agg(F.count("*").alias("n_ancestors"), F.sum("node").alias("sum_ancestors"))


def _pairs(m: CommitLog) -> DataFrame:
    """Trunk head against every other branch head of its root."""
    own = m.branches.where("proot = backing")
    trunk = m.proots.where("proot = backing").select("proot", F.col("current_branch").alias("branch")).join(own, ["proot", "branch"]).select("proot", F.col("head").alias("a"), F.col("branch").alias("t"))
    return own.join(trunk, "proot").where("branch <> t").select("backing", "a", F.col("head").alias("b"))


def dag_2(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.common_ancestor(m.revisions, _pairs(m)).select("backing", "a", "b", "ancestor")


def dag_3(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    on = recurse.chains(m.revisions.select("backing", "revid", "parent"), _heads(m)).select("backing", F.col("start").alias("b"), F.col("revid").alias("a"), F.lit(True).alias("yes"))
    return _pairs(m).join(on, ["backing", "a", "b"], "left").select("backing", "a", "b", F.coalesce("yes", F.lit(False)).alias("is_ancestor"))


def dag_4(spark: SparkSession, d: str) -> DataFrame:
    """Path from the chain's fourth revision (exclusive) to the head (inclusive), oldest first."""
    m = CommitLog(spark, d)
    p = recurse.chains(m.revisions.select("backing", "revid", "parent"), _heads(m), 4)
    from_ = p.where("depth = 4").select("backing", "start", F.col("revid").alias("begin"))
    return p.where("depth < 4").join(from_, ["backing", "start"]).selectExpr("backing", "begin", "start as stop", "revid", "3 - depth position")


def dag_5(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    trunk = m.proots.where("proot = backing").select("proot", F.col("current_branch").alias("branch")).join(m.branches, ["proot", "branch"]).select("backing", F.col("head").alias("start"))
    known = history.ancestors(m.revisions, trunk).select("backing", "node")
    return history.ancestors(m.revisions, _heads(m)).join(known, ["backing", "node"], "left_anti").select("backing", "node").distinct()


def dag_6(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return m.revisions.selectExpr("backing", "revid", "parent", "merge_parent")


def dag_7(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    return history.topological(m.revisions)


def dag_8(spark: SparkSession, d: str) -> DataFrame:
    """An insertion order: by level, then number."""
    m = CommitLog(spark, d)
    w = Window.partitionBy("backing").orderBy("level", "node")
    return history.topological(m.revisions).withColumn("position", F.row_number().over(w).cast("long")).select("backing", "node", "position")


def dag_9(spark: SparkSession, d: str) -> DataFrame:
    """Items that contain themselves through composite references of the trunk's state."""
    m = CommitLog(spark, d)
    s = snap_1(spark, d).join(m.proots.select("proot", F.col("current_branch").alias("branch")), ["proot", "branch"])
    edges = s.where("k % 3 = 0").selectExpr("proot", "item src", "(k * 3 + 1) % 20 dst")
    starts = edges.selectExpr("proot", "dst start").distinct()
    inside = recurse.closure(edges, starts, "proot").select("proot", F.col("start").alias("dst"), F.col("node").alias("src"))
    return edges.join(inside, ["proot", "src", "dst"]).select("proot", F.col("src").cast("long").alias("item")).distinct()


_STATE = "near AS (SELECT c.proot, c.branch, r.item, r.value, r.k, r.branch AS kind, r.revid, row_number() OVER (PARTITION BY c.proot, c.branch, r.item ORDER BY c.depth) AS n FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid), heads AS (SELECT * FROM near WHERE n = 1)"
_CUR = "cc AS (SELECT b.proot, b.branch, b.backing, r.revid, r.parent, 0 AS depth FROM branches b JOIN revisions r ON r.backing = b.backing AND r.revid = b.current UNION ALL SELECT c.proot, c.branch, c.backing, r.revid, r.parent, c.depth + 1 FROM cc c JOIN revisions r ON r.backing = c.backing AND r.revid = c.parent), currents AS (SELECT * FROM (SELECT c.proot, c.branch, r.item, r.k, r.branch AS kind, row_number() OVER (PARTITION BY c.proot, c.branch, r.item ORDER BY c.depth) AS n FROM cc c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid) WHERE n = 1)"
_SIDES = _STATE + ", main AS (SELECT proot, current_branch AS branch FROM proots), others AS (SELECT b.proot, b.branch FROM branches b WHERE NOT EXISTS (SELECT 1 FROM main WHERE main.proot = b.proot AND main.branch = b.branch)), base AS (SELECT o.proot, o.branch, h.item, h.k, h.kind FROM heads h JOIN main USING (proot, branch) JOIN others o ON o.proot = h.proot), mine AS (SELECT h.proot, h.branch, h.item, h.k, h.kind FROM heads h JOIN others USING (proot, branch))"
_CLOSE = "edges AS (SELECT backing, revid AS src, parent AS dst FROM revisions WHERE parent IS NOT NULL UNION SELECT backing, revid, merge_parent FROM revisions WHERE merge_parent IS NOT NULL), starts AS (SELECT backing, head AS start FROM branches WHERE proot = backing), closed AS (SELECT backing, start, start AS node FROM starts UNION SELECT c.backing, c.start, e.dst FROM closed c JOIN edges e ON e.backing = c.backing AND e.src = c.node)"
_PAIR = "pairs AS (SELECT o.backing, t.head AS a, o.head AS b FROM own o JOIN trunk x ON x.proot = o.proot JOIN own t ON t.proot = o.proot AND t.branch = x.branch WHERE o.branch <> x.branch)"
_HIST = "onb AS (SELECT c.*, r.branch AS on_branch FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid), stops AS (SELECT proot, branch, min(depth) AS stop FROM onb WHERE on_branch <> branch GROUP BY 1, 2), listed AS (SELECT o.proot, o.branch, o.revid, o.parent FROM onb o LEFT JOIN stops s ON s.proot = o.proot AND s.branch = o.branch WHERE s.stop IS NULL OR o.depth < s.stop)"
_LEVELS = "edges AS (SELECT backing, revid AS src, parent AS dst FROM revisions WHERE parent IS NOT NULL UNION SELECT backing, revid, merge_parent FROM revisions WHERE merge_parent IS NOT NULL), lv AS (SELECT backing, revid AS node, 0 AS level FROM revisions UNION SELECT l.backing, e.src, l.level + 1 FROM lv l JOIN edges e ON e.backing = l.backing AND e.dst = l.node), topo AS (SELECT backing, node, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY 1, 2)"

_LINK = "lk AS (SELECT backing, revid, branch, greatest(lag(revid) OVER (PARTITION BY backing, branch ORDER BY revid), parent) AS nxt FROM revisions), nw AS (SELECT backing, branch, max(revid) AS start FROM revisions GROUP BY 1, 2), dv AS (SELECT b.proot, b.branch, b.backing, lk.revid, lk.nxt, lk.branch AS on_branch FROM branches b JOIN nw ON nw.backing = b.backing AND nw.branch = b.branch JOIN lk ON lk.backing = nw.backing AND lk.revid = nw.start UNION ALL SELECT d.proot, d.branch, d.backing, lk.revid, lk.nxt, lk.branch FROM dv d JOIN lk ON lk.backing = d.backing AND lk.revid = d.nxt)"

QUERIES = {
    "snap_1_state_at_head": snap_1, "snap_2_delta_since_base": snap_2, "snap_3_state_at_current": snap_3, "snap_4_overlay": snap_4, "snap_5_insert_or_update": snap_5,
    "snap_6_graph_equality": snap_6, "snap_7_linear_chain": snap_7, "snap_8_changed_items": snap_8,
    "hist_1_branch_default": hist_1, "hist_2_parent_branches": hist_2, "hist_3_divergent": hist_3, "hist_3_divergent_only": hist_3_only, "hist_4_redo_listing": hist_4, "hist_5_timeline": hist_5,
    "hist_6_first_revisions": hist_6, "hist_7_dates": hist_7, "hist_8_undo_redo_revision": hist_8, "hist_9_previous_next": hist_9, "hist_10_set_current": hist_10, "hist_11_commit_effect": hist_11, "hist_12_branch_points": hist_12,
    "dag_1_ancestors": dag_1, "dag_2_common_ancestor": dag_2, "dag_3_is_ancestor": dag_3, "dag_4_path": dag_4, "dag_5_missing_revisions": dag_5, "dag_6_parent_lookup": dag_6,
    "dag_7_topological_sort": dag_7, "dag_8_insertion_order": dag_8, "dag_9_containment_cycles": dag_9,
}
SQL = {
    "snap_1_state_at_head": f"{M}, {_STATE} SELECT proot, branch, item, value, k FROM heads",
    "snap_2_delta_since_base": f"{M}, stops AS (SELECT c.proot, c.branch, c.depth AS stop FROM chain c JOIN branches b ON b.proot = c.proot AND b.branch = c.branch AND c.revid = b.head - 5), part AS (SELECT c.* FROM chain c LEFT JOIN stops s ON s.proot = c.proot AND s.branch = c.branch WHERE s.stop IS NULL OR c.depth < s.stop) SELECT proot, branch, item, k, revid FROM (SELECT c.proot, c.branch, r.item, r.k, r.revid, row_number() OVER (PARTITION BY c.proot, c.branch, r.item ORDER BY c.depth) AS n FROM part c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid) WHERE n = 1",
    "snap_3_state_at_current": f"{M}, {_CUR} SELECT c.proot, c.branch, c.item, c.k, c.kind FROM currents c JOIN branches b USING (proot, branch) WHERE NOT b.deleted",
    "snap_4_overlay": f"{M}, {_SIDES} SELECT proot, branch, item, coalesce(m.k, b.k) AS k, coalesce(m.kind, b.kind) AS kind FROM mine m FULL JOIN base b USING (proot, branch, item)",
    "snap_5_insert_or_update": f"{M}, {_SIDES} SELECT proot, branch, item, coalesce(m.k, b.k) AS k, coalesce(m.kind, b.kind) AS kind FROM (SELECT * FROM mine WHERE k % 2 = 0) m FULL JOIN base b USING (proot, branch, item)",
    "snap_6_graph_equality": f"{M}, {_STATE}, {_CUR} SELECT proot, branch, bool_and(h.k IS NOT DISTINCT FROM c.k AND h.kind IS NOT DISTINCT FROM c.kind) AS equal FROM heads h FULL JOIN currents c USING (proot, branch, item) GROUP BY proot, branch",
    "snap_7_linear_chain": f"{M} SELECT proot, branch, revid, CAST(depth AS BIGINT) AS depth FROM chain WHERE depth <= 3",
    "snap_8_changed_items": f"{M}, {_SIDES} SELECT m.* FROM mine m LEFT JOIN base b USING (proot, branch, item) WHERE m.k IS DISTINCT FROM b.k OR m.kind IS DISTINCT FROM b.kind",
    "hist_1_branch_default": f"{M}, {_HIST} SELECT l.proot, l.branch, l.revid, p.revid AS parent FROM listed l LEFT JOIN listed p ON p.proot = l.proot AND p.branch = l.branch AND p.revid = l.parent",
    "hist_2_parent_branches": f"{M}, {_HIST} SELECT o.proot, o.branch, o.revid, o.parent FROM onb o LEFT JOIN stops s ON s.proot = o.proot AND s.branch = o.branch WHERE s.stop IS NULL OR s.stop > 0",
    "hist_4_redo_listing": f"{M} SELECT c.proot, c.branch, c.revid, CAST(c.depth AS BIGINT) AS depth FROM chain c JOIN branches b USING (proot, branch) WHERE b.current < b.head AND c.revid > b.current",
    "hist_5_timeline": f"{M} SELECT proot, branch, revid, row_number() OVER (PARTITION BY proot, branch ORDER BY depth DESC) AS position FROM chain",
    "hist_6_first_revisions": f"{M}, {_HIST} SELECT c.proot, c.branch, c.first_revision, l.initial_revision FROM (SELECT proot, branch, arg_max(revid, depth) AS first_revision FROM chain GROUP BY 1, 2) c LEFT JOIN (SELECT proot, branch, min(revid) AS initial_revision FROM listed GROUP BY 1, 2) l USING (proot, branch)",
    "hist_7_dates": f"{M} SELECT p.proot, CAST(round_even(epoch_us(f.ts) / 1000.0, 0) AS BIGINT) AS created_ms, m.modified_ms, p.proot <> p.backing AS is_copy, CASE WHEN p.proot <> p.backing THEN p.backing END AS parent_root FROM proots p JOIN revisions f ON f.backing = p.backing AND f.revid = 0 LEFT JOIN (SELECT b.proot, max(CAST(round_even(epoch_us(r.ts) / 1000.0, 0) AS BIGINT)) AS modified_ms FROM branches b JOIN revisions r ON r.backing = b.backing AND r.revid = b.head WHERE NOT b.deleted GROUP BY 1) m ON m.proot = p.proot",
    "hist_8_undo_redo_revision": f"{M} SELECT b.proot, b.branch, r.parent AS undo_revision, c.revid AS redo_revision FROM branches b JOIN revisions r ON r.backing = b.backing AND r.revid = b.current LEFT JOIN chain c ON c.proot = b.proot AND c.branch = b.branch AND c.parent = b.current",
    "hist_9_previous_next": f"{M} SELECT proot, branch, revid, lag(revid) OVER w AS previous_node, lead(revid) OVER w AS next_node FROM chain WINDOW w AS (PARTITION BY proot, branch ORDER BY depth DESC)",
    "hist_10_set_current": f"{M} SELECT b.proot, b.branch, greatest(b.head - 3, 0) AS new_current, CASE WHEN EXISTS (SELECT 1 FROM chain c WHERE c.proot = b.proot AND c.branch = b.branch AND c.revid = greatest(b.head - 3, 0)) THEN b.head ELSE greatest(b.head - 3, 0) END AS new_head FROM branches b",
    "hist_11_commit_effect": f"{M}, w AS (SELECT *, lag(revid) OVER (PARTITION BY backing, branch ORDER BY revid) AS old_head FROM revisions) SELECT backing, branch, revid AS new_head, old_head, coalesce(old_head <> parent, FALSE) AS leaves_divergent FROM w",
    "hist_12_branch_points": f"{M} SELECT proot, branch, count(*) AS allowed_starts, max(revid) AS newest_start FROM chain GROUP BY 1, 2",
    "dag_1_ancestors": f"{M}, {_CLOSE} SELECT backing, start, count(*) AS n_ancestors, CAST(sum(node) AS BIGINT) AS sum_ancestors FROM closed GROUP BY 1, 2",
    "hist_3_divergent": f"{M}, {_LINK} SELECT proot, branch, revid FROM dv",
    "hist_3_divergent_only": f"{M}, {_LINK}, st AS (SELECT proot, branch, max(revid) AS stop FROM dv WHERE on_branch <> branch GROUP BY 1, 2) SELECT dv.proot, dv.branch, dv.revid FROM dv LEFT JOIN st USING (proot, branch) WHERE st.stop IS NULL OR dv.revid > st.stop",
    "dag_2_common_ancestor": f"{M}, {_PAIR}, edges AS (SELECT backing, revid AS src, parent AS dst, '0' AS turn FROM revisions WHERE parent IS NOT NULL UNION ALL SELECT backing, revid, merge_parent, '1' FROM revisions WHERE merge_parent IS NOT NULL), ca AS (SELECT DISTINCT backing, a, a AS node FROM pairs UNION SELECT c.backing, c.a, e.dst FROM ca c JOIN edges e ON e.backing = c.backing AND e.src = c.node), bfs AS (SELECT backing, a, b, b AS node, '' AS path FROM pairs UNION ALL SELECT x.backing, x.a, x.b, e.dst, x.path || e.turn FROM bfs x JOIN edges e ON e.backing = x.backing AND e.src = x.node), hit AS (SELECT x.backing, x.a, x.b, x.node, row_number() OVER (PARTITION BY x.backing, x.a, x.b ORDER BY length(x.path), x.path) AS n FROM bfs x JOIN ca ON ca.backing = x.backing AND ca.a = x.a AND ca.node = x.node) SELECT p.backing, p.a, p.b, h.node AS ancestor FROM pairs p LEFT JOIN hit h ON h.backing = p.backing AND h.a = p.a AND h.b = p.b AND h.n = 1",
    "dag_3_is_ancestor": f"{M}, {_PAIR} SELECT p.backing, p.a, p.b, EXISTS (SELECT 1 FROM chain c WHERE c.proot = p.backing AND c.backing = p.backing AND c.revid = p.a AND EXISTS (SELECT 1 FROM own o WHERE o.proot = c.proot AND o.branch = c.branch AND o.head = p.b)) AS is_ancestor FROM pairs p",
    "dag_4_path": f"{M}, h AS (SELECT c.*, o.head FROM chain c JOIN own o ON o.proot = c.proot AND o.branch = c.branch) SELECT h.backing, f.revid AS begin, h.head AS stop, h.revid, CAST(3 - h.depth AS BIGINT) AS position FROM h JOIN h f ON f.proot = h.proot AND f.branch = h.branch AND f.depth = 4 WHERE h.depth < 4",
    "dag_5_missing_revisions": f"{M}, {_CLOSE}, known AS (SELECT c.backing, c.node FROM closed c JOIN trunk t ON t.proot = c.backing JOIN own o ON o.proot = t.proot AND o.branch = t.branch AND o.head = c.start) SELECT DISTINCT backing, node FROM closed EXCEPT SELECT backing, node FROM known",
    "dag_6_parent_lookup": f"{M} SELECT backing, revid, parent, merge_parent FROM revisions",
    "dag_7_topological_sort": f"{M}, {_LEVELS} SELECT * FROM topo",
    "dag_8_insertion_order": f"{M}, {_LEVELS} SELECT backing, node, row_number() OVER (PARTITION BY backing ORDER BY level, node) AS position FROM topo",
    "dag_9_containment_cycles": f"{M}, {_STATE}, e AS (SELECT h.proot, h.item AS src, (h.k * 3 + 1) % 20 AS dst FROM heads h JOIN proots p ON p.proot = h.proot AND p.current_branch = h.branch WHERE h.k % 3 = 0), reach AS (SELECT proot, src, dst AS node FROM e UNION SELECT r.proot, r.src, e.dst FROM reach r JOIN e ON e.proot = r.proot AND e.src = r.node) SELECT DISTINCT proot, CAST(src AS BIGINT) AS item FROM reach WHERE src = node",
}
