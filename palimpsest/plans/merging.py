"""Queries on differences, merges and conflicts between the trunk and the other branches of each root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored
from palimpsest.operators import diff as D
from palimpsest.operators import history, state
from palimpsest.sources.commit_log import MODEL_SQL as M
from palimpsest.sources.commit_log import CommitLog

K = ["proot", "branch"]


def sides(m: CommitLog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, self, other) in long form, one merge per non-trunk branch: self is the trunk, base where the first-parent chains meet."""
    paths = history.head_paths(m.revisions, m.branches)
    trunk = m.proots.select("proot", F.col("current_branch").alias("t"))
    main = paths.join(trunk, (paths["proot"] == trunk["proot"]) & (paths["branch"] == F.col("t"))).select(paths["proot"], "revid")
    others = paths.join(trunk, "proot").where("branch <> t").select("proot", "branch", "backing", "revid")
    meet = stored(others.join(main, ["proot", "revid"]).groupBy("proot", "branch", "backing").agg(F.max("revid").alias("start")), "meet")
    w = m.revisions.select("backing", "revid", "item", "value", "k", F.col("branch").alias("kind"))

    def near(p: DataFrame) -> DataFrame:
        return p.join(w, ["backing", "revid"]).groupBy(*K, "item").agg(F.min_by(F.struct("k", "kind"), F.col("depth")).alias("w")).select(*K, "item", "w.k", "w.kind")

    states = stored(near(paths), "states")
    base = stored(near(paths.join(meet.select(*K, F.col("start").alias("s")), K).where("revid <= s")), "base")
    mine = stored(states.join(trunk.select("proot", F.col("t").alias("branch")), K).drop("branch").join(meet.select(*K), "proot").select(*K, "item", "k", "kind"), "mine")
    theirs = stored(states.join(meet.select(*K), K, "left_semi"), "theirs")
    return tuple(D.long_form(x, K) for x in (base, mine, theirs))


def _edits(m: CommitLog) -> tuple[DataFrame, DataFrame]:
    base, mine, theirs = sides(m)
    return base, stored(D.merged(("self", D.diff(base, mine, K)), ("other", D.diff(base, theirs, K))), "edits")


def _text(e: DataFrame) -> DataFrame:
    return e.withColumn("vals", F.array_join("vals", ","))


def diff_1(spark: SparkSession, d: str) -> DataFrame:
    base, _, theirs = sides(CommitLog(spark, d))
    return _text(D.diff(base.where("attr <> 'log'"), theirs.where("attr <> 'log'"), K)).select(*K, "item", "attr", "kind", "type", "val", "vals")


def diff_2(spark: SparkSession, d: str) -> DataFrame:
    base, _, theirs = sides(CommitLog(spark, d))
    return D.diff(base.where("attr = 'tags'"), theirs.where("attr = 'tags'"), K).where("kind like 'set_%'").select(*K, "item", "kind", "val")


def diff_3(spark: SparkSession, d: str) -> DataFrame:
    base, _, theirs = sides(CommitLog(spark, d))
    return _text(D.diff(base.where("attr = 'log'"), theirs.where("attr = 'log'"), K)).select(*K, "item", "kind", "pos", "len", "vals")


def diff_4(spark: SparkSession, d: str) -> DataFrame:
    base, _, theirs = sides(CommitLog(spark, d))
    scalar = "attr in ('k', 'kind')"
    return D.diff(base.where(scalar), theirs.where(scalar), K).select(*K, "item", "attr", "kind", "val")


def diff_5(spark: SparkSession, d: str) -> DataFrame:
    """The base with the difference to the branch applied: the branch's items, and those only the base has."""
    base, _, theirs = sides(CommitLog(spark, d))
    return _text(D.apply(base, D.diff(base, theirs, K), K)).select(*K, "item", "attr", "type", "val", "vals")


def diff_6(spark: SparkSession, d: str) -> DataFrame:
    base, mine, _ = sides(CommitLog(spark, d))
    log = "attr = 'log'"
    return _text(D.apply(base.where(log), D.diff(base.where(log), mine.where(log), K), K)).select(*K, "item", "vals")


def diff_7(spark: SparkSession, d: str) -> DataFrame:
    """Edits by the algorithm of their item's entity (here by item number): whole values, or the graph difference, which also serves unknown names."""
    base, _, theirs = sides(CommitLog(spark, d))
    entity = F.when(F.col("item") % 4 == 0, "whole").when(F.col("item") % 4 == 1, "unheard of").otherwise("graph")
    edits = D.diff_by(base.where("attr <> 'log'"), theirs.where("attr <> 'log'"), K, entity, {"whole": D.whole_values})
    return edits.groupBy("proot", "algorithm").agg(F.count("*").alias("n_edits"))


def diff_8(spark: SparkSession, d: str) -> DataFrame:
    base, _, theirs = sides(CommitLog(spark, d))
    row = lambda x: x.groupBy(*K, "item").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("attr", "type", "val", "vals")))), 256).alias("h"))
    return row(theirs).join(row(base), [*K, "item", "h"], "left_anti").select(*K, "item")


def mrg_1(spark: SparkSession, d: str) -> DataFrame:
    return _edits(CommitLog(spark, d))[1].where("attr <> 'log'").groupBy(*K, "source").agg(F.count("*").alias("n_edits"))


def mrg_2(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' partial differences by algorithm, also where only one side has any."""
    e = _edits(CommitLog(spark, d))[1].where("attr <> 'log'").withColumn("algorithm", F.when(F.col("item") % 4 == 0, "text").otherwise("graph"))
    n = lambda s: e.where(F.col("source") == s).groupBy("proot", "algorithm").agg(F.count("*").alias(f"n_{s}"))
    return n("self").join(n("other"), ["proot", "algorithm"], "full").na.fill(0, ["n_self", "n_other"])


def mrg_3(spark: SparkSession, d: str) -> DataFrame:
    e = _edits(CommitLog(spark, d))[1].where("attr <> 'log'")
    return D.conflicts(e, K).select(*K, "item", "attr", "conflict", F.col("a.val").alias("other_val"), F.col("b.val").alias("self_val"))


def mrg_3_seq(spark: SparkSession, d: str) -> DataFrame:
    e = _edits(CommitLog(spark, d))[1].where("attr = 'log'")
    return D.conflicts(e, K).groupBy(*K, "item", "conflict").agg(F.count("*").alias("n_pairs"))


def mrg_4(spark: SparkSession, d: str) -> DataFrame:
    return D.inserted_twice(_edits(CommitLog(spark, d))[1].where("attr = 'tags'"), K)


def mrg_5(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts as sets of edits: conflicts that share an edit are one."""
    e = _edits(CommitLog(spark, d))[1].where("attr <> 'log'")
    return D.conflict_sets(e, K)


def mrg_5_seq(spark: SparkSession, d: str) -> DataFrame:
    """The same for ordered lists, where an attribute may have several sets of touching edits."""
    e = _edits(CommitLog(spark, d))[1].where("attr = 'log'")
    return D.conflict_sets(e, K).select(*K, "item", "conflict_set", "size")


def mrg_6(spark: SparkSession, d: str) -> DataFrame:
    m = CommitLog(spark, d)
    e = _edits(m)[1].where("attr <> 'log'")
    bad = D.conflicts(e, K).select(*K).distinct().withColumn("bad", F.lit(True))
    return e.select(*K).distinct().join(bad, K, "left").select(*K, F.coalesce("bad", F.lit(False)).alias("has_conflicts"))


def mrg_7(spark: SparkSession, d: str) -> DataFrame:
    e = D.favour(_edits(CommitLog(spark, d))[1].where("attr <> 'log'"), K, "self")
    return _text(e).select(*K, "item", "attr", "source", "kind", "val", "vals")


def mrg_8(spark: SparkSession, d: str) -> DataFrame:
    """Without the other side's edits of k: edits left, those still in conflict, and those that a dissolved conflict gives back."""
    e = _edits(CommitLog(spark, d))[1].where("attr <> 'log'")
    left = D.without(e, K, "source = 'other' and attr = 'k'")
    return left.groupBy("attr").agg(F.count("*").alias("n_edits"), F.count_if("in_conflict").alias("n_conflicting"), F.count_if("readded").alias("n_readded"))


def mrg_9(spark: SparkSession, d: str) -> DataFrame:
    """Three-way merge result: the base with both sides' edits, conflicts resolved for the trunk."""
    base, e = _edits(CommitLog(spark, d))
    return _text(D.apply(base, D.favour(e, K, "self"), K)).where("attr in ('k', 'kind', 'extra')").select(*K, "item", "attr", "type", "val")


def mrg_10(spark: SparkSession, d: str) -> DataFrame:
    """Selective undo of the last revision of each branch: the edits from it to its parent, applied to the branch's current state."""
    m = CommitLog(spark, d)
    at = m.branches.join(m.revisions.select("backing", F.col("revid").alias("head"), "parent"), ["backing", "head"]).where("parent is not null")
    cols = [*K, "item", "k", "kind"]
    now = state.state_at(m.revisions, at.select(*K, "backing", F.col("head").alias("start"))).select(*cols)
    before = state.state_at(m.revisions, at.select(*K, "backing", F.col("parent").alias("start"))).select(*cols)
    a, b = D.long_form(now, K), D.long_form(before, K)
    scalar = "attr in ('k', 'kind')"
    return D.apply(a.where(scalar), D.diff(a.where(scalar), b.where(scalar), K), K).select(*K, "item", "attr", "val")


def mrg_11(spark: SparkSession, d: str) -> DataFrame:
    """Rebase of each branch's revisions since the fork onto the trunk's head: the rebased revisions, one after another.

    The merge base of each step is the source revision before it and the source wins, so a step writes the attributes that its source
    revision changed; the others of its item stay as the steps before it, or the trunk, left them.
    """
    m = CommitLog(spark, d)
    scalar = "attr in ('k', 'kind')"
    base, onto, _ = (x.where(scalar).select(*K, "item", "attr", "val") for x in sides(m))
    paths = history.head_paths(m.revisions, m.branches).join(m.proots.select("proot", F.col("current_branch").alias("t")), "proot")
    main = paths.where("branch = t").select("proot", "revid")
    fork = paths.where("branch <> t").join(main, ["proot", "revid"], "left_semi").groupBy(*K).agg(F.max("revid").alias("fork"))
    steps = paths.join(fork, K).where("revid > fork").join(m.revisions.selectExpr("backing", "revid", "item", "k", "branch kind"), ["backing", "revid"])
    steps = steps.withColumn("position", F.row_number().over(Window.partitionBy(*K).orderBy("revid")))
    writes = D.long_form(steps.select(*K, "position", "revid", "item", "k", "kind"), [*K, "position", "revid"]).where(scalar).select(*K, "position", "revid", "item", "attr", "val")
    own = Window.partitionBy(*K, "item", "attr").orderBy("position")
    on = [*K, "item", "attr"]
    x = writes.join(base.withColumnRenamed("val", "base_val"), on, "left").join(onto.withColumnRenamed("val", "onto_val"), on, "left")
    x = x.withColumn("before", F.coalesce(F.lag("val").over(own), "base_val")).withColumn("edit", F.when(~F.col("val").eqNullSafe(F.col("before")), F.col("val")))
    x = x.withColumn("last_edit", F.last("edit", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(*K, "position", F.col("revid").alias("source_revid"), "item", "attr", F.coalesce("last_edit", "onto_val").alias("val"))


def cpy_1(spark: SparkSession, d: str) -> DataFrame:
    """Copy of the trunk root item's composite subgraph with fresh deterministic names."""
    from palimpsest.operators.recurse import closure

    m = CommitLog(spark, d)
    main = m.branches.join(m.proots.select("proot", F.col("current_branch").alias("branch")), K)
    s = state.state_at(m.revisions, main.select(*K, "backing", F.col("head").alias("start"))).select("proot", "item", "k")
    edges = s.where("k % 3 = 0").selectExpr("proot", "item src", "(k * 3 + 1) % 20 dst")
    top = m.proots.join(m.revisions.where("revid = 0").select("backing", F.col("item").alias("start")), "backing").select("proot", "start")
    part = closure(edges, top, "proot").select("proot", F.col("node").alias("item"))
    return part.join(s, ["proot", "item"]).select("proot", "item", "k", F.sha1(F.concat_ws("/", F.col("proot").cast("string"), F.col("item").cast("string"), F.lit("copy"))).alias("new_item"))


_S = """near AS (SELECT c.proot, c.branch, c.revid, r.item, r.k, r.branch AS kind, c.depth FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid),
main AS (SELECT proot, current_branch AS branch FROM proots),
meet AS (SELECT o.proot, o.branch, max(o.revid) AS s FROM chain o JOIN main t ON t.proot = o.proot AND t.branch <> o.branch JOIN chain c ON c.proot = t.proot AND c.branch = t.branch AND c.revid = o.revid GROUP BY 1, 2),
sb AS (SELECT proot, branch, item, arg_min(k, depth) AS k, arg_min(kind, depth) AS kind FROM near JOIN meet USING (proot, branch) WHERE revid <= s GROUP BY 1, 2, 3),
heads AS (SELECT proot, branch, item, arg_min(k, depth) AS k, arg_min(kind, depth) AS kind FROM near GROUP BY 1, 2, 3),
so AS (SELECT heads.* FROM heads JOIN meet USING (proot, branch)),
sm AS (SELECT m.proot, m.branch, h.item, h.k, h.kind FROM meet m JOIN main t ON t.proot = m.proot JOIN heads h ON h.proot = t.proot AND h.branch = t.branch)"""


def _long(name: str, src: str) -> str:
    return f"{name} AS (SELECT proot, branch, item, 'k' AS attr, 1 AS type, CAST(k AS VARCHAR) AS val, NULL AS vals FROM {src} UNION ALL SELECT proot, branch, item, 'kind', 3, kind, NULL FROM {src} UNION ALL SELECT proot, branch, item, 'tags', 17, NULL, array_to_string(list_sort(list_distinct([k % 5, k % 3])), ',') FROM {src} UNION ALL SELECT proot, branch, item, 'log', 33, NULL, (k % 7) || ',' || (k % 5) || ',' || (k % 4) || ',' || (k % 3) FROM {src} UNION ALL SELECT proot, branch, item, 'extra', CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END, CAST(k % 11 AS VARCHAR), NULL FROM {src} WHERE k % 3 = 0)"


def _diff(name: str, a: str, b: str) -> str:
    on = "proot, branch, item, attr"
    return f"""{name}j AS (SELECT {on}, o.type AS ot, o.val AS ov, o.vals AS os, n.type, n.val, n.vals FROM {a} o FULL JOIN {b} n USING ({on}) WHERE attr <> 'log' AND (proot, branch, item) IN (SELECT proot, branch, item FROM {b})),
{name} AS (SELECT {on}, CASE WHEN type IS NULL THEN 'delete' ELSE 'set' END AS kind, type, val, vals FROM {name}j WHERE (type IS NULL OR ot IS NULL OR ot <> type OR type < 16) AND (ot IS DISTINCT FROM type OR ov IS DISTINCT FROM val OR os IS DISTINCT FROM vals)
UNION ALL SELECT {on}, 'set_insert', type, x, NULL FROM (SELECT *, unnest(string_split(vals, ',')) AS x FROM {name}j WHERE ot = 17 AND type = 17) WHERE NOT list_contains(string_split(os, ','), x)
UNION ALL SELECT {on}, 'set_delete', type, x, NULL FROM (SELECT *, unnest(string_split(os, ',')) AS x FROM {name}j WHERE ot = 17 AND type = 17) WHERE NOT list_contains(string_split(vals, ','), x))"""


_B = f"{M}, {_S}, {_long('ab', 'sb')}, {_long('ao', 'so')}, {_long('am', 'sm')}, {_diff('eo', 'ab', 'ao')}"
_E = f"{_B}, {_diff('em', 'ab', 'am')}, edits AS (SELECT *, 'other' AS source FROM eo UNION ALL SELECT *, 'self' FROM em), fam AS (SELECT *, CASE WHEN kind LIKE 'set\\_%' ESCAPE '\\' THEN 'elements' ELSE kind END AS family FROM edits), conf AS (SELECT a.proot, a.branch, a.item, a.attr, CASE WHEN a.family <> b.family THEN 'type' ELSE 'value' END AS conflict, a.val AS other_val, b.val AS self_val FROM fam a JOIN fam b USING (proot, branch, item, attr) WHERE a.source = 'other' AND b.source = 'self' AND (a.family <> b.family OR (a.family = 'set' AND (a.type IS DISTINCT FROM b.type OR a.val IS DISTINCT FROM b.val OR a.vals IS DISTINCT FROM b.vals)))), resolved AS (SELECT * FROM edits WHERE (proot, branch, item, attr) NOT IN (SELECT proot, branch, item, attr FROM conf) OR source = '{{}}')"
_PUT = "done AS (SELECT proot, branch, item, attr, b.type AS bt, b.val AS bv, r.kind, r.type AS rt, r.val AS rv FROM (SELECT * FROM ab WHERE attr IN ('k', 'kind', 'extra')) b FULL JOIN (SELECT DISTINCT proot, branch, item, attr, kind, type, val FROM resolved WHERE attr IN ('k', 'kind', 'extra')) r USING (proot, branch, item, attr))"

QUERIES = {
    "diff_1_graph_diff": diff_1, "diff_2_unordered": diff_2, "diff_3_ordered": diff_3, "diff_4_scalar": diff_4, "diff_5_apply": diff_5, "diff_6_apply_sequence": diff_6, "diff_7_by_algorithm": diff_7, "diff_8_changed_rows": diff_8,
    "mrg_1_union_of_edits": mrg_1, "mrg_2_by_algorithm": mrg_2, "mrg_3_conflict_classes": mrg_3, "mrg_3_sequence_conflicts": mrg_3_seq, "mrg_4_inserted_twice": mrg_4, "mrg_5_conflict_sets": mrg_5, "mrg_5_sequence_sets": mrg_5_seq, "mrg_6_has_conflicts": mrg_6, "mrg_7_favour_source": mrg_7,
    "mrg_8_remove_edits": mrg_8, "mrg_9_three_way": mrg_9, "mrg_10_selective_undo": mrg_10, "mrg_11_rebase": mrg_11, "cpy_1_copy_subgraph": cpy_1,
}
SQL = {
    "diff_1_graph_diff": f"{_B} SELECT * FROM eo",
    "diff_2_unordered": f"{_B} SELECT proot, branch, item, kind, val FROM eo WHERE attr = 'tags' AND kind LIKE 'set#_%' ESCAPE '#'",
    "diff_4_scalar": f"{_B} SELECT proot, branch, item, attr, kind, val FROM eo WHERE attr IN ('k', 'kind')",
    "diff_5_apply": f"{_B} SELECT * FROM ao UNION ALL SELECT * FROM ab WHERE (proot, branch, item) NOT IN (SELECT proot, branch, item FROM ao)",
    "diff_6_apply_sequence": f"{_B} SELECT proot, branch, item, coalesce(m.vals, b.vals) AS vals FROM (SELECT * FROM ab WHERE attr = 'log') b FULL JOIN (SELECT * FROM am WHERE attr = 'log') m USING (proot, branch, item)",
    "diff_7_by_algorithm": f"{_B} SELECT proot, 'graph' AS algorithm, count(*) AS n_edits FROM eo WHERE item % 4 <> 0 GROUP BY 1 UNION ALL "
    "SELECT proot, 'whole', count(*) FROM eoj WHERE item % 4 = 0 AND (ot IS DISTINCT FROM type OR ov IS DISTINCT FROM val OR os IS DISTINCT FROM vals) GROUP BY 1",
    "diff_8_changed_rows": f"{_B} SELECT so.proot, so.branch, so.item FROM so LEFT JOIN sb USING (proot, branch, item) WHERE so.k IS DISTINCT FROM sb.k OR so.kind IS DISTINCT FROM sb.kind",
    "mrg_1_union_of_edits": f"{_E} SELECT proot, branch, source, count(*) AS n_edits FROM edits GROUP BY 1, 2, 3",
    "mrg_2_by_algorithm": f"{_E} SELECT proot, CASE WHEN item % 4 = 0 THEN 'text' ELSE 'graph' END AS algorithm, count(*) FILTER (WHERE source = 'self') AS n_self, count(*) FILTER (WHERE source = 'other') AS n_other FROM edits GROUP BY 1, 2",
    "mrg_3_conflict_classes": f"{_E} SELECT * FROM conf",
    "mrg_4_inserted_twice": f"{_E}, ch AS (SELECT proot, branch, unnest(string_split(coalesce(vals, val), ',')) AS child FROM edits WHERE attr = 'tags' AND kind IN ('set', 'set_insert')) SELECT proot, branch, child, count(*) AS n_edits FROM ch GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "mrg_5_conflict_sets": f"{_E}, cf AS (SELECT DISTINCT proot, branch, item, attr, conflict FROM conf), cl AS (SELECT proot, branch, item, attr, string_agg(conflict, ',' ORDER BY conflict) AS classes FROM cf GROUP BY 1, 2, 3, 4) "
    "SELECT e.proot, e.branch, e.item, e.attr, 0 AS conflict_set, count(*) AS size, any_value(cl.classes) AS classes FROM edits e JOIN cl USING (proot, branch, item, attr) GROUP BY 1, 2, 3, 4",
    "mrg_6_has_conflicts": f"{_E} SELECT DISTINCT proot, branch, (proot, branch) IN (SELECT proot, branch FROM conf) AS has_conflicts FROM edits",
    "mrg_7_favour_source": f"{_E} SELECT proot, branch, item, attr, source, kind, val, vals FROM resolved",
    "mrg_8_remove_edits": f"{_E}, lf AS (SELECT e.*, (proot, branch, item, attr) IN (SELECT proot, branch, item, attr FROM conf) AS was FROM edits e WHERE NOT (source = 'other' AND attr = 'k')) "
    "SELECT attr, count(*) AS n_edits, count(*) FILTER (WHERE was AND attr <> 'k') AS n_conflicting, count(*) FILTER (WHERE was AND attr = 'k') AS n_readded FROM lf GROUP BY 1",
    "mrg_9_three_way": f"{_E}, {_PUT} SELECT proot, branch, item, attr, coalesce(rt, bt) AS type, CASE WHEN kind = 'set' THEN rv ELSE bv END AS val FROM done WHERE kind IS DISTINCT FROM 'delete'",
    "mrg_10_selective_undo": f"{M}, n0 AS (SELECT c.proot, c.branch, c.depth, r.item, r.k, r.branch AS kind FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid JOIN branches b ON b.proot = c.proot AND b.branch = c.branch JOIN revisions h ON h.backing = b.backing AND h.revid = b.head WHERE h.parent IS NOT NULL), a AS (SELECT proot, branch, item, arg_min(k, depth) AS k, arg_min(kind, depth) AS kind FROM n0 GROUP BY 1, 2, 3), b AS (SELECT proot, branch, item, arg_min(k, depth) AS k, arg_min(kind, depth) AS kind FROM n0 WHERE depth > 0 GROUP BY 1, 2, 3), u AS (SELECT proot, branch, item, coalesce(b.k, a.k) AS k, coalesce(b.kind, a.kind) AS kind FROM a FULL JOIN b USING (proot, branch, item)) SELECT proot, branch, item, 'k' AS attr, CAST(k AS VARCHAR) AS val FROM u UNION ALL SELECT proot, branch, item, 'kind', kind FROM u",
    "cpy_1_copy_subgraph": f"{M}, st AS (SELECT c.proot, r.item, arg_min(r.k, c.depth) AS k FROM chain c JOIN proots p ON p.proot = c.proot AND p.current_branch = c.branch JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid GROUP BY 1, 2), part AS (SELECT p.proot, r.item FROM proots p JOIN revisions r ON r.backing = p.backing AND r.revid = 0 UNION SELECT x.proot, (s.k * 3 + 1) % 20 FROM part x JOIN st s ON s.proot = x.proot AND s.item = x.item WHERE s.k % 3 = 0) SELECT st.proot, st.item, st.k, sha1(st.proot || '/' || st.item || '/copy') AS new_item FROM part JOIN st USING (proot, item)",
    "mrg_11_rebase": f"""{_B}, src AS (SELECT c.proot, c.branch, c.revid, r.item, r.k, r.branch AS kind, CAST(row_number() OVER (PARTITION BY c.proot, c.branch ORDER BY c.revid) AS INT) AS position
  FROM chain c JOIN meet m ON m.proot = c.proot AND m.branch = c.branch AND c.revid > m.s JOIN revisions r ON r.backing = c.backing AND r.revid = c.revid),
wr AS (SELECT proot, branch, position, revid, item, 'k' AS attr, CAST(k AS VARCHAR) AS val FROM src UNION ALL SELECT proot, branch, position, revid, item, 'kind', kind FROM src),
ed AS (SELECT w.*, m.val AS onto_val, CASE WHEN w.val IS DISTINCT FROM coalesce(lag(w.val) OVER (PARTITION BY w.proot, w.branch, w.item, w.attr ORDER BY position), b.val) THEN w.val END AS edit
  FROM wr w LEFT JOIN ab b ON b.proot = w.proot AND b.branch = w.branch AND b.item = w.item AND b.attr = w.attr LEFT JOIN am m ON m.proot = w.proot AND m.branch = w.branch AND m.item = w.item AND m.attr = w.attr)
SELECT proot, branch, position, revid AS source_revid, item, attr, coalesce(last_value(edit IGNORE NULLS) OVER (PARTITION BY proot, branch, item, attr ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), onto_val) AS val FROM ed""",
}
SQL = {k: q.replace("source = '{}'", "source = 'self'") for k, q in SQL.items()}
