"""Conflict sets, removal of edits, algorithms per entity, value transformers."""

from __future__ import annotations

import random

import pytest

from palimpsest.functions import storage
from palimpsest.functions.transforms import COLOUR, RECT, Transformer, persisted, restored
from palimpsest.operators import diff as D

EDITS = "p long, item long, attr string, kind string, type int, val string, vals array<string>, pos int, len int, source string"


def seq(source, pos, n, item=0, kind="seq_delete"):
    return (1, item, "log", kind, 33, None, None, pos, n, source)


def put(source, attr, val, item=0):
    return (1, item, attr, "set", 1, val, None, None, None, source)


def element(source, attr, val, item=0):
    return (1, item, attr, "set_insert", 17, val, None, None, None, source)


def test_sets_are_connected_through_edits(spark):
    # a long edit of one side joins two of the other; a far one stays apart
    rows = [seq("a", 0, 4), seq("b", 1, 1), seq("b", 3, 2), seq("a", 8, 2), seq("b", 9, 1), seq("a", 20, 1)]
    got = D.conflict_sets(spark.createDataFrame(rows, EDITS), ["p"]).orderBy("conflict_set").collect()
    assert [(r.conflict_set, r.size, r.classes) for r in got] == [(0, 3, "sequence"), (1, 2, "sequence")]


def test_sets_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for item in range(12):
        for s in "ab":
            at = 0
            for _ in range(6):
                at += rng.randint(0, 4)
                n = rng.randint(1, 4)
                rows.append(seq(s, at, n, item))
                at += n
    want = {}
    for item in range(12):  # edits that are alike on both sides exclude nothing
        mine = [r for r in rows if r[1] == item]
        groups = [{r} for r in mine]
        for x in mine:
            for y in mine:
                if x[9] < y[9] and x[:9] != y[:9] and x[7] < y[7] + y[8] and y[7] < x[7] + x[8]:
                    g, h = (next(k for k in groups if e in k) for e in (x, y))
                    if g is not h:
                        groups.remove(h)
                        g |= h
        want[item] = sorted(len(g) for g in groups if len(g) > 1)
    got = {item: [] for item in range(12)}
    for r in D.conflict_sets(spark.createDataFrame(rows, EDITS), ["p"]).collect():
        got[r["item"]].append(r["size"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_removed_edits_dissolve_conflicts(spark):
    rows = [put("a", "k", "1"), put("b", "k", "2"), put("a", "t", "x"), element("b", "t", "y"), element("b", "t", "z"), put("a", "free", "1")]
    e = spark.createDataFrame(rows, EDITS)
    got = {(r.source, r.attr, r.val): (r.in_conflict, r.readded) for r in D.without(e, ["p"], "source = 'a' and attr = 'k'").collect()}
    assert got == {("b", "k", "2"): (False, True), ("a", "t", "x"): (True, False), ("b", "t", "y"): (True, False), ("b", "t", "z"): (True, False), ("a", "free", "1"): (False, False)}
    # one of two partners goes: the conflict stays; both go: the survivor comes back
    one = {(r.source, r.val): (r.in_conflict, r.readded) for r in D.without(e.where("attr = 't'"), ["p"], "val = 'y'").collect()}
    assert one == {("a", "x"): (True, False), ("b", "z"): (True, False)}
    both = {(r.source, r.val): (r.in_conflict, r.readded) for r in D.without(e.where("attr = 't'"), ["p"], "source = 'b'").collect()}
    assert both == {("a", "x"): (False, True)}


def test_algorithms_by_entity(spark):
    from pyspark.sql import functions as F

    form = "p long, item long, attr string, type int, val string, vals array<string>"
    a = spark.createDataFrame([(1, i, "tags", 17, None, ["x", "y"]) for i in range(3)], form)
    b = spark.createDataFrame([(1, i, "tags", 17, None, ["y", "z"]) for i in range(3)], form)
    name = F.when(F.col("item") == 0, "whole").when(F.col("item") == 1, "nobody knows")
    got = sorted((r["item"], r.algorithm, r.kind) for r in D.diff_by(a, b, ["p"], name, {"whole": D.whole_values}).collect())
    assert got == [(0, "whole", "set")] + [(i, "graph", k) for i in (1, 2) for k in ("set_delete", "set_insert")]


def test_transformers(spark):
    df = spark.createDataFrame([(1, (255, 0, 10), (1.0, 2.5, 3.0, 4.0)), (2, None, None)], "id long, c struct<r:int,g:int,b:int>, f struct<x:double,y:double,width:double,height:double>")
    kept = persisted(df, {"c": COLOUR, "f": RECT})
    assert [r.c for r in kept.orderBy("id").collect()] == ["#ff000a", None]
    assert restored(kept, {"c": COLOUR, "f": RECT}).orderBy("id").collect() == df.orderBy("id").collect()
    with pytest.raises(TypeError):
        persisted(df, {"c": Transformer(lambda c: c["r"], lambda c: c, "string", "int")})


def test_nothing_that_grows_is_broadcast(spark):
    # graphs of a few kilobytes, far below Spark's own limit of 10 MB
    a = storage.stored(spark.range(200).selectExpr("id p", "0L item", "'log' attr", "33 type", "cast(null as string) val", "array(cast(id as string), '1') vals"), "a")
    b = storage.stored(a.selectExpr("p", "item", "attr", "type", "val", "array('1', '2') vals"), "b")
    out = D.apply(a, D.diff(a, b, ["p"]), ["p"])
    assert {tuple(r.vals) for r in out.collect()} == {("1", "2")}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_broadcast_little(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    a = spark.range(100_000).withColumnRenamed("id", "k")  # 800 kB
    assert storage.stored(a.join(a.selectExpr("k", "k + 1 v"), "k"), "joined").count() == 100_000
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert "BroadcastHashJoin" not in [p for p in plans if "InsertIntoHadoopFs" in p][-1]
    assert [spark.conf.get(k, None) for k in keys] == before
