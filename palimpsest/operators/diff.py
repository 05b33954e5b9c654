"""Attribute-level differences of item graphs, merging, conflicts and their resolution.

Graphs are in long form: key columns, item, attr, type (see functions.predicates),
val (scalars) and vals (sets sorted, lists in order; text).  Edits have the key
columns, item, attr, kind, type, val, vals, pos and len.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import sequences

EDIT = ["item", "attr", "kind", "type", "val", "vals", "pos", "len"]
LOAD = ("kind", "type", "val", "vals", "pos", "len")
FAMILY = "case when kind = 'set' then 'set' when kind = 'delete' then 'delete' when kind like 'set_%' then 'elements' else 'sequence' end"


def long_form(state: DataFrame, keys: list[str]) -> DataFrame:
    """The attributes of the items of a state (columns k and kind)."""
    text = lambda x: f"transform({x}, t -> cast(t as string))"
    none = "cast(null as array<string>)"
    rows = ", ".join(
        f"struct('{attr}' as attr, {kind} as type, {val} as val, {vals} as vals)"
        for attr, kind, val, vals in (
            ("k", "1", "cast(k as string)", none),
            ("kind", "3", "kind", none),
            ("tags", "17", "cast(null as string)", text("array_sort(array_distinct(array(k % 5, k % 3)))")),
            ("log", "33", "cast(null as string)", text("array(k % 7, k % 5, k % 4, k % 3)")),
        )
    )
    extra = "if(k % 3 = 0, array(struct('extra' as attr, if(k % 2 = 0, 1, 3) as type, cast(k % 11 as string) as val, cast(null as array<string>) as vals)), cast(array() as array<struct<attr:string,type:int,val:string,vals:array<string>>>))"
    return state.selectExpr(*keys, "item", f"inline(concat(array({rows}), {extra}))")


def _items(b: DataFrame, keys: list[str]) -> DataFrame:
    """The items of b. Neither they nor sides are broadcast (filters make inner joins of full ones): a few bits a row in files, a hundred bytes in the driver."""
    return b.select(*keys, "item").distinct().hint("merge")


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Edits that turn a into b, for the items of b (an item only in a is out of reach, not an edit)."""
    on = [*keys, "item", "attr"]
    side = lambda x, p: x.select(*on, F.struct("type", "val", "vals").alias(p))
    both = side(a, "o").join(side(b, "n").hint("merge"), on, "full").join(_items(b, keys), [*keys, "item"], "left_semi")
    both = both.where(~F.col("o").eqNullSafe(F.col("n")))
    none = {"pos": F.lit(None).cast("int"), "len": F.lit(None).cast("int")}
    whole = both.where("n is null or o is null or o.type <> n.type or n.type < 16")
    whole = whole.select(*on, F.when(F.col("n").isNull(), "delete").otherwise("set").alias("kind"), "n.type", "n.val", "n.vals").withColumns(none)
    rest = both.where("o is not null and n is not null and o.type = n.type")
    sets = rest.where("(n.type & 240) = 16")
    parts = sets.select(*on, F.col("n.type").alias("type"), F.explode(F.expr("concat(transform(array_except(n.vals, o.vals), x -> struct('set_insert' as kind, x as val)), transform(array_except(o.vals, n.vals), x -> struct('set_delete' as kind, x as val)))")).alias("e"))
    parts = parts.select(*on, "e.kind", "type", "e.val", F.lit(None).cast("array<string>").alias("vals")).withColumns(none)
    lists = rest.where("(n.type & 240) = 32").select(*on, F.col("n.type").alias("type"), F.col("o.vals").alias("old"), F.col("n.vals").alias("new"))
    return whole.unionByName(parts).unionByName(sequence_edits(lists, on))


def whole_values(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The plainest algorithm: each attribute that differs is set or deleted as a whole."""
    on = [*keys, "item", "attr"]
    side = lambda x, p: x.select(*on, F.struct("type", "val", "vals").alias(p))
    both = side(a, "o").join(side(b, "n").hint("merge"), on, "full").join(_items(b, keys), [*keys, "item"], "left_semi").where("not (o <=> n)")
    none = F.lit(None).cast("int")
    return both.select(*on, F.when(F.col("n").isNull(), "delete").otherwise("set").alias("kind"), "n.type", "n.val", "n.vals", none.alias("pos"), none.alias("len"))


Algorithm = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def diff_by(a: DataFrame, b: DataFrame, keys: list[str], of_item: Column, algorithms: dict[str, Algorithm], default: str = "graph") -> DataFrame:
    """Edits by the algorithm that ``of_item`` names for each item, with its name; a name that is not registered means the default."""
    known = {default: diff, **algorithms}
    name = F.when(of_item.isin(*known), of_item).otherwise(default)
    out = None
    for algorithm, run in known.items():
        own = name == algorithm
        edits = run(a.where(own), b.where(own), keys).withColumn("algorithm", F.lit(algorithm))
        out = edits if out is None else out.unionByName(edits)
    return out


def sequence_edits(lists: DataFrame, on: list[str]) -> DataFrame:
    """Edits between the columns old and new of each row; Arrow batches, no shuffle."""
    kinds = dict(lists.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in on) + ", kind string, type int, val string, vals array<string>, pos int, len int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, kind, old, new in zip(b[on].itertuples(index=False), b["type"], b["old"], b["new"], strict=True):
                for what, at, gone, vals in sequences.diff(list(old), list(new)):
                    rows.append((*key, f"seq_{what}", kind, None, vals, at, gone))
            yield pd.DataFrame(rows, columns=[*on, "kind", "type", "val", "vals", "pos", "len"])

    return lists.select(*on, "type", "old", "new").mapInPandas(run, schema)


def apply(a: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """a with conflict-free edits; new items and attributes appear, deleted attributes go, untouched ones stay."""
    on = [*keys, "item", "attr"]
    e = edits.groupBy(*on).agg(
        F.max("type").alias("e_type"),
        F.bool_or(F.col("kind") == "delete").alias("gone"),
        F.max(F.when(F.col("kind") == "set", F.struct("type", "val", "vals"))).alias("put"),
        F.collect_set(F.when(F.col("kind") == "set_insert", F.col("val"))).alias("plus"),
        F.collect_set(F.when(F.col("kind") == "set_delete", F.col("val"))).alias("minus"),
        F.collect_list(F.when(F.col("kind").startswith("seq_"), F.struct("kind", "pos", "len", "vals"))).alias("seq"),
    )
    both = a.join(e.hint("merge"), on, "full").where("not coalesce(gone, false)")
    kept = both.where("size(seq) = 0 or seq is null").selectExpr(
        *on, "coalesce(put.type, type, e_type) type", "if(put is null, val, put.val) val",
        "case when put is not null then put.vals when plus is null then vals else if(size(plus) + size(minus) = 0, vals, array_sort(array_union(array_except(vals, minus), plus))) end vals",
    )
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in on) + ", type int, val string, vals array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["vals"] = [sequences.apply([] if v is None else list(v), [(s["kind"][4:], s["pos"], s["len"], list(s["vals"])) for s in seq]) for v, seq in zip(b["vals"], b["seq"], strict=True)]
            yield b[[*on, "type", "val", "vals"]]

    return kept.unionByName(both.where("size(seq) > 0").select(*on, "type", "val", "vals", "seq").mapInPandas(run, schema))


def merged(*sides: tuple[str, DataFrame]) -> DataFrame:
    """The union of the edits of named sources."""
    out = None
    for name, e in sides:
        e = e.withColumn("source", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out


def conflicts(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of edits of two sources on one attribute that exclude each other, with the class of conflict."""
    on = [*keys, "item", "attr"]
    load = F.struct(*LOAD)
    x = edits.withColumn("family", F.expr(FAMILY)).select(*on, F.col("source").alias("source_a"), F.col("family").alias("fa"), load.alias("a"))
    y = edits.withColumn("family", F.expr(FAMILY)).select(*on, F.col("source").alias("source_b"), F.col("family").alias("fb"), load.alias("b"))
    both = x.join(y, on).where("source_a < source_b and a <> b")
    touch = "case when a.len = 0 and b.len = 0 then a.pos = b.pos when a.len = 0 then b.pos < a.pos and a.pos < b.pos + b.len when b.len = 0 then a.pos < b.pos and b.pos < a.pos + a.len else a.pos < b.pos + b.len and b.pos < a.pos + a.len end"
    kind = f"case when fa <> fb then 'type' when fa = 'set' then 'value' when fa = 'sequence' and {touch} then 'sequence' end"
    return both.withColumn("conflict", F.expr(kind)).where("conflict is not null")


def conflict_sets(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, attr, conflict_set, size, classes): conflicts that share an edit are one, so a conflict is a connected set of edits.

    Edits of different attributes never meet, so a row gathers the conflicts of one attribute of one item. Sets of an attribute are numbered
    from 0 by their first edit (by source, then place).
    """
    on = [*keys, "item", "attr"]
    pairs = conflicts(edits, keys).select(*on, "conflict", F.struct("source_a", "a").alias("x"), F.struct("source_b", "b").alias("y"))
    text = lambda e, source, load: F.to_json(F.struct(F.col(f"{e}.{source}"), F.coalesce(f"{e}.{load}.pos", F.lit(-1)), F.col(f"{e}.{load}")))
    order = lambda e, source, load: F.concat_ws("/", F.col(f"{e}.{source}"), F.lpad(F.coalesce(f"{e}.{load}.pos", F.lit(0)).cast("string"), 10, "0"), text(e, source, load))
    named = pairs.select(*on, "conflict", order("x", "source_a", "a").alias("x"), order("y", "source_b", "b").alias("y"))
    kinds = dict(named.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in on) + ", conflict_set int, size long, classes string"

    def sets(pairs: list) -> tuple[list[int], list[str]]:
        up: dict[str, str] = {}

        def top(e: str) -> str:
            while up.setdefault(e, e) != e:
                up[e] = e = up[up[e]]
            return e

        for p in pairs:
            x, y = sorted((top(p["x"]), top(p["y"])))
            up[y] = x
        size: dict[str, int] = {}
        classes: dict[str, set[str]] = {}
        for e in sorted(up):
            size[top(e)] = size.get(top(e), 0) + 1
        for p in pairs:
            classes.setdefault(top(p["x"]), set()).add(p["conflict"])
        return list(size.values()), [",".join(sorted(classes[e])) for e in size]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, pairs in zip(b[on].itertuples(index=False), b["pairs"], strict=True):
                rows += [(*key, n, size, classes) for n, (size, classes) in enumerate(zip(*sets(pairs), strict=True))]
            yield pd.DataFrame(rows, columns=[*on, "conflict_set", "size", "classes"])

    return named.groupBy(*on).agg(F.collect_list(F.struct("x", "y", "conflict")).alias("pairs")).mapInPandas(run, schema)


def _conflicting(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, attr, source, load) of the edits that stand in a conflict."""
    on = [*keys, "item", "attr"]
    pairs = conflicts(edits, keys)
    sides = pairs.select(*on, F.col("source_a").alias("source"), F.col("a").alias("load")).unionByName(pairs.select(*on, F.col("source_b").alias("source"), F.col("b").alias("load")))
    return sides.distinct()


def without(edits: DataFrame, keys: list[str], removed: str) -> DataFrame:
    """The edits that stay when those with ``removed`` go, with in_conflict and readded.

    Conflicts that keep edits of one source only dissolve; an edit whose last conflict dissolves is ``readded`` to the plain edits.
    """
    named = [*keys, "item", "attr", "source", "load"]
    left = edits.where(f"not coalesce({removed}, false)")
    then = _conflicting(edits, keys).withColumn("was", F.lit(True))
    now = _conflicting(left, keys).withColumn("is", F.lit(True))
    out = left.withColumn("load", F.struct(*LOAD)).join(then, named, "left").join(now, named, "left").drop("load")
    return out.withColumn("in_conflict", F.expr("`is` is not null")).withColumn("readded", F.expr("was is not null and `is` is null")).drop("was", "is")


def inserted_twice(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Children that more than one edit inserts, by key."""
    child = edits.where("kind in ('set_insert', 'seq_insert', 'seq_modify') or (kind = 'set' and type >= 16)")
    child = child.select(*keys, F.explode(F.coalesce("vals", F.array("val"))).alias("child"))
    return child.groupBy(*keys, "child").agg(F.count("*").alias("n_edits")).where("n_edits > 1")


def favour(edits: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Edits after resolution: on conflicting attributes only those of the favoured source."""
    on = [*keys, "item", "attr"]
    bad = conflicts(edits, keys).select(*on).distinct()
    return edits.join(bad, on, "left_anti").unionByName(edits.where(F.col("source") == source).join(bad, on, "left_semi"))
