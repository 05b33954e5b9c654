"""Sequence differences, application, merging, conflicts, codecs, attributed text."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import codec, sequences, text_runs
from palimpsest.functions.predicates import glob_to_regex
from palimpsest.operators import diff as D
from palimpsest.streaming.feed import push

seq = st.lists(st.integers(0, 4), max_size=14)


@settings(max_examples=200, deadline=None)
@given(seq, seq)
def test_apply_of_diff(a, b):
    assert sequences.apply(a, sequences.diff(a, b)) == b


@settings(max_examples=150, deadline=None)
@given(seq, seq)
def test_matches_are_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(sequences.matches(a, b)) == best[-1][-1]


def test_application_cases():
    d, i = lambda at, n=1: ("delete", at, n, []), lambda at, *v: ("insert", at, 0, list(v))
    assert sequences.apply(["x"], [d(0), i(0, "y")]) == ["y"] == sequences.apply(["x"], [i(0, "y"), d(0)])
    assert sequences.apply(list(range(5)), [d(0), d(2), d(4)]) == [1, 3]
    assert sequences.apply(["a", 1, "b"], [d(1), i(3, "c")]) == ["a", "b", "c"]
    assert sequences.apply(["a", "c", 2], [i(1, "b"), d(2)]) == ["a", "b", "c"]


def test_three_way_lists():
    base, left, right = "123", ["0", "1", "1a", "2", "3", "4"], ["0", "1", "2", "2a", "3", "4"]
    edits = sequences.diff(list(base), left) + sequences.diff(list(base), right)
    assert sequences.apply(list(base), edits) == ["0", "1", "1a", "2", "2a", "3", "4"]


def test_codec_round_trip():
    u = "00000000-0000-4000-8000-0000000000%02x"
    item = {"id": u % 1, "attrs": {"n": (1, -70000), "d": (2, 1.5), "s": (3, "é" * 300), "b": (4, b"\0\1"), "r": (5, "path:x"), "c": (38, [u % 2]), "t": (19, ["bb", "a", None]), "z": (1, None)}}
    raw = codec.encode_item(item)
    back = codec.decode_item(raw)
    assert codec.encode_item(back) == raw and back["attrs"]["t"] == (19, [None, "a", "bb"])
    assert codec.encode_item(codec.from_json(codec.to_json(item))) == raw
    other = {"id": u % 2, "attrs": {"s": (3, "x")}}
    root, items = codec.graph_from_binary(codec.graph_to_binary(u % 1, [item, other]))
    assert root == u % 1 and [i["id"] for i in items] == [u % 1, u % 2]
    assert codec.graph_from_json(codec.graph_to_json(u % 1, [other]))[1] == [other]
    framed = codec.frame({u % 1: raw})
    assert codec.unframe(framed, {u % 1: b"nearer"}) == {u % 1: b"nearer"}
    assert codec.tree(u % 1, {u % 1: item, u % 2: other})["c (composite-array)"][0]["s (string)"] == "x"


runs = st.lists(st.tuples(st.text("ab", min_size=1, max_size=3), st.sets(st.sampled_from("xy")).map(frozenset)), max_size=4)


@settings(max_examples=150, deadline=None)
@given(runs, runs)
def test_text_runs(a, b):
    got = text_runs.apply(a, text_runs.diff(a, b))
    assert got == text_runs.compact(text_runs.plain(b), text_runs.marks(b))


def test_merge_of_text_orders_by_place():
    a = [("hello", frozenset())]
    x, y = text_runs.diff(a, [("hello!", frozenset())], "x"), text_runs.diff(a, [("oh hello", frozenset())], "y")
    assert text_runs.plain(text_runs.apply(a, text_runs.merge(x, y, "x"))) == "oh hello!"


def test_glob():
    import re

    assert re.match(glob_to_regex("workspace.*"), "workspace.doc1") and not re.match(glob_to_regex("work?"), "workspace")
    assert re.match(glob_to_regex("a[!b]c"), "axc") and not re.match(glob_to_regex("a[!b]c"), "abc")


def test_push_actions():
    assert push("1", ["2"], "1", set()) == ("fast-forward", "2")
    assert push("5", ["2"], "1", {"1"}) == ("rebase", None)
    assert push("5", [], "1", set()) == ("ignore", "5")


def test_value_conflict(spark):
    kind = "item string, attr string, type int, val string, vals array<string>, g int"
    side = lambda v: spark.createDataFrame([("i", "value", 1, v, None, 1)], kind)
    e = D.merged(("b", D.diff(side("1"), side("2"), ["g"])), ("c", D.diff(side("1"), side("3"), ["g"])))
    bad = D.conflicts(e, ["g"]).collect()
    assert [r.conflict for r in bad] == ["value"]
    assert D.conflicts(e.where("source = 'b'"), ["g"]).count() == 0
    won = D.apply(side("1"), D.favour(e, ["g"], "c"), ["g"]).collect()
    assert [r.val for r in won] == ["3"]
