"""Listings of the two history fixtures, the snapshot layout, common ancestors."""

from __future__ import annotations

import random

import pytest

from palimpsest.operators import history, recurse
from palimpsest.operators.store import delta_layout

ONE = [(0, None, "b1A"), (1, 0, "b1A"), (2, 1, "b1B"), (3, 2, "b1B"), (4, 3, "b1B"), (5, 2, "b1B"), (6, 0, "b2A")]
TWO = [(0, None, "1A"), (1, 0, "1A"), (2, 1, "1A"), (3, 1, "1B"), (4, 2, "2A"), (5, 3, "1B"), (6, 3, "1B"), (7, 6, "1C"), (8, 6, "1B"), (9, 7, "1C"), (10, 6, "1C")]


def log(spark, rows):
    return spark.createDataFrame([("p", *r, None) for r in rows], "backing string, revid long, parent long, branch string, merge_parent long")


def heads(spark, rows):
    return spark.createDataFrame([(1, b, "p", h) for b, h in rows], "proot long, branch string, backing string, head long")


def lists(df):
    out: dict[str, list[int]] = {}
    for r in df.select("branch", "revid").orderBy("revid").collect():
        out.setdefault(r.branch, []).append(r.revid)
    return out


CASES = [
    (ONE, [("b1A", 1), ("b1B", 3), ("b2A", 6)], {
        0: {"b1A": [0, 1], "b1B": [2, 3], "b2A": [6]}, 2: {"b1A": [0, 1], "b1B": [0, 1, 2, 3], "b2A": [0, 6]},
        4: {"b1A": [0, 1], "b1B": [2, 3, 4, 5], "b2A": [6]}, 6: {"b1A": [0, 1], "b1B": [0, 1, 2, 3, 4, 5], "b2A": [0, 6]}}),
    (TWO, [("1A", 2), ("1B", 8), ("1C", 10), ("2A", 4)], {
        0: {"1A": [0, 1, 2], "1B": [3, 6, 8], "1C": [10], "2A": [4]}, 2: {"1A": [0, 1, 2], "1B": [0, 1, 3, 6, 8], "1C": [0, 1, 3, 6, 10], "2A": [0, 1, 2, 4]},
        6: {"1A": [0, 1, 2], "1B": [0, 1, 3, 5, 6, 8], "1C": [0, 1, 3, 5, 6, 7, 9, 10], "2A": [0, 1, 2, 4]}}),
]


@pytest.mark.parametrize("rows,ends,want", CASES)
def test_listings(spark, rows, ends, want):
    r, b = log(spark, rows), heads(spark, ends)
    paths = history.head_paths(r, b)
    for options, lines in want.items():
        got = history.divergent_history(r, b, options == 6) if options & 4 else history.branch_history(paths, r, options == 2)
        assert lists(got) == lines, options


def test_first_row_has_no_parent(spark):
    r, b = log(spark, TWO), heads(spark, [("1B", 8)])
    got = {x.revid: x.parent for x in history.branch_history(history.head_paths(r, b), r).collect()}
    assert got == {3: None, 6: 3, 8: 6}


def test_snapshot_layout(spark):
    r = log(spark, [(i, i - 1 if i else None, "b") for i in range(10)])
    got = [x.delta_base for x in delta_layout(r, 4).orderBy("revid").collect()]
    assert got == [0, 0, 0, 0, 4, 4, 4, 4, 8, 8]


def test_long_chain(spark):
    r = log(spark, [(i, i - 1 if i else None, "b") for i in range(300)])
    got = recurse.chains(r.select("backing", "revid", "parent"), spark.createDataFrame([("p", 299)], "backing string, start long"))
    assert got.count() == 300 and got.where("revid = 299 - depth").count() == 300


def test_common_ancestor_prefers_parents(spark):
    rows = [("p", 0, None, "m", None), ("p", 1, 0, "m", None), ("p", 2, 0, "x", None), ("p", 3, 1, "m", 2), ("p", 4, 2, "x", 1)]
    r = spark.createDataFrame(rows, "backing string, revid long, parent long, branch string, merge_parent long")
    pairs = spark.createDataFrame([("p", 3, 4), ("p", 1, 3)], "backing string, a long, b long")
    got = {(x.a, x.b): x.ancestor for x in history.common_ancestor(r, pairs).collect()}
    assert got == {(3, 4): 2, (1, 3): 1}


def first_common(up, a, b):
    """Brute force: the ancestors of a, then a queue from b."""
    known, todo = {a}, [a]
    while todo:
        for x in up[todo.pop()]:
            if x not in known:
                known.add(x)
                todo.append(x)
    queue, met = [b], {b}
    for x in queue:
        if x in known:
            return x
        queue += [y for y in up[x] if y not in met and not met.add(y)]
    return None


def test_common_ancestor_equals_a_queue(spark):
    rng = random.Random(7)
    lanes: list[list[int]] = [[0], [1], [2]]  # three logs without a common root, joined by merges now and then
    up: dict[int, list[int]] = {0: [], 1: [], 2: []}
    for x in range(3, 48):
        own, other = rng.sample(lanes, 2)
        up[x] = [own[-1]] + ([rng.choice(other)] if rng.random() < 0.12 else [])
        own.append(x)
    rows = [("p", x, u[0] if u else None, "m", u[1] if len(u) > 1 else None) for x, u in up.items()]
    r = spark.createDataFrame(rows, "backing string, revid long, parent long, branch string, merge_parent long")
    want = {(a, b): first_common(up, a, b) for a, b in [(rng.randrange(48), rng.randrange(48)) for _ in range(40)] + [(0, 1), (0, 47), (5, 5)]}
    pairs = spark.createDataFrame([("p", *k) for k in want], "backing string, a long, b long")
    assert {(x.a, x.b): x.ancestor for x in history.common_ancestor(r, pairs).collect()} == want
    assert None in want.values() and history.common_ancestor(r, pairs.where("a < 0")).count() == 0


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 3, 1)], "backing string, src long, dst long")
    got = recurse.closure(edges, spark.createDataFrame([("p", 1)], "backing string, start long"))
    assert sorted((x.node, x.depth) for x in got.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_states_of_all_revisions(spark):
    """Doubling against a walk, with a fork and a chain longer than a power of two."""
    from palimpsest.operators.state import states

    rows = [(0, i, None if i == 0 else (i - 1 if i != 7 else 2), i % 4, i * 3) for i in range(21)]
    df = spark.createDataFrame(rows, "backing long, revid long, parent long, item int, k int")
    got = {r.revid: r.state for r in states(df, "k").collect()}
    for _, rev, *_ in rows:
        want, at = {}, rev
        while at is not None:
            want.setdefault(rows[at][3], rows[at][4])
            at = rows[at][2]
        assert got[rev] == want


def test_chains_stop_at_their_limit(spark):
    from palimpsest.operators.recurse import chains

    line = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(40)], "backing long, revid long, parent long")
    start = spark.createDataFrame([(0, 39)], "backing long, start long")
    for limit in (0, 1, 3, 5, 39, 50, None):
        got = sorted((r.depth, r.revid) for r in chains(line, start, limit).collect())
        assert got == [(d, 39 - d) for d in range(min(39, 39 if limit is None else limit) + 1)]


def test_long_closure_with_a_cycle(spark):
    from palimpsest.operators.recurse import closure

    edges = spark.createDataFrame([(0, i, (i + 1) % 50) for i in range(50)] + [(0, 3, 30)], "backing long, src long, dst long")
    got = {r.node: r.depth for r in closure(edges, spark.createDataFrame([(0, 0)], "backing long, start long")).collect()}
    want = {i: i if i <= 3 else min(i, 4 + i - 30) if i >= 30 else i for i in range(50)}
    assert got == want


def test_commands_are_numbered_without_a_gap(spark):
    from palimpsest.sources.commit_log import CommitLog

    m = CommitLog(spark, "/root/testdata/sf0.001")
    seqs = [r.seq for r in m.commands.select("seq").collect()]
    assert sorted(seqs) == list(range(1, len(seqs) + 1))
