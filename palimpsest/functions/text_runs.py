"""Texts with attributes on runs of characters: difference, operations, application, merging."""

from __future__ import annotations

from palimpsest.functions import sequences

#: A run: (text, frozenset of attributes).
Run = tuple[str, frozenset]
#: (kind, location, length, text or attribute, source)
Op = tuple[str, int, int, object, str]


def plain(runs: list[Run]) -> str:
    return "".join(t for t, _ in runs)


def marks(runs: list[Run]) -> list[frozenset]:
    """Attributes of every character."""
    return [a for t, a in runs for _ in t]


def compact(text: str, attrs: list[frozenset]) -> list[Run]:
    """Runs from characters: neighbours of equal attributes are one run."""
    out: list[list] = []
    for c, a in zip(text, attrs, strict=True):
        if out and out[-1][1] == a:
            out[-1][0] += c
        else:
            out.append([c, a])
    return [(t, a) for t, a in out]


def chunk_at(runs: list[Run], index: int) -> tuple[int, int]:
    """(number of the run, where it starts) that holds a character."""
    at = 0
    for n, (t, _) in enumerate(runs):
        if index < at + len(t):
            return n, at
        at += len(t)
    raise IndexError(index)


def diff(a: list[Run], b: list[Run], source: str = "") -> list[Op]:
    """Operations from a to b: text is inserted, deleted or replaced with its attributes; attributes change on what stays."""
    x, y, p, q = plain(a), plain(b), marks(a), marks(b)
    edits, grown = [], 0
    for kind, at, gone, new in sequences.diff(x, y):
        j = at + grown
        edits.append((kind, at, gone, tuple(compact("".join(new), q[j : j + len(new)])), source))
        grown += len(new) - gone
    runs: list[list] = []
    for i, k in sequences.matches(x, y):
        for sign, some in (("add", q[k] - p[i]), ("remove", p[i] - q[k])):
            for name in sorted(some):
                last = next((r for r in reversed(runs) if r[0] == sign and r[3] == name), None)
                if last and last[1] + last[2] == i:
                    last[2] += 1
                else:
                    runs.append([sign, i, 1, name])
    return sorted([*edits, *((s, at, n, name, source) for s, at, n, name in runs)], key=lambda o: (o[1], o[0]))


def apply(runs: list[Run], ops: list[Op]) -> list[Run]:
    """Attribute operations first (they keep places), then text operations by position."""
    text, attrs = plain(runs), marks(runs)
    for kind, at, n, name, _ in ops:
        if kind in ("add", "remove"):
            for i in range(at, at + n):
                attrs[i] = attrs[i] | {name} if kind == "add" else attrs[i] - {name}
    edits = [(k, at, n, list(zip(plain(list(v)), marks(list(v)), strict=True))) for k, at, n, v, _ in ops if k in ("insert", "delete", "modify")]
    out = sequences.apply(list(zip(text, attrs, strict=True)), edits)
    return compact("".join(c for c, _ in out), [a for _, a in out])


def merge(first: list[Op], second: list[Op], favoured: str) -> list[Op]:
    """Both sides' operations by location, the favoured source first; nothing conflicts."""
    return sorted([*first, *second], key=lambda o: (o[1], o[4] != favoured))
