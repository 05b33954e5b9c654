"""Differences of two sequences and their application."""

from __future__ import annotations

from collections.abc import Sequence

#: kind, position in the old sequence, length there, new values
Edit = tuple[str, int, int, list]


def matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence (greedy shortest edit script after trimming equal ends)."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    reach, trail = {1: 0}, []
    done = not x and not y
    for d in range(len(x) + len(y) + 1):
        if done:
            break
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            j = i - k
            while i < len(x) and j < len(y) and x[i] == y[j]:
                i, j = i + 1, j + 1
            reach[k] = i
            if i >= len(x) and j >= len(y):
                done = True
                break
    i, j, middle = len(x), len(y), []
    for d in range(len(trail) - 1, -1, -1):
        v, k = trail[d], i - j
        before = k + 1 if k == -d or (k != d and v[k - 1] < v[k + 1]) else k - 1
        pi = v[before] if d else 0
        pj = pi - before if d else 0
        start_i = (pi if before == k + 1 else pi + 1) if d else 0
        while i > start_i:
            i, j = i - 1, j - 1
            middle.append((i + head, j + head))
        i, j = pi, pj
    out = [(k, k) for k in range(head)] + middle[::-1]
    return out + [(n - tail + k, m - tail + k) for k in range(tail)]


def diff(a: Sequence, b: Sequence) -> list[Edit]:
    """Edits in order: an insertion and a deletion at one point are one modification."""
    out: list[Edit] = []
    i = j = 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        gone, new = p - i, list(b[j:q])
        if gone or new:
            out.append(("modify" if gone and new else "delete" if gone else "insert", i, gone, new))
        i, j = p + 1, q + 1
    return out


def apply(a: Sequence, edits: Sequence[Edit]) -> list:
    """a with the edits of one or more scripts: by position, deletions before insertions; equal ones count once; edits at one position share their offset."""
    ordered = sorted(edits, key=lambda e: (e[1], e[0] == "insert"))
    out, shift, offset, last = list(a), 0, 0, None
    for n, e in enumerate(ordered):
        if n + 1 < len(ordered) and ordered[n + 1] == e:
            continue
        if e[1] != last:
            offset = shift
        at = e[1] + offset
        out[at : at + e[2]] = e[3]
        shift += len(e[3]) - e[2]
        last = e[1]
    return out


def overlap(x: Edit, y: Edit) -> bool:
    """Whether two edits touch the same place; insertions conflict at the same point or inside a range."""
    (_, a, n, _), (_, b, m, _) = x, y
    if not n and not m:
        return a == b
    if not n:
        return b < a < b + m
    if not m:
        return a < b < a + n
    return a < b + m and b < a + n
