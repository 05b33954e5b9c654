"""Token counts by offset-mapped attribution.

A document's fields are joined by a line feed and encoded whole, once.  Each token's
span follows from the bytes of its vocabulary entry (byte-level tokens lose nothing),
sections are intervals of the same text, and a merge of both sorted interval lists
attributes tokens to sections.  A token that crosses a boundary goes to the section
that holds most of its characters, the earlier one if equal.  A character belongs to
the token that holds its first byte.

Sections are the lines of a field (a line feed ends its section), numbered through.

Edge cases: null and empty fields are empty and have no section; a document without
text has no token; null ids and repeated rows pass through; extra columns are
ignored; one output row per input row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_state: dict[tuple[str, str], tuple] = {}
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_crossing long, sections array<struct<field:string,start:long,length:long,tokens:long>>"


def encoder(path: str, pattern: str):
    """The tokenizer and the length in bytes of each token; kept per worker process."""
    if (path, pattern) not in _state:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _state[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _state[path, pattern]


def attribute(text: str, ids: list[int], size: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Tokens per section (start, length in characters; disjoint, ascending) and how many tokens cross a boundary."""
    counts = np.zeros(len(sections), np.int64)
    if not ids or not sections:
        return counts, 0
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    stop = np.cumsum(size[ids])
    a, b = lead[stop - size[ids]], lead[stop]  # characters whose first byte a token holds
    begin = np.array([s for s, _ in sections])
    end = begin + np.array([n for _, n in sections])
    # a token without a first byte counts where the character that it continues stands
    at = np.where(b > a, a, np.maximum(a - 1, 0))
    first = np.searchsorted(begin, at, side="right") - 1
    last = np.searchsorted(begin, np.maximum(b - 1, at), side="right") - 1
    first, last = np.maximum(first, 0), np.maximum(last, 0)
    cross = np.flatnonzero(last > first)
    counts += np.bincount(np.delete(first, cross), minlength=len(sections))
    for t in cross.tolist():
        best, most = int(first[t]), -1
        for s in range(int(first[t]), int(last[t]) + 1):
            held = min(int(b[t]), int(end[s])) - max(int(a[t]), int(begin[s]))
            if held > most:
                best, most = s, held
        counts[best] += 1
    return counts, len(cross)


def _lines(text: str, start: int) -> list[tuple[int, int]]:
    out, a = [], 0
    while a < len(text):
        b = text.find("\n", a) + 1 or len(text)
        out.append((start + a, b - a))
        a = b
    return out


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """One row per document with its token count and those of its sections; a scan without a shuffle."""
    kind = pa.list_(pa.struct([("field", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(vocabulary, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = []
                for values in zip(*(b.column(1 + k).to_pylist() for k in range(len(fields))), strict=True):
                    parts = [(f, v) for f, v in zip(fields, values, strict=True) if v]
                    text = "\n".join(v for _, v in parts)
                    ids = enc.encode_ordinary(text)
                    spans, names, start = [], [], 0
                    for k, (f, v) in enumerate(parts):
                        own = _lines(v + "\n" * (k + 1 < len(parts)), start)
                        spans += own
                        names += [f] * len(own)
                        start += len(v) + 1
                    counts, crossing = attribute(text, ids, size, spans)
                    rows.append((len(text), len(ids), crossing, [{"field": f, "start": s, "length": n, "tokens": int(c)} for f, (s, n), c in zip(names, spans, counts, strict=True)]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], kind)], ["doc_id", "n_chars", "n_tokens", "n_crossing", "sections"])

    src = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", *(f"cast(`{f}` as string) `f{k}`" for k, f in enumerate(fields)))
    return src.mapInArrow(run, SCHEMA)
