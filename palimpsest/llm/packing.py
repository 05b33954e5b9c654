"""Best-fit packing: bounded-space online best-fit into sequences of fixed length.

Every document is tokenized whole, followed by token 0.  Longer documents are
cut into full pieces; what is left over is packed: a fixed number of bins is open
at a time, a bitset says which amounts of free space some open bin has, an item
goes to the open bin with the least free space that still holds it, and when a
new bin would exceed the fixed number, the fullest open bin is closed first.

Pieces are dealt to groups of about ``GROUP`` items by a hash and arrive in hash
order, each lot of ``ARRIVALS`` with its longest first, so the packing is the same in every run and no task gets more than a
group; each group leaves at most ``OPEN_BINS`` bins partly filled.

Edge cases: null and empty texts are the single token 0; null ids are packed like
others; rows that repeat are packed as often as they stand there; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernels import give_back, small_batches, stored

CAPACITY, OPEN_BINS, GROUP = 2048, 1024, 250_000
#: Items arrive in lots of this size, the longest first: small ones then close the gaps that large ones leave.
ARRIVALS = 2000
CACHE_WORDS = 1_000_000
#: Beside these a full stop or comma is a piece of its own: white space, and letters that stay one letter in lower case.
_PLAIN = r"[^A-Za-z0-9 \t\n\r\f\v\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]"
_RUN = re.compile(f"[.,]{_PLAIN}|{_PLAIN}[.,]")
#: Below this every alphabetic character is a letter to any version of the character tables.
_LATIN = "\u0250"
_state: dict[str, tuple] = {}


# How byte-level tokenizers write bytes as letters: printable ones stand for themselves, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _SELF} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


class BestFit:
    """Bounded-space best-fit over item lengths 1..capacity."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        fit = self.free >> length
        if fit:
            space = length + ((fit & -fit).bit_length() - 1)
            number = self._take(space)
        else:
            if length < self.capacity and self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.made
            self.made += 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def word_encoder(path: str):
    """texts -> list of uint32 id arrays, equal to the tokenizer's own; kept per worker process.

    Nothing in this tokenizer's pipeline joins characters across ASCII white
    space (its pieces never contain any), and it ignores the case of ASCII texts,
    so the ids of a text are those of its chunks; chunks are encoded once and kept,
    up to a bounded number.  Texts that hold an added token are encoded whole.
    """
    if path not in _state:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        _state[path] = (tok, tok.model, added, {})
    tok, model, added, cache = _state[path]

    def learn(chunks: set[bytes]) -> None:
        rest = []
        for c in chunks:
            s = c.decode("utf-8")
            if s.isalpha():  # one piece: letters only, in lower case, nothing to normalise
                if s.isascii():
                    cache[c] = array("H", [t.id for t in model.tokenize(s.lower())]).tobytes()
                    continue
                if max(s) < _LATIN and s == s.lower() and is_normalized("NFC", s):
                    cache[c] = array("H", [t.id for t in model.tokenize(c.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
                    continue
            rest.append((c, s))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for (c, _), e in zip(part, tok.encode_batch_fast([s for _, s in part], add_special_tokens=False), strict=True):
                cache[c] = array("H", e.ids).tobytes()

    def cut(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if text.isascii():
            raw = raw.lower()
        if not _RUN.search(text):
            raw = raw.replace(b".", b" . ").replace(b",", b" , ")
        return raw.split()

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(texts), 128):
            part = texts[a : a + 128]
            whole = {k: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4") for k, t in enumerate(part) if any(x in t for x in added)}
            chunks = [[] if k in whole else cut(t) for k, t in enumerate(part)]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = set().union(*chunks).difference(cache)
            if new:
                learn(new)
            get = cache.__getitem__
            out += [whole[k] if k in whole else np.frombuffer(b"".join(map(get, c)), "<u2").astype("<u4") for k, c in enumerate(chunks)]
        return out

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, with a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    n, raw = len(ids) + 1, ids.tobytes() + b"\0\0\0\0"
                    rows += [(i, k, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * min(n, s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def pack(items: DataFrame, n_items: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """items with sequence_id and offset; length must be in 1..capacity."""
    groups = max(1, -(-n_items // GROUP))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_", "doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
        pdf = pdf.iloc[np.lexsort((-pdf["length"].to_numpy(), np.arange(len(pdf)) // ARRIVALS))]
        fit, base = BestFit(capacity, open_bins), int(pdf["group_"].iloc[0]) << 36 if len(pdf) else 0
        placed = [fit.place(n) for n in pdf["length"].tolist()]
        pdf["sequence_id"] = [base + s for s, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    hashed = items.withColumn("order_", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("group_", F.pmod(F.xxhash64("order_"), F.lit(groups)))
    return hashed.groupBy("group_").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes, cuts and packs documents; the pieces are written once, since their number sets the number of groups."""
    small_batches(docs.sparkSession)
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    return pack(cut, cut.count(), capacity)
