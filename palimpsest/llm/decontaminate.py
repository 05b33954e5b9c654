"""Benchmark decontamination: spaced-seed hashing and substitution-tolerant verification.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII letters
in lower case.  A document overlaps a benchmark item where ``SPAN`` consecutive
words of each, laid word against word, agree in at least ``AGREE`` places; an
item of ``LEAST`` to SPAN - 1 words must stand in the document whole.  An overlap has
LEAST words at least, so shorter items overlap nothing (they stand in clean text by
chance).

Each of the ``MASKS`` ignores six of thirteen positions; every pair of positions is
ignored by some mask, so windows that agree but for two substitutions have an equal
seed whatever they are.

1. *Benchmark.*  Every window of every item, once for each content, with its seeds.
2. *Filter.*  A bitmap of the seeds, ``BITS`` bits to a seed and ``MOST`` bits in all, goes to the
   executors, whatever the benchmark's size; only windows of documents with a
   seed in it are kept.  A larger benchmark lets more windows through, no others.
3. *Join.*  Windows of documents, once for each content, and windows of items are joined
   by seed; pairs are verified on their words.  A passage that a third of all documents
   share is joined and verified once.
4. *Overlaps.*  Verified windows return to their documents and items; those of one
   diagonal make one overlap.

Edge cases: null texts and items without enough words overlap nothing, nor do items
without id; null ids and repeated rows of documents pass through (one output row per
input row); items of equal text are all reported, rows of one item id are one item;
extra columns stay, whatever their names, a clashing ``overlaps`` is replaced; with an empty
benchmark nothing overlaps, an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernels import _BASE, ALNUM_WORD, FOLD, U64, Texts, Words, fresh, marked, mix, small_batches, stored, text_slices

SPAN, AGREE, LEAST = 13, 11, 8
MASKS = ("1010110010011", "0101111100100", "1110001001110", "0011001111001", "0100110011101", "1001000110111", "1001110101010")
#: Bits to a seed in the filter, bits at most (32 MB), and places that each seed marks.
BITS, MOST, MARKS = 64, 1 << 28, 3
#: A window's documents are joined in so many parts.
SALTS = 16
KIND = "array<struct<item_id:bigint,doc_start:int,item_start:int,length:int,agree:int>>"
_WINDOW = "doc_id long, text_hash long, at int, key binary, win binary, seeds array<long>"


def seeds(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the masked words at every position whose span lies in one document."""
    total, k = len(w.hash), len(mask)
    if total < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    m = total - k + 1
    h = np.full(m, U64(int(mask, 2) + (k << 20)))
    for j, c in enumerate(mask):
        if c == "1":
            h += w.hash[j : j + m] * U64(pow(_BASE, 2 * j + 3, 1 << 64))
    last = np.repeat(w.first[1:], w.count)[:m]
    ok = np.flatnonzero(np.arange(m) + k <= last)
    return mix(h[ok]), ok


def mark(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th place of each seed in a filter of so many bits (a power of two)."""
    return (mix(h + U64(k * 0x51ED27)) & U64(bits - 1)).astype(np.int64)


class Flat:
    """The words of a slice, one space after each."""

    def __init__(self, t: Texts, w: Words):
        size = w.end - w.start
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.data = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        edge = np.cumsum(size) - size
        self.data[np.arange(int(size.sum())) + np.repeat(self.start - edge, size)] = FOLD[t.data[ALNUM_WORD[t.data]]]

    def words(self, a: int, n: int) -> bytes:
        return self.data[self.start[a] : self.end[a + n - 1]].tobytes()


def _windows(lengths: tuple[int, ...], whole: bool, filter_=None):
    """Windows of texts: all of an item (whole: shorter items as they are), or those of documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            w = Words(t, ALNUM_WORD, FOLD)
            found: dict[tuple[int, int], list[int]] = {}
            for mask in (*MASKS, *("1" * n for n in lengths)):
                h, at = seeds(w, mask)
                if len(mask) < SPAN and whole:
                    own = np.repeat(w.count, w.count)[at] == len(mask)
                    h, at = h[own], at[own]
                if filter_ is not None:
                    table = filter_.value
                    for k in range(MARKS):
                        spot = mark(h, 64 * len(table), k)
                        near = (table[spot >> 6] >> (spot & 63).astype(U64)) & U64(1) > 0
                        h, at = h[near], at[near]
                for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                    found.setdefault((a, len(mask)), []).append(x)
            if not found:
                continue
            flat, owner, seen = Flat(t, w), w.doc(), set()
            ids, hashes = (t.rows.column(k).to_pylist() for k in (0, 1))
            rows = []
            for (a, n), hs in sorted(found.items()):
                win = flat.words(a, n)
                key = hashlib.blake2b(win, digest_size=16).digest()
                new = key not in seen  # the words of a content go once from each slice
                seen.add(key)
                d = int(owner[a])
                rows.append((ids[d], hashes[d], a - int(w.first[d]), key, win if new else None, hs if new else None))
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "text_hash", "at", "key", "win", "seeds"])

    return run


def _contents(windows: DataFrame, name: str) -> DataFrame:
    """(seed, key, words) once for each content and seed."""
    once = windows.where("win is not null").selectExpr("key", "win", "inline(transform(seeds, s -> struct(s as seed)))")
    return once.distinct().selectExpr("seed", f"key {name}", f"split(cast(win as string), ' ') {name}_words")


def _filter(spark, items: DataFrame):
    """Broadcast bitmap of the items' seeds."""
    known = items.where("win is not null").selectExpr("inline(transform(seeds, s -> struct(s as seed)))").distinct()
    n = known.count()
    bits = min(MOST, max(1 << 16, 1 << (BITS * max(1, n) - 1).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = np.concatenate([mark(b.column(0).to_numpy().view(U64), bits, k) for k in range(MARKS)])
            word, bit = spot >> 6, U64(1) << (spot & 63).astype(U64)
            order = np.argsort(word, kind="stable")
            lead = np.flatnonzero(np.diff(word[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(word[order][lead]), pa.array(np.bitwise_or.reduceat(bit[order], lead).view(np.int64) if len(lead) else np.empty(0, np.int64))], ["word", "bits"])

    got = known.mapInArrow(spots, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # MOST / 64 rows at most
    table = np.zeros(bits >> 6, U64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return spark.sparkContext.broadcast(table)


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, overlaps) of the documents that overlap something."""
    spark = docs.sparkSession
    keyed = benchmark.where("text is not null and item_id is not null").selectExpr("cast(item_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    texts = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    small_batches(spark)
    items = stored(keyed.mapInArrow(_windows(tuple(range(LEAST, SPAN)), True), _WINDOW), "item-windows")
    short = tuple(sorted(r[0] for r in items.where("win is not null").selectExpr("size(split(cast(win as string), ' ')) n").where(f"n < {SPAN}").distinct().collect()))
    near = stored(texts.mapInArrow(_windows(short, False, _filter(spark, items)), _WINDOW), "windows")
    pairs = _contents(near, "key").join(_contents(items, "item_key"), "seed").select("key", "item_key", "key_words", "item_key_words").distinct()
    agree = "size(filter(zip_with(key_words, item_key_words, (x, y) -> x = y), z -> z))"
    same = f"size(key_words) = size(item_key_words) and agree >= if(size(key_words) = {SPAN}, {AGREE}, size(key_words))"
    good = pairs.withColumn("agree", F.expr(agree)).where(same).selectExpr("key", "item_key", "agree", "size(key_words) words")
    places = items.selectExpr("doc_id item_id", "at item_at", "key item_key").distinct()
    met = good.join(places, "item_key").selectExpr("key", "item_id", "item_at", "agree", "words", f"explode(sequence(0L, {SALTS - 1}L)) salt")
    rows = near.selectExpr("doc_id", "text_hash", "at", "key", f"pmod(xxhash64(doc_id, text_hash), {SALTS}) salt").join(met, ["key", "salt"])
    first, last = F.min("at").alias("first"), F.max("at").alias("last")
    runs = rows.groupBy("doc_id", "text_hash", "item_id", F.expr("at - item_at").alias("shift"), "words").agg(first, last, F.max("agree").alias("agree"))
    one = "struct(item_id, first as doc_start, first - shift as item_start, last - first + words as length, agree)"
    return stored(runs.selectExpr("doc_id", "text_hash", f"{one} o").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("o")).alias("overlaps")), "overlaps")


def _joined(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Documents that surely overlap nothing, and the others joined with their overlaps, in the column named.

    Only documents that a bitmap of the overlapping ones lets through are shuffled.
    """
    hash_, id_, met_, over_ = fresh(docs.columns, "own_hash", "found_id", "found_hash", "found_overlaps")
    found = _found(docs, benchmark).selectExpr(f"doc_id `{id_}`", f"text_hash `{met_}`", f"overlaps `{over_}`")
    keyed = docs.withColumn(hash_, F.xxhash64(F.col("text").cast("string")))
    maybe, rest = marked(keyed, f"struct(cast(doc_id as long), `{hash_}`)", found, f"struct(`{id_}`, `{met_}`)")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(met_))
    return rest, maybe.join(found, same, "left"), over_


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with ``overlaps``: each benchmark item that stands in the text, where, and how many words of its best window agree."""
    docs = docs.drop("overlaps")
    rest, some, over_ = _joined(docs, benchmark)
    none = F.expr(f"cast(array() as {KIND})")
    return rest.select(*docs.columns, none.alias("overlaps")).unionByName(some.select(*docs.columns, F.coalesce(F.col(over_), none).alias("overlaps")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap the benchmark."""
    rest, some, over_ = _joined(docs, benchmark)
    return rest.select(*docs.columns).unionByName(some.where(F.col(over_).isNull()).select(*docs.columns))
