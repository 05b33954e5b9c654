"""Substring dedup: fixed-block anchors, rolling probes, extension to maximal exact repeats.

A repeat is a window of ``WINDOW`` words that also starts in a document with a
smaller id.  Four steps, each a scan with one shuffle of packed binary rows:

1. *Anchors.*  The non-overlapping blocks of ``BLOCK`` words of every document
   are the index, every rolling run of BLOCK words of every document is a probe
   (WINDOW = 2 * BLOCK - 1, so each window holds one whole aligned block of the
   document it was copied from).  Hashes are dealt to buckets; a probe hits if
   some aligned block elsewhere has its hash.  Equal hashes of one lot of
   documents are sent once, and there are at most ``LOTS`` lots unless these would
   exceed ``MOST``, so a block that a third of all documents share adds a bounded
   number of entries to its bucket.
2. *Candidates.*  Windows around hits are formed; 128 bits of hash resolve each to
   its smallest document and place there, again once per lot.
3. *Extension.*  Neighbouring windows that come from neighbouring places of one
   document are one maximal repeat.  Its words are cut, and its words as they stand
   (a 128-bit cryptographic digest) are claimed of the source.
4. *Proof.*  Every claim is held against the words of its source.  If one fails (two
   word sequences with one hash), all is done again with other hash constants.

Edge cases: null text has no word; documents of fewer than WINDOW words keep all;
null ids neither lose words nor make others lose any; equal ids are one document
for the comparison, but each row is cut by its own text; extra columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernels import IDENTITY, SPACE_WORD, U64, Words, among, dropped, grams, mix, small_batches, stored, text_slices

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Documents are hashed in parts of PART bytes; a lot gathers parts. Lots grow with the table so that there are at most LOTS.
PART, MOST, LOTS = 2 << 20, 64 << 20, 1 << 20
#: Bytes of text, and windows, per bucket: bounds what one task sorts at once.
BUCKET_TEXT, BUCKET_WINDOWS = 16 << 20, 1_500_000
#: Claims of one source within so many words of it are proven together.
REACH = 4096
#: All bits of a window's hash count.
ALL_BITS = 2**64 - 1
#: kind 0: entries for a bucket; 1: resolved places of a lot; 2: documents of a lot.
_ROWS = "key long, kind byte, lot long, payload binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("lot", pa.int64()), ("payload", pa.binary())])
_HIT = "doc_id long, text_hash long, at binary"
_WINDOWS = np.dtype([("doc", "<i8"), ("b", "<u8"), ("a", "<u4"), ("at", "<u4"), ("own", "<u4")])
#: A repeated window and its source; a run of them.
_PLACE = np.dtype([("at", "<u4"), ("own", "<u4"), ("doc", "<i8")])
_RUN = np.dtype([("at", "<u4"), ("n", "<u4"), ("own", "<u4"), ("doc", "<i8")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


@dataclass
class Lot:
    """Runs of k words of a lot of documents: hash, place in the lot, place in the document."""

    ids: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    h: np.ndarray
    at: np.ndarray
    own: np.ndarray
    second: np.ndarray

    def directory(self) -> tuple[int, bytes]:
        """Name and directory. The name depends on the documents alone: a task that runs again names its lot alike."""
        load = struct.pack("<q", len(self.ids)) + self.ids.astype("<i8").tobytes() + self.hashes.astype("<i8").tobytes() + self.counts.astype("<i8").tobytes()
        return int.from_bytes(hashlib.blake2b(load, digest_size=8).digest(), "little", signed=True), load

    def doc(self) -> np.ndarray:
        """The id of each run's document."""
        return self.ids[np.searchsorted(np.cumsum(self.counts), self.at, side="right")]


def _lots(batches: Iterator[pa.RecordBatch], size: int, k: int, seed: int, near=None) -> Iterator[Lot]:
    """Lots of about size bytes of text; near(t, w, at) says which runs are wanted, all if it is None."""
    parts: list[tuple] = []
    words = held = 0
    for t in text_slices(batches, min(PART, size)):
        w = Words(t, SPACE_WORD, IDENTITY, seed)
        h, at = grams(w, k, 2 * seed + 1)
        if near is not None and len(h):
            some = near(t, w, at)
            h, at = h[some], at[some]
        second = np.zeros(len(at), U64)
        if near is not None:  # the second half of each hash is chained, with other constants
            for j in range(k):
                second = mix((second ^ w.hash[at + j]) * U64(0xFF51AFD7ED558CCD) + U64(j + 1))
        own = at - np.repeat(w.first[:-1], w.count)[at] if len(at) else at
        parts.append((*(t.rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), w.count, h, at + words, own, second))
        words += len(w.hash)
        held += len(t.data)
        if held >= size:
            yield Lot(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, words, held = [], 0, 0
    if parts:
        yield Lot(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """Order by bucket, and (bucket, from, to) of the buckets that occur."""
    bucket = ((h >> U64(32)) % U64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    of = bucket[by]
    lead = np.flatnonzero(np.diff(of, prepend=-1))
    return by, zip(of[lead].tolist(), lead.tolist(), np.append(lead[1:], len(of)).tolist(), strict=True)


def _probe(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, size, BLOCK, 0):
            h, at = lot.h, lot.at
            if not len(h):
                continue
            order, lead, times = _groups(h)
            any_aligned = np.logical_or.reduceat((lot.own % BLOCK == 0)[order], lead)
            name, load = lot.directory()
            out = [(name, 2, name, load)]
            twice = np.repeat(times > 1, times)  # whether some block is aligned may be known elsewhere only
            if twice.any():
                out.append((name, 1, name, np.sort(at[order[twice]]).astype("<u4").tobytes()))
            # one entry per hash, in text order, for its bucket
            pos = np.sort(order[lead])
            flag = np.zeros(len(h), bool)
            flag[order[lead]] = any_aligned
            x, p = h[pos], at[pos]
            low = (x & U64(0xFFFFFFFE)).astype("<u4") | flag[pos].astype("<u4")
            by, edges = _dealt(x, buckets)
            low, p = low[by], p[by].astype("<u4")
            for b, i, j in edges:
                step = np.diff(p[i:j], prepend=p[i])
                wide = step.max() > 65535
                out.append((b, 0, name, struct.pack("<IIB", j - i, int(p[i]), bool(wide)) + low[i:j].tobytes() + step.astype("<u4" if wide else "<u2").tobytes()))
            yield _rows(out)

    return run


def _bucket(pick):
    """Runs pick over all entries of a bucket; other rows pass."""

    def run(t: pa.Table) -> pa.Table:
        mine = np.array(t.column("kind")) == 0
        rest = t.filter(pa.array(~mine)).select(_SCHEMA.names).cast(_SCHEMA)
        t = t.filter(pa.array(mine))
        if not t.num_rows:
            return rest
        return pa.concat_tables([rest, pa.Table.from_batches([_rows(list(pick(t.column("lot").to_pylist(), t.column("payload").to_pylist())))])])

    return run


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns (the last is the main one), where groups of equal rows begin, and their sizes."""
    order = np.lexsort(columns) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    lead = np.flatnonzero(new)
    return order, lead, np.diff(np.append(lead, len(order)))


def _split(names: list[int], sizes: list[int], hit: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    a = 0
    for name, n in zip(names, sizes, strict=True):
        got = rows[a : a + n][hit[a : a + n]]
        if len(got):
            yield (name, 1, name, got.tobytes())
        a += n


def _pick_hits(names: list[int], loads: list[bytes]) -> Iterator[tuple]:
    low, at, sizes = [], [], []
    for x in loads:
        n, first, wide = struct.unpack_from("<IIB", x)
        low.append(np.frombuffer(x, "<u4", n, 9))
        at.append(first + np.cumsum(np.frombuffer(x, "<u4" if wide else "<u2", n, 9 + 4 * n), dtype=np.int64))
        sizes.append(n)
    low, at = np.concatenate(low), np.concatenate(at)
    order, lead, size = _groups(low >> 1)
    good = (size > 1) & (np.bitwise_or.reduceat(low[order], lead) & 1).astype(bool)
    hit = np.zeros(len(low), bool)
    hit[order[np.repeat(good, size)]] = True
    yield from _split(names, sizes, hit, at.astype("<u4"))


def _sourced(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows repeat one of a document with a smaller id, and each window's place with its source."""
    order = np.lexsort((rec["own"], rec["doc"], rec["a"], rec["b"]))
    a, b = rec["a"][order], rec["b"][order]
    lead = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    first = np.repeat(order[lead], np.diff(np.append(lead, len(rec))))
    out = np.empty(len(rec), _PLACE)
    out["at"] = rec["at"]
    out["own"][order], out["doc"][order] = rec["own"][first], rec["doc"][first]
    return rec["doc"] > out["doc"], out


def _pick_repeats(names: list[int], loads: list[bytes]) -> Iterator[tuple]:
    sizes = [len(x) // _WINDOWS.itemsize for x in loads]
    hit, places = _sourced(np.frombuffer(b"".join(loads), _WINDOWS))
    yield from _split(names, sizes, hit, places)


def _resolve(runs: bool):
    """Places in a lot -> places in its documents (numbers of words from 0), or runs of them with their sources."""

    def run(t: pa.Table) -> pa.Table:
        kinds = np.array(t.column("kind"))
        loads = t.column("payload").to_pylist()
        known = [x for k, x in zip(kinds, loads, strict=True) if k == 2]
        places = [np.frombuffer(x, _PLACE if runs else "<u4") for k, x in zip(kinds, loads, strict=True) if k == 1]
        out: list[tuple] = []
        if places:
            if not known:
                raise RuntimeError("a lot lost its directory: the input changed between attempts of a task")
            n = struct.unpack_from("<q", known[0])[0]
            ids, hashes, counts = (np.frombuffer(known[0], "<i8", n, 8 + 8 * n * i) for i in range(3))
            first = np.concatenate([[0], np.cumsum(counts)])
            found = np.concatenate(places)
            at = (found["at"] if runs else found).astype(np.int64)
            _, once = np.unique(at, return_index=True)
            found, at = found[once], at[once]
            doc = np.searchsorted(first, at, side="right") - 1
            if runs:
                new = np.ones(len(at), bool)
                own = found["own"].astype(np.int64)
                new[1:] = (np.diff(at) != 1) | (np.diff(own) != 1) | (np.diff(found["doc"]) != 0) | (np.diff(doc) != 0)
                lead = np.flatnonzero(new)
                rows = np.empty(len(lead), _RUN)
                rows["at"], rows["own"], rows["doc"] = at[lead] - first[doc[lead]], own[lead], found["doc"][lead]
                rows["n"] = np.diff(np.append(lead, len(at)))
                doc = doc[lead]
            else:
                rows = (at - first[doc]).astype("<u4")
            lead = np.flatnonzero(np.diff(doc, prepend=-1))
            for d, i, j in zip(doc[lead].tolist(), lead.tolist(), np.append(lead[1:], len(doc)).tolist(), strict=True):
                out.append((int(ids[d]), int(hashes[d]), rows[i:j].tobytes()))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": pa.array(a, pa.int64()), "text_hash": pa.array(b, pa.int64()), "at": pa.array(c, pa.binary())})

    return run


def _resolved(rows: DataFrame, pick, runs: bool, what: str) -> DataFrame:
    """One row per document with something found; copies of a row (id and text) count once."""
    found = rows.groupBy("key").applyInArrow(_bucket(pick), _ROWS)
    places = found.groupBy("lot").applyInArrow(_resolve(runs), _HIT)
    return stored(places.groupBy("doc_id", "text_hash").agg(F.max("at").alias("at")), what)


def _extend(buckets: int, size: int, seed: int, bits: int):
    def near(t, w: Words, at: np.ndarray) -> np.ndarray:
        """Windows whose first BLOCK runs hold a hit."""
        mark = np.zeros(len(w.hash) + WINDOW, bool)
        for d, x in enumerate(t.rows.column(3).to_pylist()):
            if x is not None:
                mark[w.first[d] + np.frombuffer(x, "<u4").astype(np.int64)] = True
        hits = np.concatenate([[0], np.cumsum(mark)])
        return np.flatnonzero(hits[at + BLOCK] > hits[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, size, WINDOW, seed, near):
            if not len(lot.h):
                continue
            h = lot.h & U64(bits)
            rec = np.empty(len(h), _WINDOWS)
            rec["doc"], rec["b"], rec["a"], rec["at"], rec["own"] = lot.doc(), lot.second & U64(bits), h & U64(0xFFFFFFFF), lot.at, lot.own
            # what repeats a smaller document of the lot is settled here
            gone, places = _sourced(rec)
            name, load = lot.directory()
            out = [(name, 2, name, load)]
            if gone.any():
                out.append((name, 1, name, places[gone].tobytes()))
            stay = np.flatnonzero(~gone)
            by, edges = _dealt(h[stay], buckets)
            sent = rec[stay][by]
            out += [(b, 0, name, sent[i:j].tobytes()) for b, i, j in edges]
            yield _rows(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its repeats, and the words that each repeat claims of its source."""
    claim = pa.list_(pa.struct([("doc", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))
    for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        n_words, n_removed, kept, claims = [], [], [], []
        for text, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            said = []
            if at is not None:
                gone = np.zeros(len(words) + 1, np.int32)
                for s, n, own, doc in np.frombuffer(at, _RUN).tolist():
                    stop = s + n + WINDOW - 1
                    gone[s] += 1
                    gone[stop] -= 1
                    said.append({"doc": doc, "own": own, "n": stop - s, "digest": hashlib.blake2b(b" ".join(words[s:stop]), digest_size=16).digest()})
                stay = np.cumsum(gone)[:-1] == 0
                words = [x for x, k in zip(words, stay.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
            claims.append(said)
        cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(claims, claim)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept", "claims"])


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims that the words of their source bear out."""
    for batch in batches:
        out = []
        for doc, text, claims in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            out += [(doc, c["own"], c["n"], c["digest"]) for c in claims if hashlib.blake2b(b" ".join(words[c["own"] : c["own"] + c["n"]]), digest_size=16).digest() == c["digest"]]
        cols = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "own", "n", "digest"])


def _refuted(known: DataFrame, cut: DataFrame) -> bool:
    """Whether some repeat's words do not stand in its source."""
    claims = stored(cut.selectExpr("inline(claims)").distinct(), "claims")
    by_source = claims.groupBy("doc", F.expr(f"own div {REACH}").alias("reach")).agg(F.collect_list(F.struct("own", "n", "digest")).alias("claims")).drop("reach")
    texts = among(known.selectExpr("doc_id doc", "text"), claims.select("doc"), "doc")
    proven = by_source.join(texts, "doc").select("doc", "text", "claims").mapInArrow(_proven, "doc long, own long, n long, digest binary")
    return not claims.join(proven, ["doc", "own", "n", "digest"], "left_anti").isEmpty()


def dedup_substrings(docs: DataFrame, bits: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept: documents without the words that repeat earlier documents.

    ``bits`` masks the window hashes of the first rounds, for tests of what happens when hashes collide.
    """
    spark = docs.sparkSession
    src = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    known = src.where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lot = min(MOST, max(PART, size // LOTS))
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    hits = _resolved(known.mapInArrow(_probe(max(spread, -(-size // BUCKET_TEXT)), lot), _ROWS), _pick_hits, False, "anchors")
    n = hits.agg(F.sum(F.octet_length("at") / 4)).first()[0] or 0
    buckets = max(spread, -(-int(n) // BUCKET_WINDOWS))
    seed = 0
    while True:
        seed += 1
        mask = bits[seed - 1] if seed <= len(bits) else ALL_BITS
        near = among(known, hits, "doc_id", "text_hash").join(hits, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "at")
        repeats = _resolved(near.mapInArrow(_extend(buckets, lot, seed, mask), _ROWS), _pick_repeats, True, "repeats")
        joined = src.join(repeats, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "at")
        cut = stored(joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, claims array<struct<doc:long,own:long,n:long,digest:binary>>"), "cut")
        dropped(repeats)
        if not _refuted(known, cut):
            break
        dropped(cut)
    dropped(hits)
    return cut.drop("claims")
