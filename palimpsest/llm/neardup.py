"""MinHash near-dedup: Order MinHash over occurrence-labelled word 5-grams, verified by banded alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII letters
in lower case.  A text's shingles are its runs of ``K`` words.  Two texts are
linked if an order-preserving alignment of their shingle sequences keeps L of n
and m with L / (n + m - L) >= ``SIMILARITY``, for all shingles and also for the distinct
ones in order of first occurrence; texts of equal word sequence are linked too.  A
class is a connected component.

1. *Copies.*  Texts of equal word sequence (128-bit hash) become one
   representative by aggregation, so thousands of copies cost one.
2. *Sketches.*  Each of ``SKETCHES`` sketches takes the ``MINIMA`` smallest hashed
   shingles (labelled with their occurrence number) in text order: equal with a
   probability of about SIMILARITY ** MINIMA for a linked pair.
3. *Candidates.*  Within a bucket of equal sketches nobody is paired with
   everybody: members are paired with the bucket's most popular member, with a
   random one, and with the most popular one of the finer bucket that shares the
   next sketch too.  All leaders come from aggregations, so large buckets are
   split by map-side combining, and joins with leaders deal a bucket in lots of ``SPLIT``.
4. *Remainder.*  What the links found so far leave is exact: in every bucket that holds
   several components of them, all members outside the largest one are compared with all others by
   lengths and histograms, in blocks of ``BLOCK`` and four times as many.  A bucket that
   would take more than ``COMPARED`` comparisons is split by a second sketch first (every
   later one, since a linked pair shares about ten of twenty), and once more by a third.
   That only joins components: such buckets are then compared as a whole, where they still hold several.
   Memory is bounded throughout.
5. *Verification.*  The sum of the lesser counts of two histograms of distinct shingles bounds
   what any alignment of these can keep; pairs that this bound and the lengths allow are aligned on
   their texts inside the band that the similarity leaves.
6. *Components* by alternating large and small stars on the verified links.

Edge cases: null text is alone in its class; texts without five words are linked by
equality only (empty ones too); equal ids are told apart by their texts; the class
id is the smallest id of the class (null ids come first); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._kernels import ALNUM_WORD, FOLD, U64, Words, among, dropped, fresh, give_back, grams, mix, sequences, small_batches, stored, text_slices

K, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 20, 3
SPLIT, BLOCK, DEPTH = 1000, 400, 3
#: Comparisons of sketches in one bucket, about a second's work, beyond which a further sketch joins components first.
COMPARED = 1 << 22
#: Bins of a histogram of shingles: at least BINS, about half as many as shingles, at most MAX_BINS; counts stop at FULL.
BINS, MAX_BINS, FULL = 256, 4096, 255
_POS = 24  # low bits of a hashed shingle that hold its place
_FACTORS = mix(np.arange(1, SKETCHES + 1, dtype=U64)) | U64(1)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents in order, and how many each has."""
    h, _ = grams(w, K, 3)
    return h, np.maximum(w.count - K + 1, 0)


def occurrences(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each shingle stood in its document before."""
    n = n[n > 0]
    doc = np.repeat(np.arange(len(n), dtype=U64), n)
    key = mix(h + doc * U64(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    at = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    times = np.empty(len(h), U64)
    times[order] = (at - begin).astype(U64)
    return times


def sketch(h: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(documents with shingles) x SKETCHES keys."""
    n = n[n > 0]
    first, at = np.cumsum(n) - n, np.arange(len(h))
    label = mix(h + times * U64(0xC2B2AE3D27D4EB4F))
    place = (at - np.repeat(first, n)).astype(U64) & U64((1 << _POS) - 1)
    out = np.empty((len(n), SKETCHES), np.int64)
    high, low = U64(~((1 << _POS) - 1) & (2**64 - 1)), U64((1 << _POS) - 1)
    for j in range(SKETCHES):
        v = label * _FACTORS[j]
        v ^= v >> U64(31)
        v = ((v * U64(0x9E3779B97F4A7C15)) & high) | place
        least = np.empty((len(n), MINIMA), U64)
        for r in range(MINIMA):
            least[:, r] = np.minimum.reduceat(v, first)
            if r + 1 < MINIMA:
                v[first + np.minimum((least[:, r] & low).astype(np.int64), n - 1)] = U64(2**64 - 1)
        by = np.argsort(least & low, axis=1, kind="stable")
        least = np.take_along_axis(least, by, 1) & high
        k = np.full(len(n), U64(j))
        for r in range(MINIMA):
            k = mix(k ^ least[:, r])
        out[:, j] = k.view(np.int64)
    return out


def histograms(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each document, how many of its distinct shingles (n of them) fall into each bin."""
    bins = np.array([min(MAX_BINS, max(BINS, 1 << max(0, int(x).bit_length() - 1))) for x in n], np.int64)
    base = np.concatenate([[0], np.cumsum(bins)])
    spot = np.repeat(base[:-1], n) + (h & (np.repeat(bins, n) - 1).astype(U64)).astype(np.int64)
    flat = np.minimum(np.bincount(spot, minlength=base[-1]), FULL).astype(np.uint8)
    return [flat[a:b].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def folded(hist: bytes, bins: int) -> np.ndarray:
    """A histogram with fewer bins; a full bin counts as without bound."""
    x = np.frombuffer(hist, np.uint8).astype(np.int32)
    return np.where(x == FULL, 1 << 20, x).reshape(-1, bins).sum(0)


def needed(n: int, m: int) -> int:
    """How many shingles an alignment of n and m must keep."""
    return math.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in text_slices(batches):
        w = Words(t, ALNUM_WORD, FOLD)
        h, n = shingles(w)
        # no word: equal only to the same text
        keys = [hashlib.blake2b(x if x else b"\0" + t.text(d), digest_size=16).digest() for d, x in enumerate(sequences(t, ALNUM_WORD, FOLD))]
        sk: list = [None] * len(t)
        hist: list = [None] * len(t)
        once = np.zeros(len(t), np.int64)
        if len(h):
            times, some = occurrences(h, n), np.flatnonzero(n)
            once[some] = np.add.reduceat(times == 0, np.cumsum(n[some]) - n[some])
            for d, row, x in zip(some, sketch(h, n, times), histograms(h[times == 0], once[some]), strict=True):
                sk[d], hist[d] = row, x
        cols = [t.rows.column(0), t.rows.column(1), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)), pa.array(once), pa.array(sk, pa.list_(pa.int64())), pa.array(hist, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "c", "n", "d", "sk", "hist"])
    give_back()


def align(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment within the band keeps enough shingles."""
    n, m = len(a), len(b)
    need = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
    if min(n, m) < need:
        return False
    k = min(n, m)
    diff = np.flatnonzero(a[:k] != b[:k])
    head = int(diff[0]) if len(diff) else k
    diff = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(diff[0]) if len(diff) else k - head
    a, b, need = a[head : n - tail], b[head : m - tail], need - head - tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    band = n + m - 2 * (need + head + tail)
    symbols, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ids[: len(a)], ids[len(a) :]
    ca, cb = np.bincount(ia, minlength=len(symbols)), np.bincount(ib, minlength=len(symbols))
    if int(np.minimum(ca, cb).sum()) < need:
        return False
    if int((ca * cb).sum()) > 64 * (len(a) + len(b)):
        return _bits(ia, ib, band) >= need
    where: dict[int, list[int]] = {}
    for j, s in enumerate(ib.tolist()):
        if ca[s]:
            where.setdefault(s, []).append(j)
    tails: list[int] = []
    left = len(a)
    for i, s in enumerate(ia.tolist()):
        if len(tails) + left < need:
            return False
        left -= 1
        for j in reversed(where.get(s, ())):
            if -band <= i - j <= band:
                at = bisect_left(tails, j)
                tails[at : at + 1] = [j]
    return len(tails) >= need


def first_seen(a: np.ndarray) -> np.ndarray:
    """The distinct shingles in the order of their first occurrence."""
    return a[np.sort(np.unique(a, return_index=True)[1])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The similarity in both senses: of all shingles, and of the distinct ones (a line repeated a hundred times is not most of a text)."""
    return align(a, b) and align(first_seen(a), first_seen(b))


def _bits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within the band, a row of bits per step; for texts that repeat themselves."""
    m = len(b)
    mask: dict[int, int] = {}
    for s in np.unique(b).tolist():
        mask[s] = int.from_bytes(np.packbits(b == s, bitorder="little").tobytes(), "little")
    full = (1 << m) - 1
    v = full
    wide = (1 << (2 * band + 1)) - 1
    for i, s in enumerate(a.tolist()):
        y = mask.get(s, 0)
        if y:
            y &= wide << (i - band) if i >= band else wide >> (band - i)
            u = v & y
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sides = []
            for key, col in (("a", "ta"), ("b", "tb")):
                of = part.column(key).dictionary_encode().indices.to_numpy()
                got: list[np.ndarray] = []
                for t in text_slices([part.take(pa.array(np.unique(of, return_index=True)[1]))], 1 << 20, col):
                    h, n = shingles(Words(t, ALNUM_WORD, FOLD))
                    got += np.split(h, np.cumsum(n)[:-1])
                sides.append([got[k] for k in of])
            ok = pa.array([similar(a, b) for a, b in zip(*sides, strict=True)], pa.bool_())
            yield part.select(["a", "b"]).filter(ok)
    give_back()


_BOUND = f"least(p.n, q.n) >= {SIMILARITY} * greatest(p.n, q.n) - 1e-9"


def _buckets(reps: DataFrame) -> DataFrame:
    """(c, n, s, s2, size, pop): members of buckets of two or more; pop sums the sizes of a member's buckets."""
    rows = reps.where("sk is not null").selectExpr("c", "n", "sk", "posexplode(sk) as (i, s)").selectExpr("c", "n", "s", f"element_at(sk, (i + 1) % {SKETCHES} + 1) s2")
    sizes = rows.groupBy("s").agg(F.count("*").alias("size")).where("size > 1")
    own = Window.partitionBy("c")  # SKETCHES rows at most
    return stored(rows.join(sizes, "s").withColumn("pop", F.sum("size").over(own)), "buckets")


def _pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) whose lengths allow the similarity, of the columns p and q (c, n)."""
    return pairs.where(f"p.c <> q.c and {_BOUND}").selectExpr("least(p.c, q.c) a", "greatest(p.c, q.c) b").distinct()


def _with(hot: DataFrame, lead: DataFrame, *keys: str) -> DataFrame:
    """hot joined with one row per key, which says how many members its key has; large keys are dealt in lots."""
    lots = lead.withColumn("lot", F.explode(F.expr(f"sequence(0L, (members - 1) div {SPLIT})"))).drop("members")
    return hot.withColumn("lot", F.expr(f"pmod(xxhash64(c), (size - 1) div {SPLIT} + 1)")).join(lots, [*keys, "lot"]).drop("lot")


def _led(hot: DataFrame) -> DataFrame:
    """Pairs of members and leaders of the first round."""
    best = F.max_by(F.struct("c", "n"), F.struct("pop", "c"))
    lead = hot.groupBy("s").agg(F.count("*").alias("members"), best.alias("x"), F.min_by(F.struct("c", "n"), F.xxhash64("s", "c")).alias("y"))
    pairs = _with(hot, lead, "s").selectExpr("struct(c, n) p", "inline(array(struct(x as q), struct(y as q)))")
    fine = hot.groupBy("s", "s2").agg(F.max("size").alias("members"), best.alias("z"), F.count("*").alias("size2")).where("size2 > 1").drop("size2")
    return _pairs(pairs.unionByName(_with(hot, fine, "s", "s2").selectExpr("struct(c, n) p", "z q")))


def _grouped(hot: DataFrame, root: DataFrame) -> DataFrame:
    """(key, c, n, g, size): members of buckets with their component."""
    return hot.selectExpr("s key", "c", "n", "size").join(root.selectExpr("u c", "root"), "c", "left").selectExpr("key", "c", "n", "coalesce(root, c) g", "size")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's two sides that are in different components and that lengths and histograms allow."""
    for batch in batches:
        at, depths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for r in range(batch.num_rows):
            m, depth = batch.column(0).slice(r, 1).flatten(), depths[r]
            c, n, left, once = m.field(0), m.field(1).to_numpy(), m.field(5).to_numpy(zero_copy_only=False), m.field(6).to_numpy()
            g = m.field(2).dictionary_encode().indices.to_numpy()
            sk = m.field(3).flatten().to_numpy().reshape(-1, SKETCHES)
            hist = np.stack([folded(x, BINS) for x in m.field(4).to_pylist()]).astype(np.int32)
            p, q = np.flatnonzero(left), np.flatnonzero(~left)
            before = np.arange(SKETCHES) < at[r]
            ok = (g[p][:, None] != g[q][None, :]) & (np.minimum(n[p][:, None], n[q][None, :]) >= SIMILARITY * np.maximum(n[p][:, None], n[q][None, :]) - 1e-9)
            u, v = np.nonzero(ok)
            u, v = p[u], q[v]
            found = []
            for k in range(0, len(u), 4096):
                x, y = u[k : k + 4096], v[k : k + 4096]
                same = sk[x] == sk[y]
                # the bucket that the first sketches they share make up, and no other, yields the pair
                near = (same & before).sum(1) == depth
                x, y = x[near], y[near]
                can = np.minimum(hist[x], hist[y]).sum(1) >= SIMILARITY / (1 + SIMILARITY) * (once[x] + once[y]) - 1e-6
                found.append(np.stack([x[can], y[can]]))
            x, y = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(x)), c.take(pa.array(y))], ["a", "b"])
    give_back()


def _compared(rows: DataFrame, depth: int) -> DataFrame:
    """Pairs (a, b) from (key, at, size, minor, c, n, d, g, sk, hist, out): members outside the largest component against all members.

    Those outside are dealt in blocks x, all members in blocks y; a group is one x with one y.
    """
    spot = rows.withColumn("xs", F.expr(f"(minor - 1) div {BLOCK} + 1")).withColumn("ys", F.expr(f"(size - 1) div {4 * BLOCK} + 1"))
    spot = spot.withColumn("x", F.expr("pmod(xxhash64(c, 1), xs)")).withColumn("y", F.expr("pmod(xxhash64(c, 2), ys)"))
    left = spot.where("out").selectExpr("key", "at", "x", "explode(sequence(0L, ys - 1)) y", "struct(c, n, g, sk, hist, true as is_left, d) m")
    right = spot.selectExpr("key", "at", "explode(sequence(0L, xs - 1)) x", "y", "struct(c, n, g, sk, hist, false as is_left, d) m")
    groups = left.unionByName(right).groupBy("key", "x", "y").agg(F.collect_list("m").alias("ms"), F.first("at").alias("at")).where("exists(ms, m -> m.is_left) and exists(ms, m -> not m.is_left)")
    return groups.select("ms", "at", F.lit(depth).alias("depth")).mapInArrow(_meet, "a binary, b binary").selectExpr("least(a, b) a", "greatest(a, b) b")


def _remainder(hot: DataFrame, reps: DataFrame, root: DataFrame, split: bool) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """All pairs of members of one bucket that are in different components and may be linked, and the tables written on the way.

    With split, pairs in buckets of more than COMPARED comparisons are those of finer buckets only; the keys of such buckets, if any, come third.
    """
    rows = _grouped(hot, root)
    found, kept, whole = [], [], None
    for depth in range(1, DEPTH + 1):
        per = rows.groupBy("key", "g").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("size"), F.max_by("g", F.struct("m", "g")).alias("main"), F.max("m").alias("most"))
        mixed = _with(rows, per.where("most < size").selectExpr("key", "size members", "size as whole", "size - most minor", "main"), "key")
        mixed = mixed.withColumn("out", F.expr("g <> main")).drop("main", "size").withColumnRenamed("whole", "size")
        if depth == 1:
            few = stored(mixed, "mixed-keys")
            kept.append(few)
            mixed = few.join(among(reps.select("c", "d", "sk", "hist"), few, "c"), "c").withColumn("at", F.expr("cast(array_position(sk, key) as int)"))
        mixed = stored(mixed, "mixed")
        kept.append(mixed)
        large = f"minor * size > {COMPARED}" if split and depth < DEPTH else "false"
        found.append(_compared(mixed.where(f"not ({large})"), depth))
        more = mixed.where(large)
        if not split or depth == DEPTH or more.isEmpty():
            break
        if depth == 1:
            whole = stored(more.selectExpr("key s").distinct(), "whole")
        rows = more.selectExpr("key", "c", "n", "d", "g", "sk", "hist", "at", f"posexplode(slice(sk, at + 1, {SKETCHES})) as (o, s)")
        rows = stored(rows.selectExpr("xxhash64(key, s) key", "c", "n", "d", "g", "sk", "hist", "at + o + 1 at"), "finer")
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct(), kept, whole


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose histograms allow a link."""
    for b in batches:
        ok = []
        for x, y, n, m in zip(*(b.column(k).to_pylist() for k in ("ha", "hb", "da", "db")), strict=True):
            bins = min(len(x), len(y))
            ok.append(int(np.minimum(folded(x, bins), folded(y, bins)).sum()) >= needed(n, m))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(src: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are linked; texts are fetched for members of pairs that histograms allow only."""
    pairs = stored(pairs, "pairs")
    sides = reps.selectExpr("c", "d", "hist")
    some = among(sides, pairs.selectExpr("explode(array(a, b)) c"), "c")
    both = pairs.join(some.selectExpr("c a", "d da", "hist ha"), "a").join(some.selectExpr("c b", "d db", "hist hb"), "b")
    near = stored(both.mapInArrow(_bounded, "a binary, b binary"), "near")
    wanted = near.selectExpr("explode(array(a, b)) c").distinct()
    ids = stored(reps.join(wanted, "c").selectExpr("c", "first.doc_id doc_id", "first.text_hash text_hash"), "wanted")
    same = [src[k].eqNullSafe(ids[k]) for k in ("doc_id", "text_hash")]
    texts = stored(among(src, ids, "doc_id", "text_hash").join(ids, same).select("c", "text").dropDuplicates(["c"]), "texts")
    both = near.join(texts.selectExpr("c a", "text ta"), "a").join(texts.selectExpr("c b", "text tb"), "b")
    out = stored(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a binary, b binary"), "verified")
    dropped(pairs, near, ids, texts)
    return out


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of the links (a, b); root is the smallest node reachable. Lineage is cut in each round."""
    edges = stored(links.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == mark or not mark.n:
            return edges.selectExpr("u", "v root")
        before = mark
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v u", "m v").where("u <> v").unionByName(least.selectExpr("u", "m v"))
        old, edges = edges, stored(small.distinct(), "links")
        dropped(old)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, class_text_hash, n_shingles for every row; one class per group of near duplicates."""
    src = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    known = src.where("text is not null")
    small_batches(docs.sparkSession)
    member = stored(known.mapInArrow(_sketches, "doc_id long, text_hash long, c binary, n long, d long, sk array<long>, hist binary"), "sketches")
    reps = stored(member.groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"), F.max("d").alias("d"), F.first("sk").alias("sk"), F.first("hist").alias("hist")), "representatives")
    hot = _buckets(reps)
    root = components(_verified(src, reps, _led(hot)))
    left, split = hot, True
    while left is not None:
        pairs, kept, whole = _remainder(left, reps, root, split)
        new = _verified(src, reps, pairs)
        dropped(*kept)
        if not new.isEmpty():
            root = components(root.selectExpr("u a", "root b").unionByName(new))
        # a pair met first in one of these buckets has been compared only where it shares three sketches
        left, split = None if whole is None else hot.join(whole, "s", "left_semi"), False
    named = reps.join(root, reps.c == root.u, "left").selectExpr("c", "first", "coalesce(root, c) root")
    least = named.groupBy("root").agg(F.min("first").alias("top"))
    of = stored(named.join(least, "root").select("c", "top"), "named")
    slim = stored(member.select("doc_id", "text_hash", "c", "n"), "members")
    dropped(member, reps, hot)
    out = slim.join(of, "c").selectExpr("doc_id", "text_hash", "top.doc_id class_id", "top.text_hash class_text_hash", "n n_shingles")
    return out.unionByName(src.where("text is null").selectExpr("doc_id", "text_hash", "doc_id class_id", "text_hash class_text_hash", "0L n_shingles"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row per class: that of the smallest id. Rows with null text stay; so do all columns, whatever their names."""
    top, same = fresh(docs.columns, "top_id", "top_hash")
    cls = classes(docs).where("doc_id <=> class_id and text_hash <=> class_text_hash").selectExpr(f"doc_id {top}", f"text_hash {same}").distinct()
    keyed = docs.withColumn(same, F.xxhash64(F.col("text").cast("string")))
    first = stored(cls, "classes").withColumnRenamed(same, f"{same}_")
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(top)) & F.col(same).eqNullSafe(F.col(f"{same}_"))
    kept = keyed.where("text is not null").join(first, met, "left_semi").dropDuplicates(["doc_id", same])
    return kept.unionByName(keyed.where("text is null")).drop(same)
