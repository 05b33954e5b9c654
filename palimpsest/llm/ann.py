"""Approximate nearest neighbours with balanced posting lists.

Centroids of directions are fitted with a penalty on full clusters, on four vectors
to a list, ``SAMPLE`` at least and ``MAX_SAMPLE`` at most; there is one list to ``PER_LIST`` rows,
up to ``MAX_LISTS``, and many of them are fitted in two levels.  Every
vector is put on the list of its nearest centroid and, where it lies near a boundary
(distance within ``1 + SPREAD`` of the nearest), on up to ``REPLICAS`` lists.  Centroids
are searched through an in-memory neighbour graph with a beam.  Where lengths differ, lists
are split by bands of length too, and a query ranks a list by what its band can reach.
How many lists a query reads is measured: ``HELD`` queries are answered by brute force, and
every query reads as many of its lists, ``LISTS`` at least and all at most, as found
``TARGET`` of their neighbours; a table of up to ``LISTS`` lists is read whole, so its results
are exact.  Lists are dealt in chunks of ``CHUNK`` rows, so a long list
is several tasks, and each chunk keeps only the best k of each query.

Of vectors equal in every component only the k + 1 smallest ids can be among
anybody's k nearest; they stand for the group, so copies cost nothing and no neighbour
is lost.  Scores are exact inner products in double precision.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part, as query or candidate; rows that repeat
(id and vector) count once; null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._kernels import stored

PER_LIST, MAX_LISTS, SAMPLE, MAX_SAMPLE = 400, 1 << 15, 20_000, 1 << 17
#: More lists than this are fitted in two levels.
FLAT = 512
REPLICAS, SPREAD, LISTS, CHUNK = 8, 0.4, 16, 6_000
HELD, TARGET = 256, 0.95
NEIGHBOURS, BEAM = 16, 64
#: Shares of the sample at which bands of length end, where lengths differ by more than EVEN.
BANDS, EVEN = (0.5, 0.75, 0.9, 0.97), 1.1


class Graph:
    """Neighbour graph over unit centroids with a batched beam search."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n, k = len(centroids), min(NEIGHBOURS, len(centroids) - 1)
        links = []
        for i in range(0, n, 128):
            sim = centroids[i : i + 128] @ centroids.T
            sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -9
            near = np.argpartition(-sim, max(0, k - 1), axis=1)[:, :k]
            links.append(np.sort(near, axis=1))
        far = np.random.default_rng(3).integers(0, n, (n, 4))
        self.links = np.concatenate([np.concatenate(links) if k else np.zeros((n, 0), int), far], axis=1)
        self.start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The beam best centroids of each row of q and their cosines, best first."""
        step = max(16, (1 << 22) // len(self.c))  # bounds the tables of a block
        found = [self._search(q[i : i + step], beam) for i in range(0, len(q), step)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, b = len(self.c), min(beam, len(self.c))
        rows = np.arange(len(q))[:, None]
        sim = np.full((len(q), n), -np.inf)
        done = np.zeros((len(q), n), bool)
        sim[:, self.start] = q @ self.c[self.start].T
        while True:
            best = np.argpartition(-sim, b - 1, axis=1)[:, :b]
            s = np.where(done[rows, best] | ~np.isfinite(sim[rows, best]), -np.inf, sim[rows, best])
            take = np.argpartition(-s, min(4, b) - 1, axis=1)[:, : min(4, b)]
            live = np.isfinite(s[rows, take])
            if not live.any():
                break
            node = best[rows, take]
            done[rows, node] |= live
            near = self.links[node].reshape(len(q), -1)
            sim[rows, near] = np.einsum("qd,qnd->qn", q, self.c[near])
        order = np.argsort(-sim[rows, best], axis=1, kind="stable")
        best = best[rows, order]
        return best, sim[rows, best]


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by k-means on directions with a penalty on clusters above the mean size."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(5)
    lists = min(lists, len(x))
    if lists > FLAT:  # a coarse level first, then each of its cells by itself
        c = fit(x, int(np.sqrt(lists)), rounds)
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        cells = [x[near == k] for k in range(len(c))]
        return np.concatenate([fit(cell, max(1, round(lists * len(cell) / len(x))), rounds) for cell in cells if len(cell)])
    c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    load = np.ones(lists)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T - 0.05 * np.maximum(load - 1, 0)).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=lists)
        norm = np.linalg.norm(total, axis=1)
        ok = norm > 1e-12
        c[ok] = total[ok] / norm[ok, None]
        load = size / (len(x) / lists)
    return c


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Lists:
    """Posting lists: list = centroid * bands + band of length."""

    def __init__(self, sample: np.ndarray, lists: int):
        size = np.linalg.norm(sample, axis=1)
        even = size.max() <= EVEN * size.min()
        self.edges = np.empty(0) if even else np.unique(np.quantile(size, BANDS))
        self.bands = len(self.edges) + 1
        self.graph = Graph(fit(sample, max(1, lists // self.bands)))
        band = self.band(size)
        self.weight = np.array([size[band == k].mean() if (band == k).any() else size.mean() for k in range(self.bands)])
        x = sample / size[:, None]
        mean = float(np.mean(np.concatenate([(x[i : i + 4096] @ self.graph.c.T).max(1) for i in range(0, len(x), 4096)])))
        self.mean, self.tail = mean, 2 * np.sqrt(max(0.0, 1 - mean * mean) / x.shape[1])

    @property
    def count(self) -> int:
        return len(self.graph.c) * self.bands

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, side="right")

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each row of q, the likeliest to hold large inner products first."""
        cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ self.graph.c.T
        reach = (self.mean * cos + self.tail)[:, :, None] * self.weight
        return np.argsort(-reach.reshape(len(q), -1), axis=1, kind="stable")


def _assign(index):
    """(id, vector) -> (id, vector, list) for the lists within the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                v = _matrix(b.column(1))
                size = np.linalg.norm(v, axis=1)
                lists, cos = index.value.graph.search(v / size[:, None])
                gap = 1 - cos
                ok = gap <= (1 + SPREAD) * gap[:, :1] + 1e-12
                ok[:, :1] = True
                ok[:, REPLICAS:] = False
                i, j = np.nonzero(ok)
                of = lists[i, j] * index.value.bands + index.value.band(size)[i]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(of.astype(np.int32))], ["id", "v", "list"])

    return run


def _asked(index, reads: int):
    """(id, vector) -> (id, vector, list) for the lists that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = index.value.order(_matrix(b.column(1)))[:, :reads]
                i = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(lists.ravel().astype(np.int32))], ["id", "v", "list"])

    return run


def _brute(held, k: int):
    """(id, vector) -> the k nearest of each held query in every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _nearest(k)
        for b in batches:
            yield from near(held.value, pa.Table.from_batches([b])).to_batches()

    return run


def lists_read(kept: DataFrame, members: DataFrame, queries: DataFrame, index: Lists, k: int) -> int:
    """How many lists hold TARGET of the true neighbours of the held queries; LISTS at least."""
    if index.count <= LISTS:
        return index.count
    held = queries.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(HELD).select("id", "v").toArrow()
    if not held.num_rows:
        return LISTS
    shared = kept.sparkSession.sparkContext.broadcast(held)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = kept.mapInArrow(_brute(shared, k), "query_id long, vec_id long, score double").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    on = members.select("id", "list").join(F.broadcast(near), F.col("id") == F.col("vec_id")).select("query_id", "vec_id", "list").toPandas()
    order = index.order(_matrix(held.column("v")))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    row = {q: i for i, q in enumerate(held.column("id").to_pylist())}
    on["place"] = place[on.query_id.map(row).to_numpy(), on.list.to_numpy()]
    first = np.sort(on.groupby(["query_id", "vec_id"]).place.min().to_numpy())
    return max(LISTS, int(first[int(np.ceil(TARGET * len(first))) - 1]) + 1) if len(first) else LISTS


def _nearest(k: int):
    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        out_q, out_m, out_s = [], [], []
        if q.num_rows and m.num_rows:
            qi, mi = q.column("id").to_numpy(), m.column("id").to_numpy()
            a, b = _matrix(q.column("v")), _matrix(m.column("v"))
            for at in range(0, len(qi), 256):
                s = a[at : at + 256] @ b.T
                s[qi[at : at + 256, None] == mi[None, :]] = -np.inf
                kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                i, j = np.nonzero((s >= (kth - 1e-9 - 1e-9 * np.abs(kth))[:, None]) & np.isfinite(s))
                exact = (a[at + i] * b[j]).sum(1)
                order = np.lexsort((mi[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                ok = rank < k
                out_q.append(qi[at + i[ok]])
                out_m.append(mi[j[ok]])
                out_s.append(exact[ok])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return pa.table({"query_id": pa.array(cat(out_q, np.int64)), "vec_id": pa.array(cat(out_m, np.int64)), "score": pa.array(cat(out_s, float))})

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, in double precision, once each."""
    v = vectors.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{vec_col}` as array<double>) v")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    v = v.where("id is not null and v is not null and size(v) > 0").where(fine)
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (most.d if most else 0)).distinct()


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as usable() returns them."""
    spark = vectors.sparkSession
    # of equal vectors the k + 1 smallest ids, found in two steps so that a large group is not one task
    first = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    then = Window.partitionBy("v").orderBy("id")
    kept = vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(then)).where(F.col("r") <= k + 1).drop("r")
    kept = stored(kept, "vectors")
    n = kept.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    lists = max(1, min(MAX_LISTS, n // PER_LIST))
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(min(MAX_SAMPLE, max(SAMPLE, 4 * lists))).select("v").toArrow()
    index = Lists(_matrix(sample.column("v")), lists)
    shared = spark.sparkContext.broadcast(index)
    listed = "id long, v array<double>, list int"
    members = stored(kept.mapInArrow(_assign(shared), listed), "lists")
    reads = lists_read(kept, members, queries, index, k)
    chunks = members.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = queries.mapInArrow(_asked(shared, reads), listed).join(chunks, "list").selectExpr("id", "v", "list", "explode(sequence(0, chunks - 1)) chunk")
    dealt = members.join(chunks, "list").selectExpr("id", "v", "list", "cast(pmod(xxhash64(id), chunks) as int) chunk")
    found = asked.groupBy("list", "chunk").cogroup(dealt.groupBy("list", "chunk")).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
