"""Vectorised text kernels shared by the Arrow-batched operators.

All of them work on the UTF-8 bytes of many documents at once, so no Python
code runs per word.  A word hash is multilinear: the sum of its bytes, each times
a pseudo-random 64-bit number that belongs to its place in the word, mixed
afterwards, so no two words collide by the structure of the hash.  ``seed`` picks
another set of numbers.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

#: True where a byte belongs to a word, for words split at ASCII white space.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: True for ASCII letters and digits and every byte of a non-ASCII character.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (a multiply-xorshift chain)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x = x * U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


_keys: dict[int, np.ndarray] = {}


def place_keys(seed: int, n: int) -> np.ndarray:
    """One pseudo-random number for each place in a word, kept per process and grown on demand."""
    have = _keys.get(seed)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n).bit_length())
        _keys[seed] = have = mix(mix(np.arange(1, size + 1, dtype=U64)) + U64(pow(_BASE, seed + 2, 1 << 64)))
    return have


class Texts:
    """Documents of one slice: their bytes laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20, column: str = "text") -> Iterator[Texts]:
    """Whole documents in slices of about ``limit`` bytes (one long document may exceed it). Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
        n, off = len(col), col.offset
        offsets = np.frombuffer(col.buffers()[1], np.int64)[off : off + n + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.slice(i, j - i))
            i = j


class Words:
    """Word boundaries and hashes of a slice; ``first[d]:first[d+1]`` are the words of document d."""

    def __init__(self, t: Texts, is_word: np.ndarray, fold: np.ndarray, seed: int = 0):
        data, off = t.data, t.offsets
        n = len(data)
        w = is_word[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = w[:-1]
            after[-1] = False
            after[:-1] = w[1:]
            inner = off[:-1][off[:-1] < n]
            before[inner] = False
            after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        size = self.end - self.start
        if len(size):
            # bytes of words only, word after word
            edge = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
            parts = (fold[data[w]].astype(U64) + U64(1)) * place_keys(seed, int(size.max()))[place]
            self.hash = mix(np.add.reduceat(parts, edge[:-1]) + size.astype(U64) * U64(0xE7037ED1A0B428DB))
        else:
            self.hash = np.empty(0, U64)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count), dtype=np.int64), self.count)


def grams(w: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the index of each run's first word."""
    total = len(w.hash)
    if total < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    m = total - k + 1
    h = np.zeros(m, U64)
    for j in range(k):
        h += w.hash[j : j + m] * U64(pow(_BASE * (2 * seed + 1), j + 1, 1 << 64))
    last = np.repeat(w.first[1:], w.count)[:m]
    ok = np.flatnonzero(np.arange(m) + k <= last)
    return mix(h[ok]), ok


def sequences(t: Texts, is_word: np.ndarray, fold: np.ndarray) -> Iterator[bytes]:
    """The words of each document, joined by one space."""
    w = is_word[t.data]
    keep = w.copy()
    keep[1:] |= w[:-1]
    flat = np.where(w, fold[t.data], 32).astype(np.uint8)[keep]
    edge = np.concatenate([[0], np.cumsum(keep)])[t.offsets]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield flat[a:b].tobytes().strip()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where one machine does everything and the session names none."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.get("PALIMPSEST_LOCAL_SHARED") or tempfile.mkdtemp(prefix="palimpsest-")
        os.environ["PALIMPSEST_LOCAL_SHARED"] = at
        at = f"file://{at}"
    return at.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) that hold for one block and are put back after it."""
    before = {}
    for key, value in values.items():
        name = key.replace("__", ".")
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, lost executors don't matter.

    The shuffle files of the write go when it ends, so a chain of steps needs the disk of its largest step only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{what}-{uuid.uuid4().hex}"
    with settings(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables; nothing may read them any more."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as no column in taken has."""
    low = {x.lower() for x in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        low.add(n.lower())
        out.append(n)
    return tuple(out)


def marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the wanted ones, and those whose key is surely not; no shuffle of rows.

    What is broadcast is a bitmap of at most 2**17 words, whatever the number of wanted keys.
    """
    spot = "pmod(xxhash64({}), " + f"{1 << 23})"
    place, word, bits = fresh(rows.columns, "place", "word", "bits")
    table = wanted.selectExpr(f"{spot.format(wanted_key)} p").groupBy(F.expr("p div 64").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias(bits))
    near = rows.withColumn(place, F.expr(spot.format(key))).withColumn(word, F.expr(f"`{place}` div 64")).join(F.broadcast(table), word, "left")
    hit = f"coalesce(shiftrightunsigned(`{bits}`, cast(`{place}` % 64 as int)) % 2 <> 0, false)"
    return near.where(hit).select(*rows.columns), near.where(f"not {hit}").select(*rows.columns)


def among(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys may be among the wanted ones (some others pass too)."""
    return marked(rows, ", ".join(keys), wanted, ", ".join(keys))[0]


def give_back() -> None:
    """At the end of a Python task: what it has freed goes back to the system. Idle workers stay alive, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, where the session has the defaults (long texts make 10,000 rows too many).

    A setting of the session, since results are computed after an operator has returned.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
