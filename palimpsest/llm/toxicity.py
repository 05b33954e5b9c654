"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of ``WINDOW`` words.  The features of a window are
its distinct words and all their character n-grams (with a boundary mark at both ends
of a word), hashed into ``BUCKETS`` embedding rows; the average of the rows
goes through a linear softmax over {clean, toxic}.  A document's score is that
of its highest window, so a few words count as much in a long text as in a
short one.  Embeddings and softmax are trained together by stochastic gradient
descent on the highest window of each labelled document.  Unseen spellings
share n-gram rows with seen ones.

Training reads at most ``MAX_POSITIVE`` + ``MAX_NEGATIVE`` labelled documents
(those with the smallest hash of their id; a documented bound) and is one
task; scoring is one scan without a shuffle.  Since the softmax is linear,
only one number per bucket (``BUCKETS`` * 4 bytes) goes to the executors.

Edge cases: null, empty and word-less texts have the score of an empty bag (the
softmax of the bias); null ids (never held out, never learned from) and repeated rows
pass through, one output row per input row; with no usable label every score is 0.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernels import U64, give_back, mix, place_keys, small_batches, text_slices

BUCKETS, DIM, WINDOW, NGRAMS = 1 << 20, 8, 40, (3, 4, 5)
MAX_POSITIVE, MAX_NEGATIVE = 1600, 2400
STEPS, RATE, GAIN, GAIN_OUT, DECAY, SEED = 70_000, 0.5, 60.0, 0.5, 4e-3, 7
#: A bag of fewer features is filled up with zero rows, so that one or two words do not make an extreme average.
PAD = 300
#: Buckets met in fewer labelled texts stay at zero: they would only learn single texts by heart.
MIN_TEXTS = 3
#: In the last third of the epochs, a label further than this from the prediction counts as wrong.
TRIM = 0.9
#: Share of the epochs that learn from a random window of each text instead of the highest.
WARM = 0.4
THRESHOLD = 0.3
_K = [U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(8)]

#: Word characters: ASCII letters and digits and all of U+00AA up that str.isalnum accepts below U+3000, and everything above.
_TABLE = np.array([chr(c).isalnum() for c in range(0x3000)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: bucket of each feature, its window, and the first window of each text (one more at the end)."""
    joined = ("\n" + "\n\n".join(t.lower() for t in texts) + "\n") if texts else "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[1], 1 + np.cumsum(lengths + 2)])[: len(texts) + 1]
    w = np.where(c < 0x3000, _TABLE[np.minimum(c, 0x2FFF)], True)
    start = np.flatnonzero(w & ~np.concatenate([[False], w[:-1]]))
    end = np.flatnonzero(w & ~np.concatenate([w[1:], [False]])) + 1
    first = np.searchsorted(start, begin)
    counts = np.diff(first)
    wins = np.maximum(1, -(-counts // WINDOW))
    first_win = np.concatenate([[0], np.cumsum(wins)])
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), first_win
    at = np.arange(len(start)) - np.repeat(first[:-1], counts)
    win_of_word = np.repeat(first_win[:-1], counts) + at * np.repeat(wins, counts) // np.repeat(counts, counts)
    x = np.where(w, c, 1).astype(U64)
    size = end - start
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    word = mix(np.add.reduceat(c[w].astype(U64) * place_keys(0, int(size.max()))[place], edge[:-1]) + size.astype(U64) * _K[7])
    # a word counts once in a window, however often it stands there
    keep = np.sort(np.unique(mix(word + win_of_word.astype(U64) * _K[6]), return_index=True)[1])
    start, end, word, win_of_word = start[keep], end[keep], word[keep], win_of_word[keep]
    buckets, places = [(word & U64(BUCKETS - 1)).astype(np.int64)], [win_of_word]
    # n-grams: position i runs from the mark before a word to n-1 before the mark after it
    spans = end - start + 2
    inner = np.repeat(start - 1, spans) + (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
    left = np.repeat(end + 1, spans) - inner
    owner = np.repeat(win_of_word, spans)
    for n in NGRAMS:
        ok = left >= n
        i = inner[ok]
        h = np.zeros(len(i), U64)
        for j in range(n):
            h += x[i + j] * _K[j]
        buckets.append((mix(h + U64(n)) & U64(BUCKETS - 1)).astype(np.int64))
        places.append(owner[ok])
    return np.concatenate(buckets), np.concatenate(places), first_win


def _by_length(texts: list[str], limit: int = 1 << 17) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def train(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Fits embeddings and softmax; returns each bucket's contribution to the logit of toxic, and the bias."""
    toxic = np.asarray(toxic, np.float64)
    if not len(texts) or toxic.min() == toxic.max():
        return np.zeros(BUCKETS, np.float32), -50.0
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    out[1] = rng.uniform(-0.1, 0.1, DIM)
    bias = np.zeros(2)
    sizes, begin = [], 0
    offset = [0]
    texts_with = np.zeros(BUCKETS, np.int32)
    kept = tempfile.TemporaryFile()  # noqa: SIM115 (has no name; the features are some ten times the texts, too many for memory)
    for some in _by_length(texts):
        b, p, fw = features(some)
        order = np.argsort(p, kind="stable")
        b[order].astype(np.int32).tofile(kept)
        sizes.append(np.bincount(p, minlength=int(fw[-1])))
        of = np.repeat(np.arange(len(some)), np.diff(fw))[p]
        np.add.at(texts_with, np.unique(of * BUCKETS + b) % BUCKETS, 1)
        offset.extend(fw[1:] + begin)
        begin += int(fw[-1])
    size = np.concatenate(sizes)
    edge = np.concatenate([[0], np.cumsum(size)])
    kept.flush()
    feat = np.asarray(np.memmap(kept, np.int32, "r")) if edge[-1] else np.empty(0, np.int32)
    kept.close()  # the mapping stays
    offset = np.array(offset)
    docs = np.repeat(np.arange(len(texts)), np.diff(offset))
    epochs = min(150, max(16, STEPS // len(texts)))
    common = texts_with >= MIN_TEXTS
    emb[~common] = 0
    for epoch in range(epochs):
        per = emb @ (out[1] - out[0])
        logit = np.zeros(len(size))
        for w in range(0, len(size), 4096):  # some windows at a time: memory stays bounded
            v = min(len(size), w + 4096)
            sums = np.zeros(edge[v] - edge[w] + 1)
            np.cumsum(per[feat[edge[w] : edge[v]]], dtype=np.float64, out=sums[1:])
            logit[w:v] = (sums[edge[w + 1 : v + 1] - edge[w]] - sums[edge[w:v] - edge[w]]) / np.maximum(size[w:v], PAD)
        noise = 0.0 if epoch else rng.random(len(logit)) * 1e-3
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, docs, logit + noise)
        top = np.full(len(texts), -1)
        hit = np.flatnonzero(logit + noise >= best[docs])
        top[docs[hit]] = hit
        if epoch < epochs * WARM:  # at first any window: what toxic texts share shows before one window is settled on
            top = offset[:-1] + (rng.random(len(texts)) * np.diff(offset)).astype(np.int64)
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 16)):
            win = top[batch]
            n = size[win]
            rows = feat[np.repeat(edge[win], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            seg = np.repeat(np.arange(len(win)), n)
            known = common[rows]
            rows, seg = rows[known], seg[known]
            bag = np.zeros((len(win), DIM))
            np.add.at(bag, seg, emb[rows])
            bag /= np.maximum(n, PAD)[:, None]
            z = bag @ out.T + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            err = p
            err[:, 1] -= toxic[batch]
            err[:, 0] -= 1 - toxic[batch]
            if epoch > epochs * 2 // 3:  # labels are not all right: texts far on the other side no longer pull
                err[np.abs(err[:, 1]) > TRIM] = 0
            back = err @ out
            out -= (rate * (err.T @ bag) / len(batch) * GAIN_OUT).astype(np.float32)
            bias -= rate * err.mean(0)
            emb[rows] *= 1 - rate * DECAY
            np.add.at(emb, rows, (-rate * GAIN * back / np.maximum(n, PAD)[:, None])[seg].astype(np.float32))
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of toxic for each text."""
    b, p, fw = features(texts)
    wins = int(fw[-1])
    total, n = np.bincount(p, weight[b], wins), np.bincount(p, minlength=wins)
    logit = np.maximum.reduceat(total / np.maximum(n, PAD), fw[:-1]) + bias if len(texts) else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def held_out(doc_id: object) -> object:
    """Column: the rows never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample of labelled texts."""
    keyed = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    pick = keyed.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).unionByName(keyed.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_NEGATIVE))
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # MAX_POSITIVE + MAX_NEGATIVE rows


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]]
    weight, bias = train([r[1] for r in rows], np.array([r[2] for r in rows], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])
    del rows, weight
    give_back()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model, trained in one task: its rows are bounded, and a lost executor only repeats it."""
    row = sample(docs, labels).repartition(1).mapInArrow(_fit, "weight binary, bias double").first()
    return (np.frombuffer(row.weight, np.float32), row.bias) if row else (np.zeros(BUCKETS, np.float32), -50.0)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column ``score``; extra columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))  # BUCKETS * 4 bytes, whatever the input
    keep = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for t in text_slices(batches, 1 << 19):
            texts = [x or "" for x in t.rows.column(t.rows.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.rows.columns, pa.array(scores(texts, weight, bias))], [*t.rows.schema.names, "score"])
        give_back()

    src = docs.select(*keep)
    return src.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in src.dtypes) + ", score double")
