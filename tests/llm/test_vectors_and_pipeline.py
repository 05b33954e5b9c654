"""Nearest neighbours against brute force, and the pipeline's stages on their own inputs."""

from __future__ import annotations

import numpy as np

from palimpsest.llm import ann, registry

KIND = "vec_id long, embedding array<float>, label int"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = sorted(((-(x[q] * x[j]).sum(), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
        out[ids[q]] = [i for _, i in s]
    return out


def test_recall_on_table(spark):
    small = "/root/testdata/sf0.1"
    got = registry.op7_ann(spark, small).collect()
    t = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x = np.array(t.embedding.tolist(), np.float64)
    ids = t.vec_id.tolist()
    queries = [k for k, i in enumerate(ids) if i % 20 == 0]
    want = brute(ids, x, queries, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(x[ids.index(r.query_id)] @ x[ids.index(r.vec_id)])) < 1e-12
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_vectors_odd_and_equal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x[i % 40].tolist() if i < 200 else x[i % 60].tolist(), 0) for i in range(260)]
    rows += [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 8, 0), (1060, [float("nan")] * 8, 0), (1080, [1.0] * 7, 0), (1100, [1.0, None] + [1.0] * 6, 0), (1120, [float("inf")] * 8, 0), (None, x[0].tolist(), 0)]
    rows += rows[:20]
    v = ann.usable(spark.createDataFrame(rows, KIND))
    assert v.count() == 260
    got = {}
    for r in ann.search(v, v.where("id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = list(range(260))
    vec = np.array([r[1] for r in rows[:260]], np.float64)
    assert got == brute(ids, vec, range(0, 260, 20), 5)


def test_recall_with_many_lists(spark, monkeypatch):
    """A thousand lists, as a large table has them, and lengths that differ: sixteen lists are not enough."""
    monkeypatch.setattr(ann, "PER_LIST", 15)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(15_000, 64))
    x *= rng.lognormal(0, 0.5, (len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    v = ann.usable(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], KIND))
    queries = list(range(0, 15_000, 100))
    got = {}
    for r in ann.search(v, v.where("id % 100 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-s, axis=1)[:, :20]
    assert sum(len(got[q] & set(w.tolist())) for q, w in zip(queries, near, strict=True)) / (20 * len(queries)) >= 0.9


def test_few_and_no_vectors(spark):
    v = ann.usable(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], KIND))
    assert [tuple(r) for r in ann.search(v, v.where("id % 20 = 0")).collect()] == [(0, 1, 1, 0.5)]
    rng = np.random.default_rng(4)
    for n in (21, 40, 150, 300):
        x = rng.normal(size=(n, 16))
        v = ann.usable(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], KIND))
        got = {}
        for r in ann.search(v, v.where("id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == brute(list(range(n)), x, range(0, n, 20), 20), n
    none = ann.usable(spark.createDataFrame([], KIND))
    assert ann.search(none, none).count() == 0


def test_two_levels_of_centroids():
    x = np.random.default_rng(2).normal(size=(6000, 16))
    c = ann.fit(x, 700)
    assert abs(len(c) - 700) < 30 and np.allclose(np.linalg.norm(c, axis=1), 1)
    found, cos = ann.Graph(c).search(x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True))
    best = (x[:200] @ c.T).argmax(1)
    assert np.mean(found[:, 0] == best) > 0.95 and (np.diff(cos, axis=1) <= 1e-12).all()


def test_pipeline_equals_brute_force(spark):
    """Each stage against a plain version on the rows that the stage before kept."""
    import zlib

    import corpus_pipeline
    from tokenizers import Tokenizer

    from palimpsest.llm import neardup, toxicity
    from test_text_operators import brute_overlap, plain_words

    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    rows = sorted(tuple(r) for r in docs.collect())
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars")
    model = toxicity.fit(docs, labels)
    keep = toxicity.scores([r[text] or "" for r in rows], *model) < toxicity.THRESHOLD
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    assert sorted(tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()) == rows

    def frame(rows):
        return spark.createDataFrame(rows, docs.schema)

    sites = {}
    for r in rows:
        for line in (r[text] or "").split("\n"):
            sites.setdefault(line.strip(" \t\r"), set()).add(r[docs.columns.index("source")])
    bad = {k for k, v in sites.items() if k and len(v - {None}) >= 10}
    after = []
    for r in rows:
        left = "\n".join(x for x in r[text].split("\n") if x.strip(" \t\r") not in bad)
        after.append(tuple(left if k == text else len(left) if k == chars else v for k, v in enumerate(r)))
    assert sorted(tuple(r) for r in corpus_pipeline.drop_lines(spark, frame(rows), small).collect()) == after

    grams = []
    for r in after:
        w = __import__("re").findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[text]))
        codes = [hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)]
        grams.append((np.array(codes, np.int64), tuple(w) or r[text]))
    parent = list(range(len(after)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, v) in enumerate(grams):
        for j, (b, w) in enumerate(grams[:i]):
            if v == w or len(a) and len(b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and neardup.similar(a, b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    unique = [r for k, r in enumerate(after) if find(k) == k]
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, frame(after), small).collect()) == unique

    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r.text]
    words = [set(plain_words(x)) for x in items]
    clean = [r for r in unique if not any(len(w & set(plain_words(r[text]))) * 3 >= len(w) and brute_overlap(r[text], x) for w, x in zip(words, items, strict=True))]
    assert sorted(tuple(r) for r in corpus_pipeline.drop_contaminated(spark, frame(unique), small).collect()) == clean

    tok, want = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json")), {}
    for r in clean:
        ids = tok.encode(r[text], add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[r[0], k] = zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())
    got = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want
    assert len({r.sequence_id for r in got}) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline
    from test_text_operators import docs, odd

    small = "/root/testdata/sf0.001"
    for table in (docs(spark, []), odd(spark).drop("score", "overlaps", "n_lines")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            assert name == "packing" or out.columns == table.columns
            assert out.count() <= 3 * table.count(), name


def test_pipeline(spark):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert 0 < out.count() <= docs.count()
    packed = corpus_pipeline.run(spark, small)
    assert packed.where("length > 2048 or length < 1").count() == 0 and packed.count() > 100


def test_pipeline_drops_a_copy_with_one_sketch_in_common(spark, monkeypatch):
    """A pair at 0.8 that shares one sketch of 20, in a bucket that counts as large; no leader helps."""
    import random

    import corpus_pipeline
    from palimpsest.llm import neardup

    rng = random.Random(3)
    for _ in range(566):
        a = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        at, _ = rng.sample(range(5, 44), 2)
    b = a[:at] + ["x"] + a[at + 1 :]
    led = neardup._led
    monkeypatch.setattr(neardup, "_led", lambda hot: led(hot).where("false"))
    monkeypatch.setattr(neardup, "COMPARED", 0)
    t = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, t, "").collect()] == [1]
