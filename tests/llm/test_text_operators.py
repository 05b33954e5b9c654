"""Operators on texts against brute force and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, licenses, lines, neardup, packing, pii, substring, token_counts, toxicity
from palimpsest.llm.registry import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "É ß ÷ 漢字", "x\0y", "word " * 3000, "!!! ??? ***", "the same line\nthe same line\n"]


def docs(spark, texts, source=lambda i: f"s{i % 4}"):
    return spark.createDataFrame([(i, t, "en", source(i), None) for i, t in enumerate(texts)], KIND)


def odd(spark):
    """Odd texts twice, a null id, and a column whose name clashes with what operators add."""
    rows = [(i % len(ODD), t, "en", None, None) for i, t in enumerate(ODD + ODD)] + [(None, "some text here", None, None, None)]
    return spark.createDataFrame(rows, KIND).withColumn("score", F.lit("x")).withColumn("overlaps", F.lit(1)).withColumn("n_lines", F.lit(2))


CLASHES = ("k1", "K2", "gone", "lines", "place", "word", "bits", "top_id", "top_hash", "found_id", "own_hash", "_hash", "claims", "kept", "seeds", "key", "score", "overlaps", "n_lines", "n_removed", "class_id", "piece", "labels", "s")


def clashing(spark):
    """A table whose further columns have the names that operators use."""
    out = docs(spark, ["one line\nanother", "one line\nthird " * 9, None, ""], lambda i: "s")
    return out.selectExpr("*", *(f"'{c}' `{c}`" for c in CLASHES))


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# personal data


def brute_pii(text):
    text = text or ""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


def test_pii_equals_patterns():
    r = random.Random(1)
    alphabet = ["a", "b.c", "@", "@x", ".", "-", "1", "22", "255", ".3", "+", "+4", " ", "(", ")", "4111 1111 1111 1111", "é", "x@y.zz", "\n", "%"]
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 30)))
        assert [(a, b, k) for a, b, k, _ in pii.spans(t) if k != "iban"] == brute_pii(t), t


def test_pii_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1 " * 60_000, "a.b" * 60_000 + "@", "A1" * 100_000):
        pii.spans(t)


def test_pii_query_and_iban(spark):
    out = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, ["write to me@a.example.org", "bank account GB82 WEST 1234 5698 7654 32 now", "GB83 WEST 1234 5698 7654 32", None]))).collect()}
    assert out[0].n_email == 1 and out[0].spans == "email:9:25" and out[0].base_sha256 == hashlib.sha256(b"email:9:25").hexdigest()
    assert out[1].spans.endswith("iban:13:40") and "iban" not in out[2].spans
    assert out[3].spans == "" and out[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(odd(spark)).count() == 2 * len(ODD) + 1


def test_iban_ends_and_context():
    """A known country's candidate is cut to its length; another's needs an account word beside it, as a whole word."""
    good = "DE89370400440532013000"
    for t, stop in ((f"{good} 2024", 22), ("GB82WEST12345698765432 TODAY", 22), ("DE89 3704 0044 0532 0130 00 BIC X", 27), (f"{good}.", 22)):
        assert [s[:3] for s in pii.spans(t)] == [(0, stop, "iban")], t
    assert pii.spans(f"x{good}") == pii.spans(f"{good}X") == pii.spans("DE88370400440532013000") == []
    body = "ZZ00123456789012345"
    check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
    odd_one = f"ZZ{check:02d}123456789012345"
    assert pii.spans(f"number {odd_one} then") == [] and pii.spans(f"accounts {odd_one}") == []
    assert [s[2] for s in pii.spans(f"account {odd_one} AND MORE")] == ["iban"]
    assert pii.spans("ship 1.2.3.4")[0][3] < pii.spans("host 1.2.3.4")[0][3]


# repeats of 13 words


def brute_repeats(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_TEXT", 2000)
    r = random.Random(2)
    shared = [prose(s, r.randrange(10, 60)) for s in range(6)]
    texts = []
    for i in range(80):
        w = prose(100 + i, r.randrange(0, 60))
        for s in r.sample(shared, r.randrange(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = s[r.randrange(4) :]
        texts.append(r.choice([" ", "\n", "\t  "]).join(w))
    texts += [texts[3]] * 5 + ["same " * 40] * 3 + [None, "", " ".join(shared[0])]
    got = sorted(map(tuple, substring.dedup_substrings(docs(spark, texts)).collect()))
    assert got == brute_repeats(list(enumerate(texts)))


def test_substring_recovers_from_collisions(spark):
    """With a few bits of hash most windows collide: the claims fail, and the next round has other constants."""
    texts = [" ".join(prose(i % 3, 30) + prose(50 + i, 30)) for i in range(12)]
    got = sorted(map(tuple, substring.dedup_substrings(docs(spark, texts), bits=(0x3, 0xF)).collect()))
    assert got == brute_repeats(list(enumerate(texts)))


def test_words_do_not_collide_by_structure(spark):
    """Thue-Morse words and texts of 1024 letters or words: equal under any polynomial modulo 2**64."""
    turn = [k.bit_count() % 2 for k in range(1024)]
    a, b = ("".join(x[k] for k in turn) for x in ("ab", "ba"))
    out = substring.dedup_substrings(docs(spark, [" ".join([*"abcdefghijkl", x]) for x in (a, b)]))
    assert [x.n_removed for x in out.orderBy("doc_id").collect()] == [0, 0]
    same = neardup.classes(docs(spark, [" ".join(x[k] for k in turn) for x in (("u", "v"), ("v", "u"))] + [a, b]))
    assert len({x.class_id for x in same.collect()}) == 4


def test_extra_columns_may_have_any_name(spark):
    from palimpsest.llm.registry import tokenizer_path

    t, bench = clashing(spark), spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert lines.drop_boilerplate(t, min_sites=1).count() == 4
    assert neardup.keep_first(t).columns == t.columns and neardup.classes(t).count() == 4
    assert decontaminate.clean(t, bench).columns == t.columns and decontaminate.find_overlaps(t, bench).count() == 4
    assert substring.dedup_substrings(t).count() == licenses.scan(t).count() == pii.find_pii(t).count() == 4
    assert packing.pack_documents(t, tokenizer_path("word_bpe_49k.json")).count() == 4
    assert toxicity.score_toxicity(t, spark.createDataFrame([], "doc_id long, toxic int")).count() == 4


def test_substring_edges(spark):
    out = substring.dedup_substrings(odd(spark))
    assert out.count() == 2 * len(ODD) + 1 and out.agg(F.sum("n_removed")).first()[0] == 0  # equal ids are one document
    assert substring.dedup_substrings(docs(spark, [])).count() == 0


# near duplicates


def test_neardup_equals_brute_force(spark):
    r = random.Random(3)
    texts = []
    for g in range(12):
        base = prose(g, r.randrange(6, 200))
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"z{r.randrange(99)}"
            texts.append(" ".join(w))
    line = " ".join(prose(77, 12))
    texts += [" ".join([line] * 40 + prose(500 + g, 60)) for g in range(6)]  # mostly one line, yet different
    texts += [texts[0].upper(), texts[0] + "!", "", "", None, None, "a b", "a b", "???", "???"]
    grams = []
    for t in texts:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        grams.append([tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    words = [tuple(re.findall(r"[0-9a-z]+", t.lower())) or t if t is not None else object() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    for i in range(len(texts)):
        for j in range(i):
            a, b = grams[i], grams[j]
            seen = [list(dict.fromkeys(x)) for x in (a, b)]
            if words[i] == words[j] or a and b and all((n := common(x, y)) / (len(x) + len(y) - n) >= 0.8 for x, y in ((a, b), seen)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = neardup.keep_first(docs(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == sorted({find(i) for i in range(len(texts))})


def test_neardup_pairs_among_alike_texts(spark):
    """Pairs at 0.82 among texts that are all alike at 0.75: the leaders of a bucket are seldom a text's partner."""
    common, texts = [f"w{k}" for k in range(430)], []
    for pair in range(120):
        for side in range(2):
            texts.append(" ".join(common + [f"p{pair}x{k}" for k in range(23)] + [f"o{pair}y{side}z{k}" for k in range(50)]))
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, texts)).collect()}
    lost = sum(got[2 * k] != got[2 * k + 1] for k in range(120))
    assert lost == 0 and len(set(got.values())) == 120, lost


def test_neardup_splits_large_buckets(spark, monkeypatch):
    """The same with buckets of more members than are compared at once: second and third sketches, then blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "COMPARED", 150)
    monkeypatch.setattr(neardup, "SPLIT", 10)
    test_neardup_pairs_among_alike_texts(spark)


@pytest.mark.parametrize("compared", [0, 1 << 22])
def test_neardup_links_with_one_sketch_in_common(spark, monkeypatch, compared):
    """A pair at 0.8 that shares one sketch of 20, whether its bucket counts as large or not; no leader helps."""
    rng = random.Random(3)
    for _ in range(566):
        a = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        at, _ = rng.sample(range(5, 44), 2)
    b = a[:at] + ["x"] + a[at + 1 :]
    t = docs(spark, [" ".join(a), " ".join(b)])
    led = neardup._led
    monkeypatch.setattr(neardup, "_led", lambda hot: led(hot).where("false"))
    monkeypatch.setattr(neardup, "COMPARED", compared)
    assert len({r.class_id for r in neardup.classes(t).collect()}) == 1
    rows = next(neardup._sketches(iter(t.selectExpr("cast(doc_id as long) doc_id", "0L text_hash", "text").toArrow().combine_chunks().to_batches()))).column("sk").to_pylist()
    assert sum(x == y for x, y in zip(*rows, strict=True)) == 1


def test_histograms_bound_alignments():
    r = random.Random(6)
    for _ in range(200):
        a = np.array([mixed(r.randrange(400)) for _ in range(r.randrange(1, 700))], np.uint64)
        b = np.concatenate([a[: r.randrange(len(a) + 1)], np.array([mixed(r.randrange(900)) for _ in range(r.randrange(1, 300))], np.uint64)])
        a, b = neardup.first_seen(a), neardup.first_seen(b)
        x, y = (neardup.histograms(v, np.array([len(v)]))[0] for v in (a, b))
        bins = min(len(x), len(y))
        bound = np.minimum(neardup.folded(x, bins), neardup.folded(y, bins)).sum()
        assert bound >= len(np.intersect1d(a, b))


def mixed(x):
    return x * 0x9E3779B97F4A7C15 % 2**64


def test_alignment_agrees_with_bit_rows():
    r = random.Random(4)
    for _ in range(300):
        a = np.array([r.randrange(5) for _ in range(r.randrange(1, 40))])
        b = np.array([x for x in a.tolist() if r.random() > 0.1] or [9])
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            last = 0
            for j, y in enumerate(b.tolist()):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        assert neardup._bits(a, b, 100) == row[-1]
        assert neardup.align(a, b) == (row[-1] / (len(a) + len(b) - row[-1]) >= 0.8 - 1e-12)


def test_neardup_edges(spark):
    assert neardup.classes(odd(spark)).count() == 2 * len(ODD) + 1
    assert neardup.classes(docs(spark, [])).count() == 0
    kept = neardup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("text = 'a'").count() == 1 and kept.where("text is null").count() == 2


# decontamination


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_overlap(doc, item):
    a, b = plain_words(doc), plain_words(item)
    span, need = (13, 11) if len(b) >= 13 else (len(b), len(b))
    if len(b) < 8:
        return False
    return any(sum(x == y for x, y in zip(a[i : i + span], b[j : j + span], strict=True)) >= need for i in range(len(a) - span + 1) for j in range(len(b) - span + 1))


@pytest.mark.parametrize("most", [1 << 28, 1 << 6])
def test_decontaminate_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST", most)  # a full filter lets every window through
    r = random.Random(5)
    items = [" ".join(prose(900 + i, r.choice([4, 7, 8, 11, 13, 14, 30]))) for i in range(14)]
    texts = []
    for i in range(70):
        w = prose(i, r.randrange(0, 40))
        s = r.choice(items).split()
        s = s[: r.randrange(6, 40)]
        for _ in range(r.randrange(4)):
            s[r.randrange(len(s))] = "other"
        texts.append(" ".join(w[:20] + s + w[20:]).replace("w1", r.choice(["w1", "W1,"])))
    texts += [None, "", items[5]]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (None, "x"), (98, "")], "item_id long, text string")
    got = {x.doc_id: {o.item_id for o in x.overlaps} for x in decontaminate.find_overlaps(docs(spark, texts), bench).collect()}
    assert got == {i: {j for j, b in enumerate(items) if brute_overlap(t, b)} for i, t in enumerate(texts)}
    left = decontaminate.clean(docs(spark, texts), bench)
    assert sorted(x.doc_id for x in left.collect()) == [i for i in got if not got[i]]
    assert decontaminate.find_overlaps(odd(spark), bench).count() == 2 * len(ODD) + 1


def test_masks_cover_two_substitutions():
    for i in range(13):
        for j in range(i):
            assert any(m[i] == m[j] == "0" for m in decontaminate.MASKS)


# lines


def test_lines_equal_brute_force(spark):
    r = random.Random(6)
    texts = ["\n".join(r.choice([f"line {r.randrange(30)}", f" line {r.randrange(5)}\t", "", f"own {i} {k}"]) for k in range(r.randrange(0, 8))) for i in range(60)] + [None, "", "\n\n"]
    sites = lambda i: None if i % 17 == 3 else f"s{i % 6}"
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if x.strip(" \t\r") and sites(i):
                where[x.strip(" \t\r")].add(sites(i))
    bad = {x for x, s in where.items() if len(s) >= 4}
    assert bad
    got = {x.doc_id: x for x in lines.drop_boilerplate(docs(spark, texts, sites), min_sites=4).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
        else:
            assert got[i].text == "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad)
            assert got[i].n_removed == sum(x.strip(" \t\r") in bad for x in t.split("\n"))
    assert lines.drop_boilerplate(odd(spark)).count() == 2 * len(ODD) + 1
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


# licences


def test_license_base_equals_brute_force(spark):
    r = random.Random(7)
    bits = ["under the MIT license", "Under-The mit LICENSE", "apache license version 2", "Apache License, Version 2.0", "cc by nc", "CC-BY-NC 4.0", "cc by", "license", "word", "é", "license version 2 apache license version 2", "x under the mit licensee"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 9))) for _ in range(120)] + [None, "", "SPDX-License-Identifier: MIT", "Licensed under the GNU General Public License version 3 for all", "released under the Boost Software License 1.0"]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None)), t
        assert x.base_labels == ",".join(sorted({h[1] for h in hits})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
    assert [got[len(texts) - k].labels for k in (3, 2, 1)] == ["mit", "gpl-3", "boost-1"] and got[len(texts) - 3].score == 1.0
    assert licenses.scan(odd(spark)).count() == 2 * len(ODD) + 1
    assert len(licenses.rules()) >= 280


def example(pattern: str, pick: int, whole: bool) -> str:
    """A string that the pattern matches: the pick-th of alternatives, options taken or left."""
    from re import _constants as c
    from re import _parser

    def one(op, arg) -> str:
        if op is c.LITERAL:
            return chr(arg)
        if op is c.IN:
            return chr(arg[0][1] if arg[0][0] is c.LITERAL else arg[0][1][0])
        if op is c.MAX_REPEAT:
            return some(arg[2]) if whole or arg[0] else ""
        return some(arg[1][pick % len(arg[1])]) if op is c.BRANCH else some(arg[3])

    def some(items) -> str:
        return "".join(one(*x) for x in items)

    return some(_parser.parse(pattern))


def test_every_license_rule_fires(spark):
    cases = sorted({(example(p, pick, whole), label, priority) for _, p, label, priority in licenses.rules() for pick in range(6) for whole in (False, True)})
    got = {x.doc_id: x.detections for x in licenses.scan(docs(spark, [f"x {t} x" for t, _, _ in cases])).collect()}
    dull = [t for k, (t, _, priority) in enumerate(cases) if not any(d.b - d.a >= len(t.split()) and d.priority >= priority for d in got[k])]
    assert not dull, (len(dull), len(cases), dull[:5])


def test_license_grants_without_the_word(spark):
    """Nothing but a rule's own keywords decides whether it is tried."""
    cases = {
        "Released under the GPL 2.": "gpl-2",
        "Distributed under the Apache 2.0": "apache-2",
        "Covered under the BSD 3 clause": "bsd-3-clause",
        "available under CC BY-SA 4.0": "cc-by-sa",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2",
        "SPDX-License-Identifier: 0BSD": "0bsd",
        "license: LGPL-2.1-or-later": "lgpl-2.1",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "see https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
        "under the same terms as Perl itself": "perl",
        "mit freundlichen Worten": "",
    }
    got = {x.doc_id: x.labels for x in licenses.scan(docs(spark, list(cases))).collect()}
    assert all(want in got[k].split(",") for k, want in enumerate(cases.values())), got


def test_every_match_holds_its_keywords():
    for keywords, pattern, _, _ in licenses.rules():
        for pick in range(6):
            for whole in (False, True):
                text = f" {example(pattern, pick, whole)} "
                assert all(k in text for k in keywords), (keywords, text)


def test_contained_detection_is_suppressed(spark):
    x = licenses.scan(docs(spark, ["Licensed under the Apache License, Version 2.0"])).first()
    assert {d.label for d in x.detections} == {"apache-2"} and len({(d.a, d.b) for d in x.detections}) == 1


# tokens


def test_packing(spark):
    tok = tokenizer_path("word_bpe_49k.json")
    texts = [" ".join(prose(i, 30 * i)) for i in range(40)] + ODD + ["Straße İx ΣΑΣ. á <|endoftext|> it's... 3,5"]
    got = packing.pack_documents(docs(spark, texts), tok).toPandas()
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(tok), {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(docs(spark, []), tok).count() == 0


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, encode, r = Tokenizer.from_file(path), packing.word_encoder(path), random.Random(11)
    bits = [*"abcXYZ019 .,.,  \n\t'’<|>-_!?éÉßİıſÅå漢字×÷ªµʼŉ½²\u0331\u0301\u0308\u0307\u00a0\u0085\x1c\x00", "<|", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", " the ", "The cat <|x", "İ,X", "H\u0331", "😀", "Σ", "ς", "ǅ", "ﬁ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(10_000)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_best_fit_rule():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    fit = packing.BestFit(10, 1)
    assert [fit.place(n)[0] for n in (6, 7, 3, 4)] == [0, 1, 1, 2]  # the only open bin closes for a new one
    r = random.Random(8)
    fit, sizes = packing.BestFit(2048, 1024), [r.randrange(1, 2048) for _ in range(20000)]
    for k in range(0, len(sizes), packing.ARRIVALS):
        for n in sorted(sizes[k : k + packing.ARRIVALS], reverse=True):
            fit.place(n)
    assert fit.made <= 1.01 * sum(sizes) / 2048


def test_token_attribution():
    from public_tokenizers import PATTERN

    enc, size = token_counts.encoder(tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc ", "é", "漢", "\n", "\n\n", " ", "🙂"]) for _ in range(r.randrange(1, 30)))
        spans = token_counts._lines(text, 0)
        counts, _ = token_counts.attribute(text, enc.encode_ordinary(text), size, spans)
        owner = [k for k, (s, n) in enumerate(spans) for _ in range(n)]
        want, at = [0] * len(spans), 0
        raw = text.encode()
        lead = [k for k in range(len(raw)) if raw[k] & 0xC0 != 0x80]
        for t in enc.encode_ordinary(text):
            chars = [n for n, k in enumerate(lead) if at <= k < at + size[t]] or [max(n for n, k in enumerate(lead) if k < at)]
            held = collections.Counter(owner[n] for n in chars)
            want[min(k for k, v in held.items() if v == max(held.values()))] += 1
            at += size[t]
        assert counts.tolist() == want


def test_token_counts_query(spark):
    from public_tokenizers import PATTERN

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    out = token_counts.count_tokens(odd(spark), path, PATTERN)
    assert out.count() == 2 * len(ODD) + 1 and out.where("n_tokens <> aggregate(sections, 0L, (a, s) -> a + s.tokens)").count() == 0
    two = token_counts.count_tokens(odd(spark), path, PATTERN, ("lang", "text")).where("doc_id = 3").first()
    assert [s.field for s in two.sections] == ["lang", "text"] and two.n_chars == 4


# toxicity


def test_toxicity_held_out(spark):
    r = random.Random(10)
    bad = ["grumfoo", "snarlix", "blexor"]
    texts, y = [], []
    for i in range(900):
        w = prose(i, r.randrange(5, 150), 300)
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "ed", f"q{r.randrange(50)}"])
        texts.append(" ".join(w))
        y.append(int(toxic))
    labels = spark.createDataFrame([(i, 0, v) for i, v in enumerate(y)] + [(None, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs(spark, texts).repartition(3), labels).select("doc_id", "score", toxicity.held_out("doc_id").alias("h")).collect()
    assert {x.doc_id for x in out if x.h} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(x.score >= toxicity.THRESHOLD) == y[x.doc_id] for x in out if x.h]
    assert sum(right) / len(right) > 0.95


def test_training_keeps_features_out_of_memory(monkeypatch):
    """The features of all texts at once would take some ten times the texts; how the texts are cut into slices changes nothing."""
    import tracemalloc

    monkeypatch.setattr(toxicity, "STEPS", 1)
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=3000)) for _ in range(240)]
    toxic = np.arange(len(texts)) % 3 == 0
    tracemalloc.start()
    toxicity.train(texts, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6
    some, labels = texts[:20], toxic[:20]
    weight, bias = toxicity.train(some, labels)
    monkeypatch.setattr(toxicity, "_by_length", lambda t: [[x] for x in t])
    again, shift = toxicity.train(some, labels)
    assert bias == shift and (weight == again).all() and weight.any()
    none, _ = toxicity.train(["", " "], np.array([0, 1]))
    assert not none.any()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(odd(spark), labels)
    assert out.count() == 2 * len(ODD) + 1 and out.where("score between 0 and 1").count() == out.count()
    weight = np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = [x or "" for x in ODD] + [" ".join(prose(1, 500))]
    together = toxicity.scores(texts, weight, 0.1)
    assert np.allclose(together, [toxicity.scores([t], weight, 0.1)[0] for t in texts])


def test_tables_are_empty(spark):
    none = docs(spark, [])
    assert pii.find_pii(none).count() == licenses.scan(none).count() == 0
    assert toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(none, bench).count() == 0 and decontaminate.find_overlaps(docs(spark, ["a b"]), bench).count() == 1


@pytest.mark.parametrize("name", ["op3_substring", "op10_lines"])
def test_equals_sql(spark, name):
    import duckdb

    from palimpsest.llm import registry

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, small).select(*names).collect())) == sorted(cur.fetchall())
