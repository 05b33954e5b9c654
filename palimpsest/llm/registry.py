"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; a path can be given to every operator instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import substring

    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], chr(32)) AS k FROM p),
m AS (SELECT k, min(doc_id) AS lo FROM g GROUP BY k),
r AS (SELECT DISTINCT g.doc_id, g.s + o.o AS pos FROM g JOIN m ON m.k = g.k AND m.lo < g.doc_id, (SELECT unnest(range(0, 13)) AS o) o),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT x.doc_id, string_agg(x.w[x.pos], chr(32) ORDER BY x.pos) FILTER (WHERE r.pos IS NULL) AS kept, count(r.pos) AS n
      FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.pos = x.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import decontaminate

    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = "array_sort(array_distinct(transform(overlaps, o -> o.item_id)))"
    return found.selectExpr("doc_id", "size(overlaps) > 0 contaminated", "cast(size(overlaps) as long) n_overlaps", f"{items} item_ids", "coalesce(array_max(transform(overlaps, o -> o.length)), 0) longest")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import ann

    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("id % 20 = 0"), 20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import token_counts
    from public_tokenizers import PATTERN

    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)
    return out.selectExpr("doc_id", "n_chars", "n_tokens", "n_crossing", "cast(size(sections) as long) n_sections", "transform(sections, s -> s.tokens) section_tokens")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import pii

    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import lines

    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
r AS (SELECT t.doc_id, count(*) FILTER (WHERE t.k <> '') AS n_lines, count(*) FILTER (WHERE b.k IS NOT NULL) AS n_removed,
      string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE b.k IS NULL) AS kept FROM t LEFT JOIN b ON b.k = t.k GROUP BY t.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neardup": op2_neardup,
    "op3_substring": op3_substring,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_ann": op7_ann,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_lines": op10_lines,
}
SQL: dict[str, str] = {"op3_substring": OP3_SQL, "op10_lines": OP10_SQL}
