"""License scans by ordered signature rules, in Spark SQL functions only.

A text is normalised to its words (ASCII letters in lower case; words are runs of
ASCII letters, digits and non-ASCII characters).  Every rule is a regular
expression over the words with keywords, a label and a priority (``license_rules``).  A rule
is tried only where all its keywords stand in the text, and every match of its own
pattern holds them.  A detection whose interval of words lies inside another
detection's is suppressed if that one has a higher priority, or the same priority
and more words.  Base phrases are always reported.

Edge cases: null text is empty; texts without a hit have no label, score 0 and null
places; one output row per input row, so repeated rows and null ids are kept; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.license_rules import rules

#: Phrases (words) and the labels they stand for.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _places(pattern: str) -> str:
    """SQL: [(start, end)] in words of all matches of a pattern in s (words, a space before each and one at the end)."""
    spaces = "length({0}) - length(replace({0}, ' ', ''))"
    pair = f"zip_with(slice(split(s, {pattern}, -1), 1, size(regexp_extract_all(s, {pattern}, 0))), regexp_extract_all(s, {pattern}, 0), (g, m) -> struct(cast({spaces.format('g')} as long) as g, cast({spaces.format('m')} as long) as m))"
    step = "(acc, z) -> struct(acc.at + z.g + z.m as at, concat(acc.found, array(struct(acc.at + z.g as a, acc.at + z.g + z.m as b))) as found)"
    zero = "struct(0L as at, cast(array() as array<struct<a:bigint,b:bigint>>) as found)"
    return f"aggregate({pair}, {zero}, {step}, acc -> acc.found)"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, detections left after suppression, labels and score. No shuffle."""
    table: dict[tuple[str, ...], list] = {}
    for keywords, pattern, label, priority in rules():
        table.setdefault(keywords, []).append(F.struct(F.lit(f" (?:{pattern})(?= )").alias("rx"), F.lit(label).alias("label"), F.lit(priority).alias("priority")))
    groups = F.array(*(F.struct(F.array(*map(F.lit, k)).alias("keywords"), F.array(*v).alias("rules")) for k, v in table.items()))
    x = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    norm = f"concat(' ', trim(BOTH ' ' FROM regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{_GAP}', ' ')), ' ')"
    x = x.selectExpr("doc_id", f"{norm} s").withColumn("n_words", F.expr("if(s = '  ', 0L, cast(length(s) - length(replace(s, ' ', '')) - 1 as long))")).withColumn("groups", groups)
    base = ", ".join(f"transform({_places(repr(f' {p}(?= )'))}, y -> struct(y.a as a, y.b as b, '{label}' as label))" for p, label in BASE)
    x = x.withColumn("base", F.expr(f"flatten(array({base}))"))
    tried = f"flatten(transform(filter(groups, k -> forall(k.keywords, w -> contains(s, w))), k -> flatten(transform(filter(k.rules, r -> s rlike r.rx), r -> transform({_places('r.rx')}, y -> struct(y.a as a, y.b as b, r.priority as priority, r.label as label))))))"
    x = x.withColumn("all_", F.expr(tried))
    covers = "o.a <= d.a and o.b >= d.b and (o.priority > d.priority or (o.priority = d.priority and o.b - o.a > d.b - d.a))"
    x = x.withColumn("detections", F.expr(f"filter(all_, d -> not exists(all_, o -> {covers}))"))
    names = "array_join(array_sort(array_distinct({0})), ',')"
    return x.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as long) n_base",
        "array_min(transform(base, y -> y.a)) first_word",
        "array_max(transform(base, y -> y.a)) last_word",
        f"{names.format('transform(base, y -> y.label)')} base_labels",
        f"{names.format('concat(transform(base, y -> y.label), transform(detections, y -> y.label))')} labels",
        "greatest(if(size(base) > 0, 0.8D, 0.0D), coalesce(array_max(transform(detections, y -> y.priority)), 0) / 100.0D) score",
        "detections",
    )
