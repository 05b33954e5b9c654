"""Line dedup by distinct-site spread, in Spark SQL functions only.

A line (split at line feeds, trimmed of white space at both ends, not empty) is
boilerplate if it stands in documents of at least ``min_sites`` distinct sites; it
is then cut from every document.  Lines are known by a 128-bit digest.

* Lines whose documents all come from one site are set aside by a min/max
  aggregation; HyperLogLog sketches of the sites of the other lines merge by
  aggregation, first per (line, site bucket) on the map side.
* An estimate within ``MARGIN`` of the threshold is replaced by an exact distinct
  count of just these lines.
* The places of each text's boilerplate lines are gathered (bounded by its own lines)
  and the lines between them are joined again.

Edge cases: null text stays null and has no line; null sites count as no site; a
document may become empty and stays; repeated rows and equal or null ids are cut
each by its own text; extra columns, whatever their names, stay; rows are never dropped; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernels import fresh, stored

MIN_SITES, LG_K, MARGIN = 10, 12, 0.15
#: A boilerplate line meets its documents in so many parts.
SALTS = 16


def _digest(line: str) -> str:
    return f"struct(xxhash64(trim(BOTH ' \\t\\r' FROM {line})) as h1, xxhash64(42L, trim(BOTH ' \\t\\r' FROM {line}), 7L) as h2)"


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """Distinct (line, site, text) digests of all documents."""
    lines = docs.where("text is not null").selectExpr(f"cast(`{site}` as string) site", "xxhash64(text) text_hash", "explode(split(text, '\\n')) line")
    return lines.where("trim(BOTH ' \\t\\r' FROM line) <> ''").selectExpr(f"{_digest('line')} d", "site")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, sites) of the lines on at least min_sites sites."""
    pairs = _lines(docs, site).selectExpr("d.h1", "d.h2", "site").where("site is not null")
    # once per line and site, and only lines that more than one site has
    spread = pairs.groupBy("h1", "h2").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("h1", "h2")
    several = stored(pairs.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).join(spread, ["h1", "h2"], "left_semi").select("h1", "h2", "site"), "line-sites")
    est = several.groupBy("h1", "h2").agg(F.expr(f"hll_sketch_estimate(hll_sketch_agg(site, {LG_K}))").alias("est"))
    lo, hi = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    est = stored(est.where(f"est >= {lo}"), "line-spread")
    near = several.join(est.where(f"est <= {hi}"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    return est.where(f"est > {hi}").selectExpr("h1", "h2", "est sites").unionByName(near.where(f"sites >= {min_sites}"))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut from ``text``, and n_lines, n_removed (non-empty lines; columns of these names are replaced)."""
    bad = stored(boilerplate(docs, site, min_sites).select("h1", "h2"), "boilerplate")
    own = docs.where("text is not null").selectExpr("xxhash64(text) k1", "xxhash64(1L, text) k2", "posexplode(split(text, '\\n')) as (place, line)").where("trim(BOTH ' \\t\\r' FROM line) <> ''")
    own = own.selectExpr("k1", "k2", "place", f"{_digest('line')} d").selectExpr("k1", "k2", "place", "d.h1", "d.h2", f"pmod(k1, {SALTS}) salt")
    salted = bad.selectExpr("*", f"explode(sequence(0L, {SALTS - 1}L)) salt")
    # each place of a text once before the places are gathered: copies of a text add nothing
    gone = own.join(salted, ["h1", "h2", "salt"]).select("k1", "k2", "place").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("place")).alias("gone"))
    gone = stored(gone, "cuts")  # written, so that the join's partitions are free to be split where copies of a text meet
    rest = docs.drop("n_lines", "n_removed")
    k1, k2, gone_, lines_ = fresh([*docs.columns, "n_lines", "n_removed"], "k1", "k2", "gone", "lines")
    gone = gone.selectExpr(f"k1 `{k1}`", f"k2 `{k2}`", f"gone `{gone_}`")
    out = rest.withColumn(k1, F.expr("xxhash64(text)")).withColumn(k2, F.expr("xxhash64(1L, text)")).join(gone, [k1, k2], "left")
    out = out.withColumn(lines_, F.expr("split(text, '\\n')"))
    out = out.withColumn("n_lines", F.expr(f"if(text is null, 0L, cast(size(filter(`{lines_}`, l -> trim(BOTH ' \\t\\r' FROM l) <> '')) as long))"))
    out = out.withColumn("n_removed", F.expr(f"cast(if(`{gone_}` is null, 0, size(`{gone_}`)) as long)"))
    # what lies between two removed lines, for each of them and the end: linear in the lines
    begin, end = f"if(i = 0, 0, `{gone_}`[i - 1] + 1)", f"if(i = size(`{gone_}`), size(`{lines_}`), `{gone_}`[i])"
    kept = f"flatten(transform(sequence(0, size(`{gone_}`)), i -> slice(`{lines_}`, {begin} + 1, {end} - {begin})))"
    out = out.withColumn("text", F.expr(f"if(`{gone_}` is null, text, array_join({kept}, '\\n'))"))
    return out.select(*rest.columns, "n_lines", "n_removed")
