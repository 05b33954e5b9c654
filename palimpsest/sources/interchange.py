"""Files as tables: graphs in binary or JSON form, attachments by content."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec

ATTRS = "path string, root string, item string, attr string, type int, val string, vals array<string>"


def _text(v) -> str | None:
    if v is None:
        return None
    return base64.b64encode(v).decode() if isinstance(v, bytes) else str(v)


def _rows(path: str, root: str, items: list[dict]) -> Iterator[tuple]:
    for item in items:
        for name, (code, v) in item["attrs"].items():
            many = [_text(x) for x in v] if isinstance(v, list) else None
            yield path, root, item["id"], name, code, None if many is not None else _text(v), many


def read_graphs(spark: SparkSession, path: str, form: str = "binary") -> DataFrame:
    """Attributes of the items of all graph files under a path, in long form; form is binary or json. Files are read where they lie, by tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                root, items = codec.graph_from_binary(bytes(raw)) if form == "binary" else codec.graph_from_json(bytes(raw).decode())
                out += _rows(name, root, items)
            yield pd.DataFrame(out, columns=["path", "root", "item", "attr", "type", "val", "vals"])

    return files.mapInPandas(run, ATTRS)


def import_attachments(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(attachment, n_bytes, path) of files by the SHA-1 of their content, once each; those already known (attachment) are left out."""
    files = spark.read.format("binaryFile").load(path)
    found = files.groupBy(F.sha1("content").alias("attachment")).agg(F.max("length").alias("n_bytes"), F.min("path").alias("path"))
    return found if known is None else found.join(known.select("attachment"), "attachment", "left_anti")
