"""Value transformers: how an attribute's values are kept, and how they are read back.

A transformer is a pair of column functions and the type that its attribute persists. Both
run in the JVM; a pair that gives another type than the declared one is refused when
the plan is built, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transformer:
    """to_kept: value -> persisted value of type ``kept``; to_value: the way back, to type ``value``. Null stays null."""

    to_kept: Callable[[Column], Column]
    to_value: Callable[[Column], Column]
    kept: str
    value: str


def _through(df: DataFrame, by: dict[str, Transformer], way: str, declared: str) -> DataFrame:
    out = df.withColumns({c: F.when(F.col(c).isNotNull(), getattr(t, way)(F.col(c))) for c, t in by.items()})
    for c, t in by.items():
        if (got := out.schema[c].dataType.simpleString()) != getattr(t, declared):
            raise TypeError(f"transformer of {c} gives {got}, declared is {getattr(t, declared)}")
    return out


def persisted(df: DataFrame, by: dict[str, Transformer]) -> DataFrame:
    """df with the columns named in ``by`` as they are kept."""
    return _through(df, by, "to_kept", "kept")


def restored(df: DataFrame, by: dict[str, Transformer]) -> DataFrame:
    """The inverse of ``persisted``."""
    return _through(df, by, "to_value", "value")


#: Red, green and blue of 0 to 255 as an HTML colour.
COLOUR = Transformer(
    lambda c: F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c[p]), 2, "0")) for p in ("r", "g", "b"))),
    lambda c: F.struct(*(F.conv(F.substring(c, i, 2), 16, 10).cast("int").alias(p) for i, p in ((2, "r"), (4, "g"), (6, "b")))),
    "string",
    "struct<r:int,g:int,b:int>",
)
#: A rectangle as text, and back.
RECT = Transformer(
    lambda c: F.concat_ws(" ", *(c[p].cast("string") for p in ("x", "y", "width", "height"))),
    lambda c: F.struct(*(F.split(c, " ")[i].cast("double").alias(p) for i, p in enumerate(("x", "y", "width", "height")))),
    "string",
    "struct<x:double,y:double,width:double,height:double>",
)
