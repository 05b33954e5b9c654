"""Writing: revisions, transactions with optimistic checks, snapshots; versioned Parquet folders with a pointer file.

A transaction writes new files beside the old ones, claims the next version's number and lists it last, so readers
see all of it or nothing; files of a failed attempt are never listed. A writer that dies between claim and listing
leaves a claim that an operator must remove.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored

#: A delta is written while the parent's run began fewer revisions ago than this (the reference value of the model).
MAX_DELTA = 50


class ConflictError(Exception):
    """A root changed since the client read it."""


class Store:
    """Tables in versioned folders under one path; a version's empty file in ``_versions`` is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        """The newest complete version. A version is complete once its claim names a folder."""
        fs, at = self._fs(f"{self.path}/_versions")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        return names[-1] if names else None

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version()}/{table}")

    def commit(self, tables: dict[str, DataFrame], expected: DataFrame | None = None) -> str:
        """Writes all tables as a new version; in ``proots`` the written roots get txn_id + 1.

        expected (proot, txn_id) must equal the stored numbers. The version after the one that was read is claimed by
        creating its file, which only one writer can: a writer that comes second fails and its files are never read.
        """
        old = self.version()
        if old:
            have = self.spark.read.parquet(f"{self.path}/{old}/proots").select("proot", F.col("txn_id").alias("_have")) if expected is not None or "proots" in tables else None
        if expected is not None and old and not expected.join(have, "proot", "left").where("_have is null or _have <> txn_id").isEmpty():
            raise ConflictError("a root was changed by another transaction")
        if old and "proots" in tables and tables["proots"].columns:
            new = tables["proots"].join(have, "proot", "left")
            tables = tables | {"proots": new.withColumn("txn_id", F.coalesce(F.col("_have") + 1, "txn_id")).drop("_have")}
        number = 1 + (int(old) if old else 0)
        name = f"{number:08d}"
        work = f"{self.path}/{name}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{work}/{table}")
        fs, final = self._fs(f"{self.path}/{name}")
        source = self._fs(work)[1]
        if not self._claim(f"{self.path}/_claims/{name}"):
            fs.delete(source, True)
            raise ConflictError("another transaction claimed the version")
        fs.rename(source, final)
        self._claim(f"{self.path}/_versions/{name}")
        return name

    def _claim(self, path: str) -> bool:
        """Creates an empty file unless it is there."""
        fs, at = self._fs(path)
        fs.mkdirs(at.getParent())
        return bool(fs.createNewFile(at))

    def clear(self) -> str:
        """An empty version of every table."""
        old = self.version()
        names = ["proots"] if old is None else [r.table for r in self.tables()]
        return self.commit({t: self.read(t).limit(0) for t in names})

    def tables(self) -> list:
        """Names of the current version's tables."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.version()}")
        listed = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(fs)
        return self.spark.createDataFrame([(x.getPath().getName(),) for x in listed], "table string").collect()


def delta_layout(revisions: DataFrame, max_delta: int = MAX_DELTA) -> DataFrame:
    """(backing, revid, delta_base): a revision joins its parent's run while that began fewer than max_delta numbers ago, else it is a snapshot.

    Level by level from the revisions without parent; each level is written, so lost executors repeat one level at most.
    """
    child = revisions.where("parent is not null").select(F.col("backing").alias("b"), F.col("parent").alias("p"), F.col("revid").alias("c"))
    level = stored(revisions.where("parent is null").select("backing", "revid", F.col("revid").alias("delta_base")), "run")
    out = None
    while not level.isEmpty():
        out = level if out is None else out.unionByName(level)
        step = level.join(child, (F.col("backing") == F.col("b")) & (F.col("revid") == F.col("p")))
        level = stored(step.selectExpr("backing", "c revid", f"if(c - delta_base < {max_delta}, delta_base, c) delta_base"), "run")
    return level if out is None else out
