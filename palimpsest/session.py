"""Session defaults: adaptive execution, UTC, enough recursion for revision chains."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword arguments use _ for dots."""
    b = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "8g")).config("spark.sql.shuffle.partitions", "8")
    return visible(b.getOrCreate())


def visible(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did, whatever the working directory is."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
    return spark
