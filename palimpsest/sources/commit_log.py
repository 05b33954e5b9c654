"""The commit log of versioned documents, read from parquet or projected from an event table.

Tables (all carry ``backing``, the physical log that a root shares with its cheap copies):

* revisions: backing, revid, rev, parent, merge_parent, branch, ts, value, k, item
* branches:  proot, branch, backing, parent_branch, head, current, deleted
* proots:    proot, backing, current_branch, deleted
* commands:  seq, track, proot, branch, old, new
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.storage import stored

#: Root ids of cheap copies begin here.
COPY_BASE = 100_000


class CommitLog:
    """Lazily derived model tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def projected(self) -> DataFrame:
        """Events as revisions: one root per user, one branch per event type, forks, reverts and merges by rule."""
        root = Window.partitionBy("backing").orderBy("ts", "rev")
        own = Window.partitionBy("backing", "branch").orderBy("revid")
        r = self.table("events").select(
            F.col("user_id").alias("backing"), F.col("event_type").alias("branch"), F.col("event_id").alias("rev"), "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
        )
        r = r.withColumn("revid", F.row_number().over(root).cast("long") - 1)
        r = r.withColumn("l1", F.lag("revid", 1).over(own)).withColumn("l2", F.lag("revid", 2).over(own))
        fork = F.when(F.col("revid") > 0, F.col("revid") - 1)
        parent = F.when(F.col("l1").isNull(), fork).when((F.col("k") % 10 == 0) & F.col("l2").isNotNull(), F.col("l2")).otherwise(F.col("l1"))
        r = r.withColumn("parent", parent).drop("l1", "l2")
        before = F.col("revid") - 1
        merge = F.when((F.col("k") % 7 == 0) & (F.col("revid") > 1) & ~before.eqNullSafe(F.col("parent")), before)
        return r.withColumn("merge_parent", merge).withColumn("item", F.col("k") % 20)

    @cached_property
    def revisions(self) -> DataFrame:
        """The projection, written once: recursion reads it many times."""
        return stored(self.projected, "revisions")

    @cached_property
    def branches(self) -> DataFrame:
        r = self.revisions
        ends = r.groupBy(F.col("backing").alias("proot"), "branch").agg(F.max("revid").alias("head"), F.max_by("k", "revid").alias("k"), F.max_by("parent", "revid").alias("up"), F.min_by("parent", "revid").alias("fork"))
        at = r.select(F.col("backing").alias("proot"), F.col("revid"), F.col("branch").alias("on_branch"))
        b = ends.join(at.withColumnRenamed("revid", "fork").withColumnRenamed("on_branch", "parent_branch"), ["proot", "fork"], "left")
        b = b.join(at.withColumnRenamed("revid", "up"), ["proot", "up"], "left")
        current = F.when((F.col("k") % 2 == 1) & (F.col("on_branch") == F.col("branch")), F.col("up")).otherwise(F.col("head"))
        b = b.select("proot", "branch", F.col("proot").alias("backing"), "parent_branch", "head", current.alias("current"), ((F.col("branch") == "error") & (F.col("proot") % 3 == 0)).alias("deleted"))
        trunk = r.where("revid = 0").select(F.col("backing").alias("proot"), F.col("branch"))
        copy = b.join(trunk, ["proot", "branch"]).where("proot % 4 = 3")
        copy = copy.select((F.col("proot") + COPY_BASE).alias("proot"), F.lit("copy").alias("branch"), "backing", F.col("branch").alias("parent_branch"), "head", F.col("head").alias("current"), F.lit(False).alias("deleted"))
        return b.unionByName(copy)

    @cached_property
    def proots(self) -> DataFrame:
        trunk = self.revisions.where("revid = 0").select(F.col("backing").alias("proot"), "backing", F.col("branch").alias("current_branch"), (F.col("backing") % 5 == 0).alias("deleted"))
        copy = trunk.where("proot % 4 = 3").select((F.col("proot") + COPY_BASE).alias("proot"), "backing", F.lit("copy").alias("current_branch"), F.lit(False).alias("deleted"))
        return trunk.unionByName(copy)

    @cached_property
    def commands(self) -> DataFrame:
        """One set-version command per revision; the sequence number follows (ts, rev)."""
        # a total order over all events: places inside sampled ranges of (ts, rev) plus the sizes of the ranges before, so no task sorts more than a range
        r = self.revisions.repartitionByRange("ts", "rev").sortWithinPartitions("ts", "rev")
        r = stored(r.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
        sizes = r.groupBy("part").agg(F.count("*").alias("n"))
        before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("skip"))
        r = r.join(F.broadcast(before), "part")  # one row per shuffle partition
        return r.select((F.col("skip") + F.col("place") + 1).cast("long").alias("seq"), F.concat_ws(".", F.lit("user"), F.col("backing").cast("string"), F.col("branch")).alias("track"), F.col("backing").alias("proot"), "branch", F.col("parent").alias("old"), F.col("revid").alias("new"), "k")


#: The same tables in SQL, for the oracle: a list of common table expressions.
MODEL_SQL = """
WITH RECURSIVE r0 AS (SELECT user_id AS backing, event_type AS branch, event_id AS rev, ts, value, CAST(props->>'k' AS INT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS revid FROM events),
r1 AS (SELECT *, lag(revid, 1) OVER w AS l1, lag(revid, 2) OVER w AS l2 FROM r0 WINDOW w AS (PARTITION BY backing, branch ORDER BY revid)),
r2 AS (SELECT backing, branch, revid, rev, ts, value, k, k % 20 AS item,
  CASE WHEN l1 IS NULL THEN CASE WHEN revid = 0 THEN NULL ELSE revid - 1 END WHEN k % 10 = 0 AND l2 IS NOT NULL THEN l2 ELSE l1 END AS parent FROM r1),
revisions AS (SELECT *, CASE WHEN k % 7 = 0 AND revid > 1 AND revid - 1 IS DISTINCT FROM parent THEN revid - 1 END AS merge_parent FROM r2),
ends AS (SELECT backing AS proot, branch, max(revid) AS head, arg_max(k, revid) AS k, min(revid) AS low FROM revisions GROUP BY 1, 2),
own AS (SELECT e.proot, e.branch, e.proot AS backing, f.branch AS parent_branch, e.head,
  CASE WHEN e.k % 2 = 1 AND u.branch = e.branch THEN h.parent ELSE e.head END AS current, (e.branch = 'error' AND e.proot % 3 = 0) AS deleted
  FROM ends e JOIN revisions h ON h.backing = e.proot AND h.revid = e.head JOIN revisions l ON l.backing = e.proot AND l.revid = e.low
  LEFT JOIN revisions f ON f.backing = e.proot AND f.revid = l.parent LEFT JOIN revisions u ON u.backing = e.proot AND u.revid = h.parent),
trunk AS (SELECT backing AS proot, branch FROM revisions WHERE revid = 0),
branches AS (SELECT * FROM own UNION ALL SELECT o.proot + 100000, 'copy', o.backing, o.branch, o.head, o.head, FALSE FROM own o JOIN trunk t ON t.proot = o.proot AND t.branch = o.branch WHERE o.proot % 4 = 3),
proots AS (SELECT proot, proot AS backing, branch AS current_branch, proot % 5 = 0 AS deleted FROM trunk UNION ALL SELECT proot + 100000, proot, 'copy', FALSE FROM trunk WHERE proot % 4 = 3),
commands AS (SELECT row_number() OVER (ORDER BY ts, rev) AS seq, 'user.' || backing || '.' || branch AS track, backing AS proot, branch, parent AS old, revid AS new, k FROM revisions),
chain AS (SELECT b.proot, b.branch, b.backing, r.revid, r.parent, 0 AS depth FROM branches b JOIN revisions r ON r.backing = b.backing AND r.revid = b.head
  UNION ALL SELECT c.proot, c.branch, c.backing, r.revid, r.parent, c.depth + 1 FROM chain c JOIN revisions r ON r.backing = c.backing AND r.revid = c.parent)
"""
