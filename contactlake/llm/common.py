"""Helpers shared by the corpus operators: saved tables, joins that can be split, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words are what lies between these bytes, written as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="contactlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def save(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``frame`` as a table in the shared folder, read again: its lineage ends there."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", compression).parquet(path)
    saved = frame.sparkSession.read.schema(frame.schema).parquet(path)
    saved.saved_at = path
    return saved


def discard(saved: DataFrame) -> None:
    """Delete a table made by ``save`` that nothing reads any more."""
    spark = saved.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(saved.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lowered(text: Column) -> Column:
    """Text with A-Z, and only these, in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null matching null, so that hot keys of ``left`` can be split.

    The keys are compared as one struct: neither side comes partitioned by it, both are
    exchanged for the join, and adaptive execution may cut a large partition of the left
    side and copy the fitting part of the right one. ``right`` should have a key once.
    """
    left = left.withColumn("match_key", F.struct(*keys))
    right = right.withColumn("match_key", F.struct(*keys)).drop(*keys)
    return left.join(right, "match_key", how).drop("match_key")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)``: the smallest node reachable, itself included.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so that long chains shrink quickly. Labels go to the shared folder every round;
    the driver only learns whether one changed. Loops and repeated links do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct()
    both = save(both, "links")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        offers = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        lower = labels.join(offers, labels["node"] == offers["a"]).select(
            "node", F.least("component", "offer").alias("component"), F.col("component").alias("before")
        )
        lower = save(lower, "labels")
        up = lower.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        jumped = lower.join(up, lower["component"] == up["parent"]).select(
            "node", F.col("above").alias("component"), (F.col("above") != F.col("before")).alias("changed")
        )
        jumped = save(jumped, "labels")
        discard(labels)
        discard(lower)
        labels = jumped.drop("changed")
        labels.saved_at = jumped.saved_at
        if jumped.filter("changed").isEmpty():
            return labels
