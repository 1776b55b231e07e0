"""Conversations as a tree: a node for every distinct beginning, in depth-first order.

A beginning is named by its depth and running sums of hashes of (place, turn). Sums can be carried
over the borders of parts, so a conversation with a third of all turns is spread like any
other. A second hash of (parent, turn) proves that a name stands for one beginning; if ever it does
not, all names are made again with another salt.

Depth-first order needs no sequence of all turns: nodes that follow one another without a branch
and without an end form a run, and a node's ``path`` holds the names of the runs it goes through,
as many as there are branches above it. Sorting nodes by path and depth is depth-first order.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import match, save

#: A name is the digest of depth and sums; this is the beginning without turns.
ROOT = hashlib.md5(b"0:0:0").digest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, role, text``; null role and text are empty, rows without id left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, 16)
    return rows.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), "role", "text")


def dealt(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` saved in ranges of conversation and ``order``, with the number of the ``part``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``all_<value>``, the sums of each conversation up to the row.

    Sums are made within a part. What earlier parts hold of the conversation is added; only the
    first conversation of a part can have such, so that table has at most one row a part.
    """
    here = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy("conv_id").orderBy("part")
    totals = rows.groupBy("conv_id", "part").agg(*[F.sum(v).alias(v) for v in values])
    before = [(F.sum(v).over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)).alias(f"before_{v}") for v in values]
    before = totals.select("conv_id", "part", F.row_number().over(parts).alias("nth"), *before).filter("nth > 1").drop("nth")
    sums = {f"all_{v}": F.sum(v).over(here) + F.coalesce(f"before_{v}", F.lit(0)) for v in values}
    joined = rows.join(F.broadcast(before), ["conv_id", "part"], "left")
    return joined.withColumns(sums).drop(*[f"before_{v}" for v in values])


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``depth``, the place from 1 in the order of turn (null first) and digest."""
    order = ["turn", "digest"]
    placed = dealt(rows, order, "turns").withColumn("one", F.lit(1).cast("long"))
    return running(placed, order, ["one"]).withColumnRenamed("all_one", "depth").drop("one", "part")


def _name(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def named(rows: DataFrame, salt: int) -> DataFrame:
    """Adds ``key`` and ``parent``, the names of the beginnings with and without the row's turn."""
    hashes = {f"h{i}": F.xxhash64(F.lit(f"{salt}/{i}"), "depth", "digest").cast("decimal(20,0)") for i in (1, 2)}
    rows = running(rows.withColumns(hashes), ["depth"], ["h1", "h2"])
    sums = [F.col("all_h1"), F.col("all_h2")]
    before = [F.col("all_h1") - F.col("h1"), F.col("all_h2") - F.col("h2")]
    rows = rows.withColumn("key", _name(F.col("depth"), *sums)).withColumn("parent", _name(F.col("depth") - 1, *before))
    return rows.drop("part", "h1", "h2", "all_h1", "all_h2")


def tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named turns and the nodes of conversations ``(conv_id, depth, digest, ...)``.

    A node is the row of its smallest member, with ``n_convs`` (members), ``parent_convs`` and
    ``parent_conv_id`` (of the parent; null at depth 1) and ``path``. Rows are unique by
    ``(conv_id, depth)`` and depths go from 1 without gaps.
    """
    placed = dealt(rows, ["depth"], "placed")
    for salt in itertools.count():
        turns = save(named(placed, salt), "named")
        proof = F.xxhash64("parent", "digest", "depth")
        counts = turns.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(proof).alias("least"), F.max(proof).alias("most")
        )
        counts = save(counts, "members")
        if counts.filter("least <> most").isEmpty():
            break
    own = match(turns, counts.select("key", "conv_id", "n_convs"), ["key", "conv_id"])
    above = counts.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    nodes = save(match(own, above, ["parent"], "left"), "nodes")
    first = nodes.filter("parent_convs is null or n_convs < parent_convs").select("key")
    heads = match(turns.select("conv_id", "depth", "key"), first, ["key"], "left_semi")
    paths = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("heads"))
    above = F.filter("heads", lambda h: h["depth"] <= F.col("depth"))
    nodes = match(nodes, paths, ["conv_id"]).withColumn("path", F.transform(above, lambda h: h["key"])).drop("heads")
    return turns, save(nodes, "tree")
