"""Exact duplicates by deterministic block naming.

Texts are compared after lower-casing A-Z. Each is cut into blocks of a fixed number of
bytes. All blocks of the corpus are dealt to partitions by a hash and sorted there by hash and
content; a block's name is the number of its first place in that order. Equal blocks have the same
name, others have different ones, whatever their hashes are. Then names at places 2j and 2j+1 are taken as pairs, the distinct pairs sorted and named in turn, until
every text has one name. Texts of the same number of blocks have the same name exactly if they are
equal; hashes only deal blocks out, tell rows of one id apart and find frequent blocks.

Only built-in functions are used. A block moves once, to its place in the order. Blocks that make up
more than a share of all rows would meet in one task: there are fewer of them than that share
allows, so they are named first and their rows find the name where they lie. Names
return to pairs by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import lowered, match, save

BLOCK_BYTES = 4096
#: A block in one of so many rows is frequent; there are at most as many of them.
FREQUENT = 256
CLASS = ["n_bytes", "print"]


def with_class(docs: DataFrame) -> DataFrame:
    """Adds ``body`` (normalised text) and what tells rows of one id apart."""
    body = lowered(F.col("text"))
    return docs.withColumn("body", body).withColumns({"n_bytes": F.octet_length(body), "print": F.xxhash64(body)})


def in_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``doc_id, n_bytes, print, n_blocks, place, block, hash``; an empty text is one empty block."""
    bytes_ = F.col("body").cast("binary")
    last = F.floor((F.greatest(F.octet_length("body"), F.lit(1)) - 1) / block_bytes).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(bytes_, i * block_bytes + 1, F.lit(block_bytes)))
    rows = texts.select("doc_id", *CLASS, (last + 1).alias("n_blocks"), F.posexplode(blocks).alias("place", "block"))
    return rows.withColumn("hash", F.xxhash64("block"))


def frequent_blocks(rows: DataFrame, share: int) -> DataFrame | None:
    """``block, name`` of the blocks in more than one of ``share`` rows, fewer than ``share``; None without any."""
    counts = save(rows.groupBy("hash").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashes = [r["hash"] for r in counts.filter(F.col("n") * share > total).filter("n > 1").select("hash").collect()]
    if not hashes:
        return None
    blocks = rows.filter(F.col("hash").isin(hashes)).select("block").distinct()
    return blocks.withColumn("name", -F.row_number().over(Window.orderBy("block")).cast("long"))


def named_blocks(rows: DataFrame, share: int = FREQUENT) -> DataFrame:
    """``name`` in place of ``block``: equal names mean equal blocks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = frequent_blocks(rows, share)
    if known is not None:
        known = save(known, "frequent")
    others = rows if known is None else rows.join(F.broadcast(known.select("block")), "block", "left_anti")
    # Equal blocks come to one partition, which is sorted already where the window looks at it.
    others = others.repartition(n, "hash").sortWithinPartitions("hash", "block").withColumn("at", F.monotonically_increasing_id())
    others = others.withColumn("name", F.min("at").over(Window.partitionBy("hash", "block"))).drop("at", "hash", "block")
    if known is None:
        return others
    return others.unionByName(rows.join(F.broadcast(known), "block").drop("hash", "block"))


def named_pairs(rows: DataFrame) -> DataFrame:
    """``name`` in place of ``left`` and ``right``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.select("left", "right").distinct().repartitionByRange(n, "left", "right").sortWithinPartitions("left", "right")
    names = save(pairs.withColumn("name", F.monotonically_increasing_id()), "pairs")
    return match(rows, names, ["left", "right"]).drop("left", "right")


def name_texts(texts: DataFrame, block_bytes: int = BLOCK_BYTES, share: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, print, size, name)``: equal size (in blocks) and name mean equal texts."""
    level = save(named_blocks(in_blocks(texts, block_bytes), share).withColumn("size", F.col("n_blocks")), "names")
    done = level.filter("n_blocks = 1")
    left = level.agg(F.max("n_blocks")).first()[0] or 1
    while left > 1:
        odd = F.col("place") % 2 == 1
        pairs = (
            level.filter("n_blocks > 1")
            .groupBy("doc_id", *CLASS, "size", F.floor(F.col("place") / 2).cast("int").alias("place"))
            .agg(
                F.ceil(F.first("n_blocks") / 2).cast("int").alias("n_blocks"),
                F.max(F.when(~odd, F.col("name"))).alias("left"),
                F.max(F.when(odd, F.col("name"))).alias("right"),
            )
        )
        # A last block without a partner is paired with what is no name.
        pairs = pairs.withColumn("right", F.coalesce("right", F.lit(-(2**62))))
        level = save(named_pairs(pairs), "names")
        done = done.unionByName(level.filter("n_blocks = 1"))
        left = (left + 1) // 2
    return done.select("doc_id", *CLASS, "size", "name")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which documents ``(doc_id, text, ...)`` have the same text and which one stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, print``, one row per
    document. The largest doc_id of a group stays. Null text counts as empty; rows that repeat
    a doc_id with an equal text are one document; a null doc_id is the smallest. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = with_class(docs.select("doc_id", "text"))
    keys = docs.select("doc_id", *CLASS, F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")).distinct()
    keys = save(keys, "texts")
    names = save(name_texts(docs, block_bytes).distinct(), "identities")
    groups = names.groupBy("size", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = match(names, groups, ["size", "name"]).drop("size", "name")
    return match(keys, found, ["doc_id", *CLASS]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *CLASS
    )


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, all columns, one row each; see ``exact_duplicates``."""
    columns = docs.columns
    kept = exact_duplicates(docs, block_bytes).filter("kept").select("doc_id", *CLASS)
    # The least id stands for none, so that plain keys can be joined and counted.
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key")
    rows = with_class(docs.select(F.struct(*columns).alias("row"), "doc_id", "text"))
    keys = ["id_key", *CLASS]
    rows = rows.select("row", key, *CLASS).join(kept.select(key, *CLASS), keys, "left_semi")
    return rows.dropDuplicates(keys).select("row.*")
