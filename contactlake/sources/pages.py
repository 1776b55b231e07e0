"""Page tables and seed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.functions import charsets
from contactlake.functions.text import strip

MAX_PAGE_BYTES = 10 * 1024 * 1024


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A page table: ``url`` and ``html``, plus whatever other columns it has.

    Pages are parsed where they are read and never shuffled; where a table gives too few
    splits for the cores, set ``spark.sql.files.maxPartitionBytes`` or write smaller row groups.
    """
    pages = spark.read.format(fmt).options(**options).load(path)
    missing = {"url", "html"} - set(pages.columns)
    if missing:
        raise ValueError(f"page table {path} lacks {sorted(missing)}")
    return pages


def decoded_pages(fetched: DataFrame, body: str = "body") -> DataFrame:
    """Pages as fetched (``url``, bytes in ``body``, maybe ``content_type``) with ``charset`` and ``html`` in place of the bytes.

    Decoding is a column like any other, in the pass that parses the page. A null body gives null html.
    """
    kind = F.col("content_type") if "content_type" in fetched.columns else F.lit(None).cast("string")
    rows = fetched.withColumn("charset", F.when(F.col(body).isNotNull(), charsets.charset_of(F.col(body), kind)))
    return rows.withColumn("html", charsets.decoded(F.col(body), F.col("charset"))).drop(body)


def at_final_url(pages: DataFrame) -> DataFrame:
    """Pages under the URL that redirects ended at (``final_url``), the base of their links; ``requested_url`` keeps the other."""
    rows = pages.withColumn("requested_url", F.col("url"))
    return rows.withColumn("url", F.coalesce(F.nullif(strip(F.col("final_url")), F.lit("")), F.col("url"))).drop("final_url")


def admission(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> Column:
    """Whether a page is worth parsing: fetched without error, of an HTML type, not too large.

    Status and content type are only checked when the table has those columns; a page
    without HTML is let through, it has no contacts.
    """
    keep: Column = F.octet_length("html") <= max_bytes
    if "content_length" in pages.columns:
        keep = (F.col("content_length") <= max_bytes) & keep
    if "content_type" in pages.columns:
        kind = F.lower("content_type")
        keep = (kind.contains("text/html") | kind.contains("application/xhtml+xml")) & keep
    if "status_code" in pages.columns:
        keep = (F.col("status_code") < 400) & keep
    return keep | F.col("html").isNull()


def admitted_pages(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """The pages worth parsing; see ``admission``."""
    return pages.filter(admission(pages, max_bytes))


def seed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Seed URLs of a table of text lines: trimmed, blank lines dropped, duplicates kept."""
    return lines.withColumn("seed_url", strip(F.col(line))).filter(F.col("seed_url") != "")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed list from text: one URL per line, in file order.

    ``seq`` orders the lines (file, block in the file, line in the block), so
    no task has to number the whole list. An empty list is an error.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )
    seeds = seed_lines(lines).select("seq", "seed_url")
    if seeds.isEmpty():
        raise ValueError(f"seed list {path} holds no URL")
    return seeds


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="contactlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
