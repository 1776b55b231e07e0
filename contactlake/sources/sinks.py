"""Writing results."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contactlake.functions.urls import domain_slug, netloc_of

RESULT_VERSION = "2.0.0"  # fixed value: version written into the result metadata


def with_metadata(results: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Add the ``_metadata`` struct; the time is the start of the query unless given."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    return results.withColumn(
        "_metadata",
        F.struct(stamp.alias("generated_at"), F.lit(RESULT_VERSION).alias("parser_version")),
    )


def result_json(results: DataFrame, *columns: str) -> DataFrame:
    """Each result as one JSON text in the column ``json``, other characters kept as they are."""
    names = columns or tuple(results.columns)
    return results.withColumn("json", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


class Summary(NamedTuple):
    """What a pass wrote."""

    total: int
    successful: int
    failed: int
    emails: int
    phones: int


def _counted(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` that count themselves while they are written."""
    success = F.coalesce("success", F.lit(False))
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0))
    seen = Observation()
    counts = [F.count(F.lit(1)), F.count_if(success), F.count_if(~success), size("emails"), size("phones")]
    return results.observe(seen, *[c.alias(n) for c, n in zip(counts, Summary._fields)]), seen


def write_json(results: DataFrame, path: str, mode: str = "errorifexists", generated_at: Column | None = None) -> Summary:
    """JSON lines with metadata, one file per task; absent values are written as null.

    The summary comes from the pass that writes: nothing is read or computed twice.
    """
    counted, seen = _counted(results)
    with_metadata(counted, generated_at).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return Summary(**{n: int(v) for n, v in seen.get.items()})


#: Outcomes that a candidate can have, besides being valid.
OUTCOMES = {
    "phone": (
        "not_normalized no_digits length not_phone_pattern suspicious_start few_unique_digits many_zeros country_code ru_area "
        "country_length ru_domain no_home_country local_length local_format"
    ).split(),
    "email": "no_at local_too_long domain_too_long domain_without_dot domain_edge_dot excluded_domain bad_local bad_domain".split(),
}


def write_candidates(checked: DataFrame, path: str, mode: str = "errorifexists") -> dict[tuple[str, str], int]:
    """Write checked candidates (``kind``, ``reason``, ...) as a table partitioned by kind, and count them by outcome on the way.

    Returns the number of candidates by kind and outcome (``valid`` or the reason), those that
    occur; outcomes that are not listed here are counted as ``other``.
    """
    outcome = F.coalesce("reason", F.lit("valid"))
    listed = [(kind, name) for kind, names in OUTCOMES.items() for name in ("valid", *names)]
    counts = [F.count_if((F.col("kind") == kind) & (outcome == name)).alias(f"{kind} {name}") for kind, name in listed]
    others = [F.count_if((F.col("kind") == kind) & ~outcome.isin("valid", *names)).alias(f"{kind} other") for kind, names in OUTCOMES.items()]
    seen = Observation()
    checked.observe(seen, *counts, *others).write.mode(mode).partitionBy("kind").parquet(path)
    return {tuple(name.split(" ")): n for name, n in seen.get.items() if n}


def partition_columns(results: DataFrame) -> DataFrame:
    """Add ``status`` (ok, error, no_domain) and ``domain_slug`` ('none' without one)."""
    netloc = netloc_of(F.col("url"))
    failed = ~F.coalesce("success", F.lit(False))
    status = F.when(failed, "error").when(F.coalesce(netloc, F.lit("")) == "", "no_domain").otherwise("ok")
    slug = F.when(status == "ok", domain_slug(F.col("url"))).otherwise("none")
    return results.withColumn("status", status).withColumn("domain_slug", slug)


def write_partitions(
    results: DataFrame, path: str, mode: str = "errorifexists", generated_at: Column | None = None, buckets: int = 16
) -> None:
    """A table partitioned by status and a hash bucket of the domain, sorted by domain.

    The number of folders is fixed, however many domains there are. The rebalance hint
    brings a folder's rows together to avoid many small files, and splits a bucket that
    holds a large share of the rows.
    """
    rows = partition_columns(with_metadata(results, generated_at))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("domain_slug"), F.lit(buckets)).cast("int"))
    rows = rows.hint("rebalance", "status", "bucket").sortWithinPartitions("status", "bucket", "domain_slug")
    rows.write.mode(mode).partitionBy("status", "bucket").parquet(path)


_RUN = "attempt string, total bigint, successful bigint, failed bigint, emails bigint, phones bigint, written_at timestamp, run string"


def write_run(results: DataFrame, path: str, run: str, generated_at: Column | None = None, buckets: int = 16) -> Summary:
    """Write the results of one run so that it counts once, however often it is written.

    Rows go to a folder of this attempt; only when they are complete, the run's row in the
    manifest names the attempt that counts, in place of an earlier one. A driver that is lost half-way leaves no
    row, and readers (``read_runs``) see neither its rows nor those of attempts that were replaced.
    """
    attempt, spark = uuid.uuid4().hex, results.sparkSession
    counted, seen = _counted(results)
    rows = partition_columns(with_metadata(counted, generated_at)).withColumn("run", F.lit(run)).withColumn("attempt", F.lit(attempt))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("domain_slug"), F.lit(buckets)).cast("int"))
    rows = rows.hint("rebalance", "status", "bucket").sortWithinPartitions("status", "bucket", "domain_slug")
    rows.write.mode("append").partitionBy("run", "attempt", "status", "bucket").parquet(f"{path}/rows")
    summary = Summary(**{n: int(v) for n, v in seen.get.items()})
    manifest = spark.createDataFrame([(attempt, *summary, None, run)], _RUN).withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/runs")
    return summary


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete run: its summary and the attempt that counts."""
    return spark.read.schema(_RUN).parquet(f"{path}/runs")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the complete runs; folders of other attempts are not read."""
    found = spark.read.parquet(f"{path}/rows")
    names = StructType([StructField(f.name, StringType() if f.name in ("run", "attempt") else f.dataType) for f in found.schema])
    rows = spark.read.schema(names).parquet(f"{path}/rows")
    return rows.join(read_manifest(spark, path).select("run", "attempt"), ["run", "attempt"]).drop("attempt", "bucket")
