"""The lookups as joins, for tables that want them as columns.

All lookup tables are fixed lists of at most 208 rows, so broadcasting them is
always safe. The column functions give the same answers without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake import lookups
from contactlake.functions import emails, urls


def with_home_code(table: DataFrame, url: str = "url") -> DataFrame:
    """Add ``tld`` and ``home_code`` (NULL for an unlisted top-level domain)."""
    known = F.broadcast(lookups.tld_country_table(table.sparkSession))
    return table.withColumn("tld", urls.tld_of(F.col(url))).join(known, "tld", "left")


def with_country_code(table: DataFrame, digits: str) -> DataFrame:
    """Add the ``code`` a number starts with (NULL for none).

    No code is a prefix of another, so of the three possible prefixes at most one
    is in the table: the lookup is an equi-join on the prefix length and text,
    folded into one map per task by the broadcast.
    """
    spark = table.sparkSession
    codes = lookups.country_code_table(spark)
    result = table
    for n in (1, 2, 3):
        side = codes.filter(F.length("code") == n).select(F.col("code").alias(f"_code{n}"))
        result = result.join(
            F.broadcast(side), F.substring(F.col(digits), 1, n) == F.col(f"_code{n}"), "left"
        )
    return result.withColumn("code", F.coalesce("_code3", "_code2", "_code1")).drop(
        "_code1", "_code2", "_code3"
    )


def with_longest_prefix(table: DataFrame, digits: str, codes: DataFrame, code: str = "code") -> DataFrame:
    """Add ``code``, the longest of ``codes`` that a number starts with (NULL for none).

    ``codes`` is a table of one's own, where codes may be prefixes of each other. Only its
    distinct lengths come to the driver. The table is joined once a length, longest first, and
    what has found its code is not looked up again. Codes without text do not count.
    """
    known = codes.select(F.col(code).cast("string").alias("_code")).filter("_code <> ''").distinct()
    lengths = sorted((r["n"] for r in known.select(F.length("_code").alias("n")).distinct().collect()), reverse=True)
    result = table.withColumn("code", F.lit(None).cast("string"))
    for n in lengths:
        side = known.filter(F.length("_code") == n).withColumn("_head", F.col("_code"))
        head = F.when(F.col("code").isNull() & (F.length(digits) >= n), F.substring(F.col(digits), 1, n))
        result = result.withColumn("_head", head).join(side, "_head", "left")
        result = result.withColumn("code", F.coalesce("code", "_code")).drop("_code", "_head")
    return result.select(*table.columns, "code")


def with_country_lengths(table: DataFrame, code: str = "code") -> DataFrame:
    """Add the allowed digit counts ``lengths`` of a calling code (NULL: default range)."""
    known = lookups.country_length_table(table.sparkSession).withColumnRenamed("code", code)
    return table.join(F.broadcast(known), code, "left")


def without_excluded_domains(table: DataFrame, email: str) -> DataFrame:
    """Drop addresses whose domain is on the exclusion list (exact match only)."""
    excluded = lookups.excluded_domain_table(table.sparkSession)
    keyed = table.withColumn("domain", emails.email_domain(F.col(email)))
    return keyed.join(F.broadcast(excluded), "domain", "left_anti")


def with_domain_class(table: DataFrame, email: str) -> DataFrame:
    """Add ``domain_class``: known, excluded or other."""
    classes = lookups.email_domain_class_table(table.sparkSession)
    keyed = table.withColumn("domain", emails.email_domain(F.col(email)))
    return keyed.join(F.broadcast(classes), "domain", "left").withColumn(
        "domain_class", F.coalesce("domain_class", F.lit("other"))
    )
