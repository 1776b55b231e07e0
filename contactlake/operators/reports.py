"""Counts, funnels, site results and batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.functions import emails, phones
from contactlake.functions.text import named_struct, strip, unfold
from contactlake.operators.run_tables import RunTables


def contact_rows(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Flat ``(keys, kind, value)`` rows of page contacts."""

    def tagged(kind: str, column: str):
        return F.transform(
            F.col(column), lambda v: named_struct(kind=F.lit(kind), value=v)
        )

    both = F.concat(tagged("email", "emails"), tagged("phone", "phones"))
    return unfold(contacts, keys, both, "c").select(*keys, "c.*")


def page_counts(contacts: DataFrame, keys: list[str]) -> DataFrame:
    return contacts.select(
        *keys,
        F.size("emails").cast("bigint").alias("n_emails"),
        F.size("phones").cast("bigint").alias("n_phones"),
        F.size("links").cast("bigint").alias("n_links"),
    )


def site_counts(deduped: DataFrame, site: str = "site") -> DataFrame:
    """Distinct contacts per site, from the deduplicated flat rows."""
    return deduped.groupBy(site).agg(
        F.count_if(F.col("kind") == "email").alias("n_emails"),
        F.count_if(F.col("kind") == "phone").alias("n_phones"),
    )


def validation_funnel(checked: DataFrame) -> DataFrame:
    """Candidates per kind and outcome, with totals per kind and overall (NULLs)."""
    return (
        checked.select("kind", F.coalesce("reason", F.lit("valid")).alias("outcome"))
        .rollup("kind", "outcome")
        .agg(F.count("*").alias("n"))
    )


def site_values(visited_contacts: DataFrame) -> DataFrame:
    """Distinct ``(seed_url, kind, value)`` that pass the result-level checks, in their final form."""
    distinct = visited_contacts.select("seed_url", "kind", "value").distinct()
    value = F.col("value")
    is_email = F.col("kind") == "email"
    kept = distinct.filter((is_email & emails.site_email_ok(value)) | (~is_email & phones.site_phone_ok(value)))
    return kept.withColumn("value", F.when(is_email, emails.normalize_email(value)).otherwise(strip(value))).distinct()


def contact_parts(visited_contacts: DataFrame, run: RunTables, values_a_part: int) -> DataFrame:
    """Sorted distinct contacts in rows of a bounded size: ``seed_url, kind, part, values``.

    Values are put in order across partitions. Each partition numbers its own; what earlier
    partitions hold of a site and kind is added, which concerns one site a partition at most.
    """
    site = ["seed_url", "kind"]
    ordered = site_values(visited_contacts).repartitionByRange(run.n_buckets, *site, "value")
    rows = run.save(ordered.withColumn("piece", F.spark_partition_id()), "site_values")
    pieces = Window.partitionBy(*site).orderBy("piece")
    sizes = rows.groupBy(*site, "piece").agg(F.count("*").alias("n"))
    before = sizes.select(*site, "piece", F.row_number().over(pieces).alias("nth"), (F.sum("n").over(pieces) - F.col("n")).alias("before"))
    before = F.broadcast(before.filter("nth > 1").drop("nth"))
    place = F.row_number().over(Window.partitionBy("piece", *site).orderBy("value")) + F.coalesce("before", F.lit(0)) - 1
    rows = rows.join(before, [*site, "piece"], "left").withColumn("part", F.floor(place / values_a_part))
    return rows.groupBy(*site, "part").agg(F.array_sort(F.collect_list("value")).alias("values"))


def site_results(visited_contacts: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per seed: sorted distinct contacts over its visited pages.

    ``visited_contacts`` is flat ``(seed_url, kind, value)`` of a walk with a page budget, which
    bounds the arrays; for whole sites there is ``contact_parts``.
    """
    kept = site_values(visited_contacts)
    grouped = kept.groupBy("seed_url").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "email", F.col("value")))).alias("emails"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phone", F.col("value")))).alias("phones"),
    )
    nothing = F.array().cast("array<string>")
    return seeds.join(grouped, "seed_url", "left").select(
        *seeds.columns,
        F.coalesce("emails", nothing).alias("emails"),
        F.coalesce("phones", nothing).alias("phones"),
    )


def batch_rows(results: DataFrame) -> DataFrame:
    """Per-URL summary line; absent values count as '', false and 0."""
    return results.select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce(F.when(F.col("emails").isNotNull(), F.size("emails")), F.lit(0)).cast("bigint").alias("email_count"),
        F.coalesce(F.when(F.col("phones").isNotNull(), F.size("phones")), F.lit(0)).cast("bigint").alias("phone_count"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    success = F.coalesce("success", F.lit(False))
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"),
    )
