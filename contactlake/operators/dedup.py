"""Duplicates: pages with the same URL, contacts seen more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_pages(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per exact URL: the one with the smallest id.

    For rows without HTML: keep what is needed of a page, or extract it, before. Without the
    column ``key``, and among equal ids, a hash of the row decides; of equal rows one stays. Rows
    without URL are no duplicates of each other and all stay. It is one grouping, which
    combines before its shuffle, so a URL that many rows have does not skew it.
    """
    columns = rows.columns
    order = [key] if key in columns else []
    first = F.min_by(F.struct(*columns), F.struct(*order, F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)))
    kept = rows.filter("url is not null").groupBy("url").agg(first.alias("first")).select("first.*")
    return kept.unionByName(rows.filter("url is null"))


def contact_dedup(contacts: DataFrame, site: str = "site") -> DataFrame:
    """Each contact of a site once, with the number of pages it is on.

    Takes flat rows ``(site, kind, value)``, distinct per page as ``contact_rows``
    gives them, so one grouping is enough. It combines before its shuffle and its
    key includes the value, so a site with a large share of the rows is spread out.
    """
    return contacts.groupBy(site, "kind", "value").agg(F.count("*").alias("pages"))
