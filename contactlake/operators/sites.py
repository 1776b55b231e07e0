"""Site-level jobs: walk every seed's site and bring its contacts together.

Walks keep their tables in a run (``RunTables``). Pass one to remove them when the results have
been read: ``with RunTables(spark) as run: ...``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions import urls
from contactlake.operators import graph, reports
from contactlake.operators.dedup import dedup_pages
from contactlake.operators.extract import page_contacts
from contactlake.operators.run_tables import RunTables
from contactlake.settings import Settings
from contactlake.sources.pages import admitted_pages


class SiteWalk(NamedTuple):
    visited: DataFrame  # seed_url, url, depth
    contacts: DataFrame  # page_id, url (page key), emails, phones, links; one row per key
    run: RunTables


def extracted_pages(pages: DataFrame, settings: Settings = Settings(), run: RunTables | None = None) -> DataFrame:
    """Contacts and links of the admitted pages, one row per page key.

    One narrow pass over the HTML. Pages with the same key are dropped afterwards, when a
    row is a few hundred bytes, so the HTML is never shuffled. The rows go to a table of the
    run: links and contacts both come from it, each reads its columns, and a lost executor
    does not cause a second parse.
    """
    run = run or RunTables(pages.sparkSession)
    keys = [c for c in ("page_id", "url") if c in pages.columns]
    contacts = page_contacts(admitted_pages(pages).select(*keys, "html"), settings)
    return run.save(dedup_pages(contacts.withColumn("url", graph.page_key(F.col("url")))), "pages")


def walk_sites(pages: DataFrame, seeds: DataFrame, settings: Settings = Settings(), run: RunTables | None = None) -> SiteWalk:
    """Walk from all seeds (column ``seed_url``) within ``settings.max_pages`` each."""
    run = run or RunTables(pages.sparkSession)
    contacts = extracted_pages(pages, settings, run)
    visited = graph.reachable_pages(seeds, graph.link_targets(contacts), settings.max_pages, run)
    return SiteWalk(visited, contacts, run)


def visited_contacts(walk: SiteWalk) -> DataFrame:
    """Flat contacts ``(seed_url, url, kind, value)`` of the visited pages."""
    flat = reports.contact_rows(walk.contacts, ["url"])
    return walk.visited.select("seed_url", "url").join(flat, "url")


def _bounded(settings: Settings) -> int:
    if settings.max_pages is None:
        raise ValueError("a row per site needs a page budget; whole sites come in parts: site_contact_parts")
    return settings.max_pages


def site_contacts(pages: DataFrame, seeds: DataFrame, settings: Settings = Settings(), run: RunTables | None = None) -> DataFrame:
    """One row per distinct seed: sorted emails and phones of its site, bounded by the page budget.

    ``limit_reached`` says whether the site was left before its end, ``status`` why a row is empty.
    """
    _bounded(settings)
    walk = walk_sites(pages, seeds, settings, run)
    states = site_status(walk, seeds, settings).select("seed_url", "status", "limit_reached")
    return reports.site_results(visited_contacts(walk), states)


def site_status(walk: SiteWalk, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per distinct seed: ``seed_url, status, visited, results, limit_reached``.

    ``status`` is ``not_a_url``, ``no_page`` (no visited URL is in the page table), ``no_contacts``
    or ``ok``; ``results`` counts the visited pages that are in the table.
    """
    some = (F.size("emails") > 0) | (F.size("phones") > 0)
    have = walk.contacts.select("url", some.alias("some"))
    found = walk.visited.select("seed_url", "url").join(have, "url", "left").groupBy("seed_url").agg(
        F.count("*").alias("visited"), F.count("some").alias("results"), F.coalesce(F.max("some"), F.lit(False)).alias("some")
    )
    limit = F.lit(False) if settings.max_pages is None else F.coalesce(F.col("visited") >= settings.max_pages, F.lit(False))
    status = (
        F.when(~urls.validate_url(F.col("seed_url")), "not_a_url")
        .when(F.coalesce("results", F.lit(0)) == 0, "no_page")
        .when(~F.col("some"), "no_contacts")
        .otherwise("ok")
    )
    rows = seeds.select("seed_url").distinct().join(found, "seed_url", "left")
    nothing = F.lit(0).cast("bigint")
    return rows.select(
        "seed_url", status.alias("status"), F.coalesce("visited", nothing).alias("visited"), F.coalesce("results", nothing).alias("results"), limit.alias("limit_reached")
    )


def site_contact_parts(walk: SiteWalk, values_a_part: int = 1000) -> DataFrame:
    """Contacts of whole sites: ``seed_url, kind, part, values``, at most ``values_a_part`` sorted values a row.

    Parts of a site and kind are numbered from 0 in the order of their values, so a site
    with millions of contacts is many rows and no task holds them all.
    """
    return reports.contact_parts(visited_contacts(walk), walk.run, values_a_part)


def batch_contacts(pages: DataFrame, seeds: DataFrame, settings: Settings = Settings(), run: RunTables | None = None) -> DataFrame:
    """One row per input line ``(seq, seed_url)``, in the order of ``seq``, bounded by the page budget.

    Equal lines share one walk. A line that is no URL, or whose site gave no page,
    has empty lists and ``success`` false; ``status`` says which.
    """
    _bounded(settings)
    lines = batch_status(walk := walk_sites(pages, seeds, settings, run), seeds, settings)
    results = reports.site_results(visited_contacts(walk), lines)
    return results.select("seq", F.col("seed_url").alias("url"), "success", "status", "emails", "phones").orderBy("seq")


def batch_status(walk: SiteWalk, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``seq, seed_url, success, status, visited, results, limit_reached`` per input line."""
    states = site_status(walk, seeds, settings)
    lines = seeds.select("seq", "seed_url").join(states, "seed_url", "left")
    return lines.select("seq", "seed_url", (F.col("results") > 0).alias("success"), "status", "visited", "results", "limit_reached")
