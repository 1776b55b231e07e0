"""Contacts from a stream of pages.

Extraction and checks have no state, so the batch operators run on a stream as
they are. Only dropping contacts already reported needs state, and that is
bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions import urls
from contactlake.operators.extract import page_contacts
from contactlake.operators.reports import contact_rows
from contactlake.settings import Settings


def contacts_stream(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Flat contacts ``(…, site, kind, value)`` of each page as it arrives."""
    contacts = page_contacts(pages, settings)
    keys = [c for c in contacts.columns if c not in ("emails", "phones", "links")]
    return contact_rows(contacts, keys).withColumn("site", urls.get_domain(F.col("url")))


def new_contacts_stream(
    pages: DataFrame, event_time: str, delay: str = "1 hour", settings: Settings = Settings()
) -> DataFrame:
    """Each contact of a site once within the watermark delay."""
    flat = contacts_stream(pages.withWatermark(event_time, delay), settings)
    return flat.dropDuplicatesWithinWatermark(["site", "kind", "value"])
