"""The registered queries: every operator over the given tables.

Each takes ``(spark, sf_dir)`` and returns flat columns; arrays are joined to text
so that results compare the same in every engine.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.functions import emails, html, phones, text, urls
from contactlake.operators import dedup, extract, graph, lookup_joins, reports, sites
from contactlake.operators.run_tables import RunTables
from contactlake.plans import derived
from contactlake.settings import Settings
from contactlake.sources import pages as page_source
from contactlake.sources import sinks
from contactlake.streaming.contacts import contacts_stream, new_contacts_stream
from contactlake.streaming.walk import ArrivingWalk

SIMPLE = Settings(validate_emails=False, validate_phones=False)
WHOLE_SITE = Settings(max_pages=None)
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs ------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def dealt(keys: DataFrame, key: str) -> DataFrame:
    """Keys spread over all shuffle partitions: the long rows are made from them behind this shuffle.

    Each row crosses it in an array and is unfolded behind it. What later steps filter by then stays there:
    the optimizer would move a filter on a URL or the HTML in front of the shuffle, into the few tasks that read the keys.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.select(key, F.array(F.struct(*keys.columns)).alias("row")).repartition(n, key)
    return rows.select(F.inline("row"))


def web_pages(spark, sf) -> DataFrame:
    return page_source.read_pages(spark, os.path.join(sf, "pages.parquet"))


def all_pages(spark, sf) -> DataFrame:
    """Given pages and shop pages together."""
    customer = dealt(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return spark.sql(derived.ALL_PAGES, pages=web_pages(spark, sf), customer=customer)


def raw_contacts(spark, sf) -> DataFrame:
    orders = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return spark.sql(derived.RAW_CONTACTS, orders=orders)


def raw_phones(spark, sf) -> DataFrame:
    """``(k, url, phone, home, cleaned, digits)`` of the raw contacts."""
    rows = raw_contacts(spark, sf).select("k", "url", "phone")
    return (
        rows.withColumn("home", urls.home_country(F.col("url")))
        .withColumn("cleaned", phones.clean_phone(F.col("phone")))
        .withColumn("digits", F.translate("cleaned", "+", ""))
        .withColumn("has_plus", F.col("cleaned").startswith("+"))
    )


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def seeds(spark, sf) -> DataFrame:
    """Shop home pages and all given pages, each numbered, with some padded and bad lines."""
    homes = all_pages(spark, sf).select(
        F.col("page_id").alias("seq"),
        F.when(F.col("page_id") % 10 == 4, F.concat(F.lit("  "), "url", F.lit("\t")))
        .when(F.col("page_id") % 100 == 6, F.lit("   "))
        .when(F.col("page_id") % 100 == 8, F.lit("not-a-url"))
        .otherwise(F.col("url"))
        .alias("value"),
    )
    lines = homes.filter(F.col("value").endswith("/c/0") | (F.col("seq") % 2 == 0))
    return page_source.seed_lines(lines).select("seq", "seed_url")


def joined(array) -> Column:
    return F.array_join(array, "|")


def signals(spark, sf, settings=Settings()) -> DataFrame:
    return extract.page_signals(all_pages(spark, sf), settings)


def exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    return text.unfold(df, ["page_id"], F.col(column), name)


def generated_at() -> Column:
    """A fixed time in written results, so that they can be compared."""
    return F.timestamp_seconds(F.lit(1704067200))


def work_folder(spark, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{page_source.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------
@query
def seed_urls(spark, sf):
    return seeds(spark, sf)


@query
def pages_source(spark, sf):
    return web_pages(spark, sf).select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"))


def fetched_pages(spark, sf) -> DataFrame:
    """Pages as bytes in UTF-8, windows-1251, UTF-16 and undeclared Latin text, with the text they hold."""
    page, plain = F.col("page_id"), F.regexp_replace("html", "[^\\x00-\\x7F]", "")
    # letters that windows-1251 and ISO-8859-1 write with the same bytes
    cyrillic, same_bytes = "ПриветмкоРя", "".join(chr(b) for b in "ПриветмкоРя".encode("windows-1251"))
    greeting = F.concat(F.lit("Привет, Ряким "), page.cast("string"))
    russian = F.concat(F.lit('<META http-equiv=content-type content="text/html; charset=Windows-1251">'), greeting, plain)
    latin = F.concat(F.lit("Café Müller "), page.cast("string"), F.regexp_replace("html", "[^\\x00-\\x7F\\xA0-\\xFF]", ""))
    text = F.when(page % 4 == 0, F.col("html")).when(page % 4 == 1, russian).when(page % 4 == 2, F.col("html")).otherwise(latin)
    rows = all_pages(spark, sf).select("page_id", "url", text.alias("text"))
    body = (
        F.when(page % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(page % 4 == 1, F.encode(F.translate("text", cyrillic, same_bytes), "ISO-8859-1"))
        .when(page % 4 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .otherwise(F.encode("text", "ISO-8859-1"))
    )
    kind = F.when(page % 4 == 0, "text/html; charset=koi8-r").when(page % 8 == 3, 'text/html; Charset="latin1"').otherwise("text/html; charset=x-unknown")
    return rows.select("page_id", "url", body.alias("body"), kind.alias("content_type"))


@query
def decoded_pages(spark, sf):
    pages = page_source.decoded_pages(fetched_pages(spark, sf))
    return pages.select("page_id", "url", "charset", F.length("html").cast("bigint").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query
def redirected_links(spark, sf):
    """Links of pages that were fetched through redirects, resolved against where these ended."""
    moved = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://moved.example.org/at/"), F.col("page_id").cast("string"), F.lit("/x")))
    pages = all_pages(spark, sf).withColumn("final_url", moved.when(F.col("page_id") % 3 == 1, "  "))
    pages = page_source.at_final_url(pages)
    return graph.link_targets(extract.page_contacts(pages)).distinct()


@query
def admitted_pages(spark, sf):
    rows = all_pages(spark, sf).select(
        "*",
        F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status_code"),
        F.when(F.col("page_id") % 7 == 0, "image/png")
        .when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8")
        .otherwise("application/xhtml+xml")
        .alias("content_type"),
        (F.octet_length("html") * F.when(F.col("page_id") % 13 == 0, 5000).otherwise(1)).cast("bigint").alias("content_length"),
    )
    return page_source.admitted_pages(rows).select("page_id", "url", "content_type", "content_length")


@query
def dedup_pages(spark, sf):
    # listed again: under higher ids, as equal rows, with the same id under another URL, without URL
    given = all_pages(spark, sf).select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"))
    page = F.col("page_id")
    pages = (
        given.unionByName(given.filter(page % 5 == 0).withColumn("page_id", page + 10**12))
        .unionByName(given.filter(page % 3 == 0).withColumns({"page_id": page + 2 * 10**12, "url": F.lit("https://hot.example.org/")}))
        .unionByName(given.filter(page % 4 == 0))
        .unionByName(given.filter(page % 10 == 1).withColumn("url", F.concat("url", F.lit("#again"))))
        .unionByName(given.filter(page % 7 == 0).withColumns({"page_id": page + 3 * 10**12, "url": F.lit(None).cast("string")}))
    )
    return dedup.dedup_pages(pages)


def page_results(spark, sf) -> DataFrame:
    """Page contacts in the shape of batch results; every ninth failed, some without url."""
    rows = extract.page_contacts(all_pages(spark, sf))
    failed = F.col("page_id") % 9 == 0
    return rows.select(
        "page_id",
        F.when(F.col("page_id") % 21 == 1, F.lit("no-domain")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 25 != 2, ~failed).alias("success"),
        F.when(~failed, F.col("emails")).alias("emails"),
        F.when(~failed, F.col("phones")).alias("phones"),
    )


@query
def result_json(spark, sf):
    rows = sinks.with_metadata(page_results(spark, sf), generated_at())
    return sinks.result_json(rows, "url", "success", "emails", "phones", "_metadata").select("page_id", "json")


@query
def written_json(spark, sf):
    """Results as they are in the files."""
    folder = work_folder(spark, "json")
    rows = page_results(spark, sf).select("url", "success", "emails", "phones")
    sinks.write_json(rows, folder, generated_at=generated_at())
    return spark.read.text(folder).select(F.col("value").alias("json"))


@query
def written_partitions(spark, sf):
    """Results read back from the partitioned table."""
    folder = work_folder(spark, "table")
    sinks.write_partitions(page_results(spark, sf), folder, generated_at=generated_at())
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return spark.read.parquet(folder).select(
        "page_id", "url", "status", "domain_slug", size("emails").alias("n_emails"), size("phones").alias("n_phones"), "_metadata.parser_version"
    )


@query
def written_summary(spark, sf):
    """The batch summary as the pass that writes the files counts it."""
    rows = page_results(spark, sf).select("url", "success", "emails", "phones")
    summary = sinks.write_json(rows, work_folder(spark, "counted"), generated_at=generated_at())
    return spark.createDataFrame([summary], "total bigint, successful bigint, failed bigint, emails bigint, phones bigint")


@query
def written_runs(spark, sf):
    """Two runs, of which one was written twice and the other lost its driver before it was complete."""
    folder = work_folder(spark, "runs")
    rows = page_results(spark, sf)
    even, odd = rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1")
    sinks.write_run(even, folder, "even", generated_at())
    lost = sinks.partition_columns(sinks.with_metadata(odd.filter("page_id % 3 = 0"), generated_at()))
    lost = lost.withColumns({"run": F.lit("odd"), "attempt": F.lit("lost"), "bucket": F.lit(0)})
    lost.write.mode("append").partitionBy("run", "attempt", "status", "bucket").parquet(f"{folder}/rows")
    sinks.write_run(even, folder, "even", generated_at())
    sinks.write_run(odd, folder, "odd", generated_at())
    return sinks.read_runs(spark, folder).select("page_id", "url", "run", "status", "domain_slug")


@query
def result_partitions(spark, sf):
    return sinks.partition_columns(page_results(spark, sf)).select("page_id", "url", "status", "domain_slug")


@query
def batch_summary(spark, sf):
    return reports.batch_summary(page_results(spark, sf))


@query
def batch_summary_rows(spark, sf):
    return reports.batch_rows(page_results(spark, sf))


# --- URL functions -----------------------------------------------------------
@query
def url_parts(spark, sf):
    links = raw_contacts(spark, sf).select("k", F.coalesce("link", "url", F.lit("")).alias("link"))
    return links.select("k", "link", urls.url_parts(F.col("link")).alias("p")).select("k", "link", "p.*")


@query
def resolve_url(spark, sf):
    rows = raw_contacts(spark, sf)
    return rows.select("k", "link", "url", urls.resolve_url(F.trim("link"), F.col("url")).alias("resolved"))


@query
def normalize_url(spark, sf):
    return raw_contacts(spark, sf).select(
        "k", "link", "url", urls.normalize_url(F.col("link"), F.col("url")).alias("normalized")
    )


@query
def is_same_domain(spark, sf):
    return raw_contacts(spark, sf).select(
        "k", "link", urls.is_same_domain(F.col("link"), F.regexp_replace(urls.netloc_of(F.col("url")), r":.*", "")).alias("same_domain")
    )


@query
def validate_url(spark, sf):
    return raw_contacts(spark, sf).select("k", "link", urls.validate_url(F.col("link")).alias("valid"))


@query
def get_domain(spark, sf):
    return raw_contacts(spark, sf).select(
        "k",
        urls.get_domain(F.col("link")).alias("link_domain"),
        urls.get_domain(F.col("url")).alias("url_domain"),
    )


@query
def home_country(spark, sf):
    return raw_contacts(spark, sf).select("k", "url", urls.home_country(F.col("url")).alias("home_code"))


# --- HTML --------------------------------------------------------------------
@query
def parse_gate(spark, sf):
    pages = all_pages(spark, sf).withColumn(
        "html",
        F.when(F.col("page_id") % 6 == 0, F.lit(None)).when(F.col("page_id") % 15 == 0, F.lit(" \n ")).otherwise(F.col("html")),
    )
    contacts = extract.contacts_of(extract.page_signals(pages))
    return contacts.select("page_id", (F.size("emails") + F.size("phones") + F.size("links")).cast("bigint").alias("n_found"))


@query
def html_tokens(spark, sf):
    tokens = extract.tokenized(all_pages(spark, sf))
    return tokens.select("page_id", F.posexplode("tokens").alias("pos", "token")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "token"
    )


@query
def html_text(spark, sf):
    return all_pages(spark, sf).select("page_id", html.html_text(F.col("html")).alias("text"))


def page_tags(spark, sf) -> DataFrame:
    tokens = extract.tokenized(all_pages(spark, sf))
    return tokens.select("page_id", html.markup_tags(F.col("tokens")).alias("tags")).withColumn(
        "hrefs", html.raw_hrefs(F.col("tags"))
    )


@query
def anchor_hrefs(spark, sf):
    return text.unfold(page_tags(spark, sf), ["page_id"], html.anchor_hrefs(F.col("hrefs")), "href")


@query
def mailto_candidates(spark, sf):
    return exploded(signals(spark, sf), "email_mailto", "raw")


@query
def data_email_candidates(spark, sf):
    return exploded(signals(spark, sf), "email_data_email", "raw")


@query
def tel_candidates(spark, sf):
    return exploded(signals(spark, sf), "phone_tel", "raw")


@query
def data_phone_candidates(spark, sf):
    return exploded(signals(spark, sf), "phone_data_phone", "raw")


@query
def meta_phone_candidates(spark, sf):
    return exploded(signals(spark, sf), "phone_meta", "raw")


@query
def page_links(spark, sf):
    return exploded(signals(spark, sf), "links", "link")


@query
def clean_html(spark, sf):
    return all_pages(spark, sf).select("page_id", html.clean_html(F.col("html")).alias("html"))


@query
def match_all(spark, sf):
    # one that no engine takes, one only Java takes, one only Python takes
    patterns = ["[a-z]+ [0-9]{3,}", "invalid[pattern", r"[0-9]+ [a-z]+", r"\p{L}++ [0-9]{4}", r"(?P<n>[0-9]+)"]
    return text.unfold(documents(spark, sf), ["doc_id"], text.match_all(F.col("text"), patterns), "match")


# --- e-mail ------------------------------------------------------------------
@query
def email_text_matches(spark, sf):
    docs = documents(spark, sf).select(
        F.col("doc_id").alias("page_id"), text.collapse_spaces(F.col("text")).alias("text")
    )
    in_docs = text.unfold(docs, ["page_id"], emails.email_text_matches(F.col("text")), "raw")
    in_pages = exploded(signals(spark, sf), "email_text", "raw")
    return in_docs.withColumn("source", F.lit("document")).unionByName(in_pages.withColumn("source", F.lit("page")))


def page_candidates(spark, sf, settings=Settings()) -> DataFrame:
    return extract.candidates(signals(spark, sf, settings), ["page_id", "url"], settings)


@query
def email_candidates(spark, sf):
    return page_candidates(spark, sf).filter("kind = 'email'").select("page_id", "origin", "raw")


def raw_emails(spark, sf) -> DataFrame:
    return raw_contacts(spark, sf).select("k", "email")


@query
def normalize_email(spark, sf):
    return raw_emails(spark, sf).select("k", emails.normalize_email(F.col("email")).alias("normalized"))


@query
def is_valid_email(spark, sf):
    return raw_emails(spark, sf).select(
        "k",
        emails.is_valid_email(F.col("email")).alias("valid"),
        emails.email_reject_reason(F.col("email")).alias("reason"),
    )


@query
def bad_domain_filter(spark, sf):
    rows = raw_emails(spark, sf).select("k", emails.normalize_email(F.col("email")).alias("normalized"))
    rows = rows.filter(F.contains("normalized", F.lit("@")))
    return lookup_joins.without_excluded_domains(rows, "normalized").select("k", "normalized")


@query
def valid_emails(spark, sf):
    return text.unfold(raw_emails(spark, sf), [], emails.valid_emails(F.array("email")), "email").distinct()


@query
def emails_simple_mode(spark, sf):
    contacts = extract.page_contacts(all_pages(spark, sf), SIMPLE)
    return contacts.select("page_id", joined("emails").alias("emails"))


@query
def site_email_filter(spark, sf):
    rows = raw_emails(spark, sf).filter(emails.site_email_ok(F.col("email")))
    return rows.select("k", emails.normalize_email(F.col("email")).alias("email"))


@query
def email_domain_class(spark, sf):
    found = raw_emails(spark, sf).select(emails.normalize_email(F.col("email")).alias("email"))
    found = found.filter(F.contains("email", F.lit("@")))
    return lookup_joins.with_domain_class(found, "email").groupBy("domain_class").agg(F.count("*").alias("n"))


# --- phone -------------------------------------------------------------------
@query
def phone_text_matches(spark, sf):
    docs = documents(spark, sf).select("doc_id", text.collapse_spaces(F.col("text")).alias("text"))
    docs = docs.select("doc_id", phones.number_runs(F.col("text")).alias("runs"))
    return text.unfold(docs, ["doc_id"], text.match_all(F.col("runs"), Settings().phone_patterns), "raw")


@query
def phone_candidates(spark, sf):
    return page_candidates(spark, sf).filter("kind = 'phone'").select("page_id", "origin", "raw")


@query
def clean_phone(spark, sf):
    return raw_phones(spark, sf).select("k", "cleaned")


def phone_rule(name: str, rule) -> None:
    """Register a single phone rule: ``rule`` maps a row of raw phones to a column."""

    def run(spark, sf):
        rows = raw_phones(spark, sf)
        return rows.select("k", "digits", rule(rows).alias(name))

    run.__name__ = name
    query(run)


phone_rule("phone_length_gate", lambda p: phones.length_ok(F.length("digits")))
phone_rule("not_phone_patterns", lambda p: phones.is_not_phone(p.digits))
phone_rule("suspicious_start", lambda p: phones.is_suspicious(p.digits, p.has_plus))
phone_rule("unique_digits", lambda p: phones.unique_digits(p.digits).cast("bigint"))
phone_rule("zero_ratio", lambda p: phones.too_many_zeros(p.digits))
phone_rule("country_code", lambda p: phones.country_code(p.digits))
phone_rule("ru_area_rule", lambda p: phones.bad_ru_area(phones.country_code(p.digits), p.digits))
phone_rule("country_length", lambda p: phones.country_length_ok(phones.country_code(p.digits), F.length("digits")))
phone_rule(
    "ru_domain_rule",
    lambda p: F.coalesce(p.home == "7", F.lit(False)) & p.has_plus & ~p.digits.startswith("7"),
)
phone_rule("local_format", lambda p: phones.local_format_ok(p.digits, p.home))
phone_rule("is_sequential", lambda p: phones.is_sequential(p.digits))
phone_rule("is_too_perfect", lambda p: phones.is_too_perfect(p.digits))
phone_rule("id_like_flag", lambda p: phones.is_id_like(p.digits))


def checked_phones(spark, sf) -> DataFrame:
    rows = raw_contacts(spark, sf)
    checked = phones.checked_phone(F.col("phone"), urls.home_country(F.col("url")))
    return rows.select("k", "url", checked.alias("c")).select("k", "url", "c.*")


@query
def is_likely_phone(spark, sf):
    return checked_phones(spark, sf).select("k", F.col("reason").isNull().alias("likely"))


@query
def phone_reject_reason(spark, sf):
    return checked_phones(spark, sf).select("k", "reason")


@query
def normalize_phone(spark, sf):
    return checked_phones(spark, sf).select("k", "normalized")


@query
def valid_phones(spark, sf):
    rows = raw_contacts(spark, sf)
    values = phones.valid_phones(F.array("phone"), urls.home_country(F.col("url")))
    return text.unfold(rows, ["url"], values, "value").distinct()


@query
def phones_simple_mode(spark, sf):
    contacts = extract.page_contacts(all_pages(spark, sf), SIMPLE)
    return contacts.select("page_id", joined("phones").alias("phones"))


@query
def site_phone_filter(spark, sf):
    rows = raw_contacts(spark, sf).filter(phones.site_phone_ok(F.col("phone")))
    return rows.select("k", text.strip(F.col("phone")).alias("phone"))


# --- aggregation, joins, order -----------------------------------------------
@query
def page_contacts(spark, sf):
    return extract.page_contacts(all_pages(spark, sf)).select(
        "page_id", "url", joined("emails").alias("emails"), joined("phones").alias("phones"), joined("links").alias("links")
    )


@query
def document_contacts(spark, sf):
    return extract.document_contacts(documents(spark, sf)).select(
        "doc_id", joined("emails").alias("emails"), joined("phones").alias("phones")
    )


@query
def contact_counts(spark, sf):
    return reports.page_counts(extract.page_contacts(all_pages(spark, sf)), ["page_id", "url"])


def site_contact_rows(spark, sf) -> DataFrame:
    contacts = extract.page_contacts(all_pages(spark, sf)).withColumn("site", urls.netloc_of(F.col("url")))
    return reports.contact_rows(contacts, ["site", "page_id"])


@query
def site_contact_counts(spark, sf):
    return reports.site_counts(dedup.contact_dedup(site_contact_rows(spark, sf)))


@query
def contact_dedup(spark, sf):
    return dedup.contact_dedup(site_contact_rows(spark, sf))


@query
def validation_funnel(spark, sf):
    return reports.validation_funnel(extract.checked_candidates(page_candidates(spark, sf)))


@query
def written_funnel(spark, sf):
    """The funnel as the pass that writes the checked candidates counts it."""
    checked = extract.checked_candidates(page_candidates(spark, sf))
    found = sinks.write_candidates(checked, work_folder(spark, "candidates"))
    return spark.createDataFrame([(*key, n) for key, n in found.items()], "kind string, outcome string, n bigint")


def own_codes(spark, sf) -> DataFrame:
    """Codes that are prefixes of each other, of one to five digits, taken from the numbers themselves."""
    digits = raw_phones(spark, sf).filter("digits <> ''").select("k", "digits")
    return digits.filter("k % 7 = 0").select(F.substring("digits", F.lit(1), (F.col("k") % 5 + 1).cast("int")).alias("code"))


@query
def longest_prefix(spark, sf):
    rows = raw_phones(spark, sf).select("k", "digits")
    return lookup_joins.with_longest_prefix(rows, "digits", own_codes(spark, sf))


def lookup_joins_query(spark, sf):
    rows = raw_phones(spark, sf).select("k", "url", "digits")
    rows = lookup_joins.with_home_code(rows)
    rows = lookup_joins.with_country_code(rows, "digits")
    return lookup_joins.with_country_lengths(rows).select("k", "home_code", "code", joined(F.col("lengths").cast("array<string>")).alias("lengths"))


QUERIES["lookup_joins"] = lookup_joins_query


@query
def sorted_contacts(spark, sf):
    return dedup.contact_dedup(site_contact_rows(spark, sf)).orderBy("site", "kind", "value")


@query
def set_operations(spark, sf):
    """Candidates found in text that no attribute also gives, per page."""
    return extract.only_in_text(signals(spark, sf), ["page_id"])


# --- link graph --------------------------------------------------------------
@query
def link_edges(spark, sf):
    contacts = extract.page_contacts(all_pages(spark, sf)).select(
        graph.page_key(F.col("url")).alias("url"), "links"
    )
    edges = graph.link_targets(contacts)
    return graph.same_domain_edges(edges, seeds(spark, sf).select("seed_url").distinct())


@query
def same_domain_links(spark, sf):
    """Links of each page that stay on the page's own domain."""
    targets = graph.link_targets(extract.page_contacts(all_pages(spark, sf)))
    domain = urls.get_domain(F.col("src_url"))
    return targets.filter(urls.is_same_domain(F.col("dst_url"), domain)).distinct()


@query
def unvisited_links(spark, sf):
    """Link targets that are no page of the table."""
    contacts = extract.page_contacts(all_pages(spark, sf))
    targets = graph.link_targets(contacts).select(F.lit("all").alias("seed_url"), F.col("dst_url").alias("url")).distinct()
    visited = all_pages(spark, sf).select(F.lit("all").alias("seed_url"), graph.page_key(F.col("url")).alias("url"))
    return graph.unvisited_links(targets, visited.distinct()).select("url")


@query
def frontier_fetch(spark, sf):
    contacts = extract.page_contacts(all_pages(spark, sf))
    frontier = graph.link_targets(contacts).select(F.col("dst_url").alias("url")).distinct()
    keys = all_pages(spark, sf).select(graph.page_key(F.col("url")).alias("url")).distinct()
    return graph.frontier_pages(frontier, keys)


def walk(spark, sf, settings) -> sites.SiteWalk:
    return sites.walk_sites(all_pages(spark, sf), seeds(spark, sf), settings)


@query
def reachable_pages(spark, sf):
    return walk(spark, sf, WHOLE_SITE).visited.withColumn("depth", F.col("depth").cast("bigint"))


@query
def page_budget(spark, sf):
    return walk(spark, sf, Settings()).visited.withColumn("depth", F.col("depth").cast("bigint"))


@query
def crawl_progress(spark, sf):
    done = walk(spark, sf, Settings())
    return graph.crawl_progress(done.visited, done.contacts, Settings().max_pages)


@query
def site_contacts(spark, sf):
    found = sites.site_contacts(all_pages(spark, sf), seeds(spark, sf))
    return found.select("seed_url", "status", "limit_reached", joined("emails").alias("emails"), joined("phones").alias("phones"))


@query
def batch_contacts(spark, sf):
    found = sites.batch_contacts(all_pages(spark, sf), seeds(spark, sf))
    return found.select("seq", "url", "success", "status", joined("emails").alias("emails"), joined("phones").alias("phones"))


@query
def site_contact_parts(spark, sf):
    """Whole sites, in rows of at most 50 values."""
    parts = sites.site_contact_parts(walk(spark, sf, WHOLE_SITE), 50)
    return parts.select("seed_url", "kind", "part", F.size("values").cast("bigint").alias("n_values"), joined("values").alias("values"))


@query
def batch_status(spark, sf):
    """Whole sites, a row for every input line."""
    return sites.batch_status(walk(spark, sf, WHOLE_SITE), seeds(spark, sf), WHOLE_SITE).withColumnRenamed("seed_url", "url")


# --- stream ------------------------------------------------------------------
def streamed(spark, stream, name: str) -> DataFrame:
    """What one run over all that is there writes."""
    folder = work_folder(spark, name)
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def page_stream(spark, sf) -> DataFrame:
    """The page table as a stream, whether it is one file or a folder of them.

    The path is a pattern of one name: as a plain path, a stream would only take a folder.
    """
    schema = spark.read.parquet(os.path.join(sf, "pages.parquet")).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf, "[p]ages.parquet"))


@query
def contacts_from_stream(spark, sf):
    """The page table read as a stream."""
    return streamed(spark, contacts_stream(page_stream(spark, sf)), "stream").select("page_id", "url", "site", "kind", "value")


@query
def new_contacts_from_stream(spark, sf):
    """Each contact of a site once, from a stream of pages with event time."""
    folder = work_folder(spark, "timed")
    timed = all_pages(spark, sf).withColumn("seen_at", F.timestamp_seconds(F.col("page_id")))
    timed.write.parquet(folder)
    stream = spark.readStream.schema(timed.schema).parquet(folder)
    return streamed(spark, new_contacts_stream(stream, "seen_at", "7 days"), "new").select("site", "kind", "value")


@query
def walk_from_stream(spark, sf):
    """Whole sites, walked while their pages arrive in several batches."""
    folder = work_folder(spark, "arriving")
    pages = all_pages(spark, sf).select("page_id", "url", "html")
    pages.write.parquet(folder)  # in one pass, by the tasks that make them
    half = len(spark.read.schema(pages.schema).parquet(folder).inputFiles()) // 2 + 1
    arriving = ArrivingWalk(seeds(spark, sf), RunTables(spark))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", half).parquet(folder)
    run = stream.writeStream.foreachBatch(arriving.add).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return arriving.visited()


@query
def page_status(spark, sf):
    """Pages of all kinds: with an error code, without HTML, with and without contacts."""
    pages = all_pages(spark, sf)
    pages = pages.withColumn("status_code", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200))
    pages = pages.withColumn("html", F.when((F.col("page_id") % 6 != 0) | (F.col("page_id") % 11 == 0), F.col("html")))
    return extract.page_results(pages).select("page_id", "url", "status")
