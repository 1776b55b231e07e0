"""From page rows to contacts. Every step is narrow: a page's contacts are found,
checked and sorted in the task that reads the page, so no HTML is ever shuffled.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import emails, html, phones, urls
from contactlake.functions.text import bind, collapse_spaces, match_all, named_struct, unfold
from contactlake.settings import Settings
from contactlake.sources.pages import MAX_PAGE_BYTES, admission

EMAIL_ORIGINS = ("text", "mailto", "data_email")
PHONE_ORIGINS = ("text", "tel", "data_phone", "meta")


def tokenized(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by its tokens; a NULL page has none."""
    return pages.withColumn(
        "tokens", html.html_tokens(F.coalesce(F.col("html"), F.lit("")))
    ).drop("html")


def _application(table: DataFrame) -> str:
    """Part of the key of the column caches below: building the columns takes longer
    than planning them, and they can serve every query of one application."""
    return table.sparkSession.conf.get("spark.app.id")


@lru_cache(maxsize=64)
def _parsing_columns(settings: Settings, application: str) -> tuple[list[Column], dict[str, Column]]:
    parsed = [
        html.tokens_text(F.col("tokens"), settings.block_separator).alias("text"),
        html.markup_tags(F.col("tokens")).alias("tags"),
    ]
    return parsed, {"hrefs": html.raw_hrefs(F.col("tags")), "tel_full": html.tel_numbers(F.col("hrefs"))}


@lru_cache(maxsize=64)
def _run_columns(settings: Settings, application: str) -> list[Column]:
    """The stretches of a text that can hold an address or a number. As columns of
    their own they are scanned for once, however many patterns look at them."""
    text = F.col("text")
    return [
        (text != "").alias("has_text"),
        emails.address_runs(text, settings.email_pattern).alias("address_runs"),
        phones.number_runs(text, settings.phone_patterns).alias("number_runs"),
    ]


@lru_cache(maxsize=64)
def _text_columns(settings: Settings, application: str) -> list[Column]:
    return [
        F.col("has_text"),
        emails.addresses_in(F.col("address_runs"), settings.email_pattern).alias("email_text"),
        match_all(F.col("number_runs"), settings.phone_patterns).alias("phone_text"),
    ]


@lru_cache(maxsize=64)
def _markup_columns(settings: Settings, application: str) -> list[Column]:
    tags, hrefs, tel = F.col("tags"), F.col("hrefs"), F.col("tel_full")
    return [
        html.mailto_emails(hrefs).alias("email_mailto"),
        html.data_emails(tags).alias("email_data_email"),
        (html.tel_numbers_strict(tel) if settings.validate_phones else tel).alias("phone_tel"),
        html.data_phones(tags).alias("phone_data_phone"),
        html.meta_phones(tags).alias("phone_meta"),
        html.page_links(tags, hrefs).alias("links"),
    ]


def page_signals(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Raw findings per page and place of origin, each an array column.

    The tokens are made once and used twice: for the text and for the few tags
    that can carry a contact or a link.
    """
    keys = [c for c in pages.columns if c != "html"]
    key = (settings, _application(pages))
    parsed, links = _parsing_columns(*key)
    table = tokenized(pages).select(*keys, *parsed)
    for name, column in links.items():
        table = table.withColumn(name, column)
    runs = table.select(*keys, "tags", "hrefs", "tel_full", *_run_columns(*key))
    return runs.select(*keys, *_text_columns(*key), *_markup_columns(*key))


def text_signals(texts: DataFrame, column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The same findings for plain text without markup or site."""
    keys = [c for c in texts.columns if c != column]
    key = (settings, _application(texts))
    table = texts.select(*keys, collapse_spaces(F.coalesce(F.col(column), F.lit(""))).alias("text"))
    nothing = F.array().cast("array<string>")
    absent = ("email_mailto", "email_data_email", "phone_tel", "phone_data_phone", "phone_meta", "links")
    return (
        table.select(*keys, *_run_columns(*key))
        .select(*keys, *_text_columns(*key))
        .select("*", *[nothing.alias(name) for name in absent])
    )


def _phone_origins(settings: Settings) -> tuple[str, ...]:
    return PHONE_ORIGINS if settings.validate_phones else ("text", "tel")


def contacts_of(signals: DataFrame, settings: Settings = Settings(), url: str | None = "url") -> DataFrame:
    """Checked contacts per page: sorted distinct ``emails``, ``phones`` and ``links``.

    Pages without findings stay, with empty arrays. ``url`` names the column that
    gives the country context; None means there is none.
    """
    found = {c for c in signals.columns if c.startswith(("email_", "phone_"))} | {"links", "has_text"}
    keys = [c for c in signals.columns if c not in found]
    gathered, checked = _contact_columns(settings, url, _application(signals))
    return signals.select(*keys, *gathered).select(*keys, *checked)


@lru_cache(maxsize=64)
def _contact_columns(settings: Settings, url: str | None, application: str) -> tuple[list[Column], list[Column]]:
    home = urls.home_country(F.col(url)) if url else F.lit(None).cast("string")
    gathered = [
        home.alias("_home"),
        F.array_distinct(F.concat(*[f"email_{o}" for o in EMAIL_ORIGINS])).alias("_emails"),
        F.array_distinct(F.concat(*[f"phone_{o}" for o in _phone_origins(settings)])).alias("_phones"),
        F.col("links"),
    ]
    found = F.col("_phones")
    check_emails = emails.valid_emails if settings.validate_emails else emails.simple_emails
    check_phones = phones.valid_phones(found, F.col("_home")) if settings.validate_phones else phones.simple_phones(found)
    checked = [
        _unless_empty("_emails", check_emails(F.col("_emails"))).alias("emails"),
        _unless_empty("_phones", check_phones).alias("phones"),
        F.array_sort("links").alias("links"),
    ]
    return gathered, checked


def _unless_empty(array: str, checked: Column) -> Column:
    """Skip the checks where nothing was found, which is the common case. Naming the
    array twice also keeps the scan that makes it out of the array expressions."""
    return F.when(F.size(array) == 0, F.col(array)).otherwise(checked)


def page_contacts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Contacts and links of every page, in one pass without a shuffle."""
    return contacts_of(page_signals(pages, settings), settings)


def page_results(pages: DataFrame, settings: Settings = Settings(), max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """Contacts of every page with the ``status`` that says why there are none.

    ``rejected`` pages are not parsed (the walk does not visit them either), ``empty`` ones
    have no HTML; ``no_contacts`` and ``ok`` ones were parsed.
    """
    admitted = F.coalesce(admission(pages, max_bytes), F.lit(False))
    state = F.when(~admitted, "rejected").when(F.coalesce(F.trim("html"), F.lit("")) == "", "empty")
    rows = pages.withColumn("status", state).withColumn("html", F.when(admitted, F.col("html")))
    found = F.when(F.size("emails") + F.size("phones") > 0, "ok").otherwise("no_contacts")
    return page_contacts(rows, settings).withColumn("status", F.coalesce("status", found))


def document_contacts(texts: DataFrame, column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Contacts in plain text: no site, so only numbers with a country code count."""
    return contacts_of(text_signals(texts, column, settings), settings, url=None).drop("links")


def candidates(signals: DataFrame, keys: list[str], settings: Settings = Settings()) -> DataFrame:
    """One row per candidate: ``kind``, ``origin`` and the text as found."""

    def tagged(kind: str, origin: str):
        return F.transform(
            F.col(f"{kind}_{origin}"),
            lambda raw: named_struct(kind=F.lit(kind), origin=F.lit(origin), raw=raw),
        )

    groups = [tagged("email", o) for o in EMAIL_ORIGINS]
    groups += [tagged("phone", o) for o in _phone_origins(settings)]
    return unfold(signals, keys, F.concat(*groups), "c").select(*keys, "c.*")


def only_in_text(signals: DataFrame, keys: list[str], settings: Settings = Settings()) -> DataFrame:
    """Candidates (``kind``, ``raw``) in a page's text that none of its attributes also gives.

    The sets of a page are in its row, so they are compared there and nothing moves.
    """

    def rest(kind: str, origins: tuple[str, ...]):
        others = F.concat(*[F.col(f"{kind}_{o}") for o in origins if o != "text"])
        only = F.array_except(F.col(f"{kind}_text"), others)
        return F.transform(only, lambda raw: named_struct(kind=F.lit(kind), raw=raw))

    both = F.concat(rest("email", EMAIL_ORIGINS), rest("phone", _phone_origins(settings)))
    return unfold(signals, keys, both, "c").select(*keys, "c.*")


def checked_candidates(found: DataFrame, settings: Settings = Settings(), url: str | None = "url") -> DataFrame:
    """Add to each candidate its ``value`` (NULL when rejected) and the ``reason``."""
    result = _result_column(settings, url, _application(found))
    return found.withColumn("_result", result).select(*found.columns, "_result.value", "_result.reason")


@lru_cache(maxsize=64)
def _result_column(settings: Settings, url: str | None, application: str) -> Column:
    home = urls.home_country(F.col(url)) if url else F.lit(None).cast("string")
    nothing = F.lit(None).cast("string")

    def phone_result(raw: Column) -> Column:
        if settings.validate_phones:
            checked = phones.checked_phone(raw, home)
            return bind(
                checked,
                lambda c: named_struct(value=c.getField("value"), reason=c.getField("value_reason")),
            )
        return bind(
            phones.clean_phone(raw),
            lambda c: bind(
                F.length(F.translate(c, "+", "")) >= 7,
                lambda ok: named_struct(value=F.when(ok, c), reason=F.when(~ok, "length")),
            ),
        )

    def email_result(raw: Column) -> Column:
        def check(email: Column) -> Column:
            reason = (
                emails.first_broken_rule(email)
                if settings.validate_emails
                else F.when(~F.contains(email, F.lit("@")), "no_at").otherwise(nothing)
            )
            return bind(reason, lambda r: named_struct(value=F.when(r.isNull(), email), reason=r))

        return bind(emails.normalize_email(raw), check)

    return F.when(F.col("kind") == "phone", phone_result(F.col("raw"))).otherwise(email_result(F.col("raw")))
