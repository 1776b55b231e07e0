"""E-mail functions: finding, normalising and checking addresses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import bind, named_struct, strip, unicode_pattern
from contactlake.lookups import EMAIL_PATTERN, EXCLUDED_EMAIL_DOMAINS

# A maximal run of characters around an "@". It may hold more than an address can,
# but ends only at characters that are neither part of an address nor of a word,
# so every match of the default pattern, with its word boundaries, lies inside one.
_OUTSIDE = r"""\x00-\x20!"#$&'()*,/:;<=>?\[\\\]^`{}~"""
_ADDRESS_RUN = rf"(?<![^{_OUTSIDE}])[^@{_OUTSIDE}]*+@[^{_OUTSIDE}]++"


def address_runs(text: Column, pattern: str = EMAIL_PATTERN) -> Column:
    """The part of a text the pattern has to see.

    For the default pattern these are the runs around each "@": the matches are
    the same as on the whole text, and text without "@" is not matched at all.
    """
    if pattern != EMAIL_PATTERN:
        return text
    runs = F.array_join(F.regexp_extract_all(text, F.lit(_ADDRESS_RUN), F.lit(0)), " ")
    return F.when(F.contains(text, F.lit("@")), runs).otherwise("")


def addresses_in(runs: Column, pattern: str = EMAIL_PATTERN) -> Column:
    return F.array_distinct(F.regexp_extract_all(runs, unicode_pattern(pattern), F.lit(0)))


def email_text_matches(text: Column, pattern: str = EMAIL_PATTERN) -> Column:
    """Distinct addresses in a text."""
    return addresses_in(address_runs(text, pattern), pattern)


def normalize_email(email: Column) -> Column:
    return strip(F.lower(F.coalesce(email, F.lit(""))))


def email_local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def email_domain(email: Column) -> Column:
    return F.regexp_extract(email, r"(?s)^[^@]*@(.*)$", 1)


def email_reject_reason(email: Column) -> Column:
    """First rule a raw address breaks, or NULL for a valid one."""
    return bind(normalize_email(email), first_broken_rule)


def first_broken_rule(email: Column) -> Column:
    """The same for an address that is normalised already."""
    parts = named_struct(
        has_at=F.contains(email, F.lit("@")), local=email_local(email), domain=email_domain(email)
    )
    return bind(parts, lambda p: _rules(p.getField("has_at"), p.getField("local"), p.getField("domain")))


# --- fixed values: shapes of an address ----------------------------------------
LOCAL_SHAPE = r"^[a-zA-Z0-9._%+-]+$"
DOMAIN_SHAPE = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def _rules(has_at: Column, local: Column, domain: Column) -> Column:
    return (
        F.when(~has_at, "no_at")
        .when(F.length(local) > 64, "local_too_long")
        .when(F.length(domain) > 255, "domain_too_long")
        .when(~F.contains(domain, F.lit(".")), "domain_without_dot")
        .when(domain.startswith(".") | domain.endswith("."), "domain_edge_dot")
        .when(domain.isin(*EXCLUDED_EMAIL_DOMAINS), "excluded_domain")
        .when(~local.rlike(LOCAL_SHAPE), "bad_local")
        .when(~domain.rlike(DOMAIN_SHAPE), "bad_domain")
    )


def is_valid_email(email: Column) -> Column:
    return email_reject_reason(email).isNull()


def site_email_ok(email: Column) -> Column:
    """Result-level check: "@" and a dot between the first and the second "@"."""
    between = F.split_part(email, F.lit("@"), F.lit(2))
    return F.contains(email, F.lit("@")) & F.contains(between, F.lit("."))


def valid_emails(candidates: Column) -> Column:
    """Sorted distinct valid addresses of a candidate array."""
    normalized = F.array_distinct(F.transform(candidates, normalize_email))
    return F.array_sort(F.filter(normalized, lambda e: first_broken_rule(e).isNull()))


def simple_emails(candidates: Column) -> Column:
    """Sorted distinct candidates with an "@", without further checks."""
    normalized = F.array_distinct(F.transform(candidates, normalize_email))
    return F.array_sort(F.filter(normalized, lambda e: F.contains(e, F.lit("@"))))
