"""Phone functions: finding, cleaning, checking and normalising numbers, as columns.

The rules work on ``PhoneParts``, which are taken from a number once and bound, so
the same rules serve a flat table and an array of candidates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import SPACE, bind, match_all, named_struct
from contactlake.lookups import (
    COUNTRY_LENGTHS,
    DEFAULT_LENGTHS,
    ID_LIKE_PATTERNS,
    LOCAL_FORMATS,
    NATIONAL_FORMATS,
    NOT_PHONE_SHAPES,
    PHONE_LENGTHS,
    PHONE_PATTERNS,
    SUSPICIOUS_STARTS,
    country_code_pattern,
)

# The default patterns only match digits, "+", "-", brackets and white space, and
# begin with a digit, "+" or "(". Each match lies inside one such run.
_NUMBER_RUN = r"(?U)[+(\d][-+()\d\s]{5,}+"


def number_runs(text: Column, patterns=PHONE_PATTERNS) -> Column:
    """The part of a text the patterns have to see.

    With the default patterns one scan finds the runs that can hold a number;
    the matches in them are the same as in the whole text.
    """
    if tuple(patterns) != PHONE_PATTERNS:
        return text
    return F.array_join(F.regexp_extract_all(text, F.lit(_NUMBER_RUN), F.lit(0)), "|")


def phone_text_matches(text: Column, patterns=PHONE_PATTERNS) -> Column:
    """Distinct matches of all patterns in a text.

    A table job that also needs other columns should keep ``number_runs`` as a
    column and match on that, so the text is scanned once for all patterns.
    """
    return match_all(number_runs(text, patterns), patterns)


def clean_phone(phone: Column) -> Column:
    """Digits only, with a leading "+" kept; '' when there is no digit."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"(?U)\D+", "")
    plus = F.when((digits != "") & phone.rlike(rf"(?U)^{SPACE}*\+"), "+").otherwise("")
    return F.concat(plus, digits)


class PhoneParts(NamedTuple):
    """A cleaned number taken apart, with the country context of its site."""

    cleaned: Column
    digits: Column
    size: Column
    has_plus: Column
    code: Column  # calling code the digits start with, '' when none
    home: Column  # calling code of the site's country, NULL when unknown


def country_code(digits: Column) -> Column:
    return F.regexp_extract(digits, country_code_pattern(), 0)


def _parts_struct(cleaned: Column) -> Column:
    digits = F.translate(cleaned, "+", "")
    return named_struct(
        cleaned=cleaned,
        digits=digits,
        size=F.length(digits),
        has_plus=cleaned.startswith("+"),
        code=country_code(digits),
    )


def _from_struct(parts: Column, home: Column) -> PhoneParts:
    names = ("cleaned", "digits", "size", "has_plus", "code")
    return PhoneParts(*[parts.getField(n) for n in names], home=home)


# --- single rules ------------------------------------------------------------
def length_ok(size: Column) -> Column:
    return size.between(*PHONE_LENGTHS)


def is_not_phone(digits: Column) -> Column:
    """Has one of the shapes that are no phone number, or no digits at all."""
    return (digits == "") | digits.rlike("|".join(NOT_PHONE_SHAPES))


def is_suspicious(digits: Column, has_plus: Column) -> Column:
    """Starts like an article number, on a number without "+" and of 10 digits or more."""
    starts = "|".join(SUSPICIOUS_STARTS)
    return ~has_plus & (F.length(digits) >= 10) & digits.rlike(f"^(?:{starts})")


def unique_digits(digits: Column) -> Column:
    return F.when(digits == "", 0).otherwise(F.size(F.array_distinct(F.split(digits, ""))))


def few_unique_digits(digits: Column) -> Column:
    """At most two different digits."""
    return digits.rlike(r"^(.)\1*(?:(.)(?:\1|\2)*)?$")


def zero_count(digits: Column) -> Column:
    return F.length(digits) - F.length(F.replace(digits, F.lit("0"), F.lit("")))


def too_many_zeros(digits: Column) -> Column:
    """More than 60 % zeros."""
    return zero_count(digits) * 10 > F.length(digits) * 6


def bad_ru_area(code: Column, digits: Column) -> Column:
    return (code == "7") & digits.rlike("^.[012]")


def country_length_ok(code: Column, size: Column) -> Column:
    """Digit count allowed for a calling code; ``has_plus`` makes no difference."""
    allowed = [f"{known}:{n}" for known, lengths in COUNTRY_LENGTHS.items() for n in lengths]
    listed = F.concat_ws(":", code, size).isin(allowed)
    return F.when(code.isin(list(COUNTRY_LENGTHS)), listed).otherwise(size.between(*DEFAULT_LENGTHS))


def _by_home(formats, home: Column, use, other: Column) -> Column:
    """``use(digits in all, starts, cut)`` of the formats of a home code, tried in turn."""
    result = other
    for code in dict.fromkeys(f[0] for f in formats):
        own = other
        for _, n, starts, cut in reversed([f for f in formats if f[0] == code]):
            own = use(own, n, starts, cut)
        result = F.when(home == code, own).otherwise(result)
    return result


def _starts(digits: Column, starts: tuple[str, ...]) -> Column:
    return F.substring(digits, 1, len(starts[0])).isin(*starts) if starts else F.lit(True)


def local_format_ok(digits: Column, home: Column) -> Column:
    """Whether a number without "+" has a format of its home country."""

    def use(other: Column, n: int, starts: tuple[str, ...], cut: int) -> Column:
        return F.when(F.length(digits) == n, _starts(digits, starts)).otherwise(other)

    return _by_home(LOCAL_FORMATS, home, use, F.lit(False))


def national_number(digits: Column, home: Column) -> Column:
    """The number as it is dialled after the country's code; NULL without a known format."""
    nothing = F.lit(None).cast("string")

    def use(other: Column, n: int, starts: tuple[str, ...], cut: int) -> Column:
        return F.when(F.length(digits) == n, F.when(_starts(digits, starts), F.substring(digits, cut + 1, n))).otherwise(other)

    return _by_home(NATIONAL_FORMATS, home, use, nothing)


# --- composed rules ----------------------------------------------------------
def reject_reason_of(p: PhoneParts) -> Column:
    """First rule a number breaks, or NULL when it looks like a phone number."""
    return (
        F.when(p.digits == "", "no_digits")
        .when(~length_ok(p.size), "length")
        .when(is_not_phone(p.digits), "not_phone_pattern")
        .when(is_suspicious(p.digits, p.has_plus), "suspicious_start")
        .when(few_unique_digits(p.digits), "few_unique_digits")
        .when(too_many_zeros(p.digits), "many_zeros")
        .when(p.has_plus & (p.code == ""), "country_code")
        .when(p.has_plus & bad_ru_area(p.code, p.digits), "ru_area")
        .when(p.has_plus & ~country_length_ok(p.code, p.size), "country_length")
        .when(p.has_plus & F.coalesce(p.home == "7", F.lit(False)) & ~p.digits.startswith("7"), "ru_domain")
        .when(p.has_plus, F.lit(None).cast("string"))
        .when(p.home.isNull(), "no_home_country")
        .when(~country_length_ok(p.home, p.size), "local_length")
        .when(~local_format_ok(p.digits, p.home), "local_format")
    )


def normalized_of(p: PhoneParts) -> Column:
    """The number in international form, or NULL when its country rules do not allow it."""
    international = F.when((p.code != "") & country_length_ok(p.code, p.size), p.cleaned)
    local = F.concat(F.lit("+"), p.home, national_number(p.digits, p.home))
    return F.when(length_ok(p.size), F.when(p.has_plus, international).otherwise(local))


def checked_phone(phone: Column, home: Column) -> Column:
    """``struct(normalized, reason, value, value_reason)`` of a raw number.

    ``normalized`` and ``reason`` are the two stand-alone checks. ``value`` follows
    the pipeline, which normalises first and then checks the normalised number;
    ``value_reason`` says why there is no value.
    """

    def check(row: Column) -> Column:
        p = _from_struct(row.getField("parts"), row.getField("home"))
        return bind(
            named_struct(home=row.getField("home"), normalized=normalized_of(p), reason=reject_reason_of(p)),
            check_normalized,
        )

    def check_normalized(row: Column) -> Column:
        normalized = row.getField("normalized")
        reason = F.when(normalized.isNull(), "not_normalized").otherwise(
            bind(
                _parts_struct(F.coalesce(normalized, F.lit(""))),
                lambda p: reject_reason_of(_from_struct(p, row.getField("home"))),
            )
        )
        return bind(
            reason,
            lambda r: named_struct(
                normalized=normalized,
                reason=row.getField("reason"),
                value=F.when(r.isNull(), normalized),
                value_reason=r,
            ),
        )

    return bind(
        named_struct(cleaned=clean_phone(phone), home=home),
        lambda r: bind(
            named_struct(parts=_parts_struct(r.getField("cleaned")), home=r.getField("home")), check
        ),
    )


def phone_reject_reason(phone: Column, home: Column) -> Column:
    return checked_phone(phone, home).getField("reason")


def is_likely_phone(phone: Column, home: Column) -> Column:
    return phone_reject_reason(phone, home).isNull()


def normalize_phone(phone: Column, home: Column) -> Column:
    return checked_phone(phone, home).getField("normalized")


# --- candidate arrays --------------------------------------------------------
def _parts_array(cleaned: Column) -> Column:
    return F.transform(cleaned, _parts_struct)


def valid_phones(candidates: Column, home: Column) -> Column:
    """Sorted distinct valid numbers of a candidate array, in international form."""
    cleaned = F.array_distinct(F.transform(candidates, clean_phone))
    normalized = F.transform(_parts_array(cleaned), lambda p: normalized_of(_from_struct(p, home)))
    kept = F.filter(
        _parts_array(F.array_distinct(F.array_compact(normalized))),
        lambda p: reject_reason_of(_from_struct(p, home)).isNull(),
    )
    return F.array_sort(F.transform(kept, lambda p: p.getField("cleaned")))


def simple_phones(candidates: Column) -> Column:
    """Sorted distinct cleaned candidates of at least 7 digits, without country rules."""
    cleaned = F.array_distinct(F.transform(candidates, clean_phone))
    return F.array_sort(F.filter(cleaned, lambda c: F.length(F.translate(c, "+", "")) >= 7))


# --- helpers outside the pipeline --------------------------------------------
def is_sequential(digits: Column) -> Column:
    """Six digits in a row that count up or down, modulo 10."""
    runs = ["".join(str((start + step * i) % 10) for i in range(6)) for step in (1, -1) for start in range(10)]
    return digits.rlike("|".join(runs))


def is_too_perfect(digits: Column) -> Column:
    """All digits equal, two digits alternating, or a palindrome of 6 digits or more."""
    return digits.rlike(r"^(.)\1*$|^(.)(?!\2)(.)(?:\2\3){3,}\d?$") | (
        (F.length(digits) >= 6) & (digits == F.reverse(digits))
    )


def is_id_like(digits: Column) -> Column:
    return digits.rlike("|".join(ID_LIKE_PATTERNS))


def site_phone_ok(phone: Column) -> Column:
    """Result-level check: 6 to 15 digits."""
    return F.length(F.regexp_replace(phone, r"(?U)\D+", "")).between(6, 15)


