from pyspark.sql import functions as F

from contactlake import lookups
from contactlake.functions import phones, urls

UA = [(f"{p}1234567", "https://example.ua", True, None) for p in "50 66 95 99 67 68 96 97 98 63 73 93".split()]
# phone, url, likely (None: not asserted), normalized (None: not asserted, '-': no result)
CASES = [
    ("+7 (999) 123-45-67", "https://example.ru", None, "+79991234567"),
    ("8(999)1234567", "https://example.ru", None, "+79991234567"),
    ("7(999)1234567", "https://example.ru", None, "+79991234567"),
    ("9991234567", None, None, "-"),
    ("88001234567", "https://example.ru", None, "+78001234567"),
    ("89161234567", "https://example.ru", True, None),
    ("9161234567", "https://example.ru", True, None),
    ("+71589871646", "https://example.ru", False, None),
    ("1726730819", "https://example.ru", False, None),
    ("4941234567", "https://example.ru", False, "-"),
    ("4941234567", "https://example.com", False, "+14941234567"),
    ("12345678", "https://example.ru", False, None),
    ("00000000", "https://example.ru", False, None),
    ("123456789", "https://example.ru", None, "-"),
    ("1234567890123456", "https://example.ru", None, "-"),
    ("+375 29 616-77-77", "https://example.by", None, "+375296167777"),
    ("291234567", "https://example.by", True, "+375291234567"),
    ("375291234567", "https://example.by", True, "+375291234567"),
    ("+37599999999", "https://example.by", False, None),
    ("501234567", "https://example.ua", True, "+380501234567"),
    ("111234567", "https://example.ua", False, "+380111234567"),
    ("+77011234567", "https://example.kz", None, "+77011234567"),
    ("5551234567", "https://example.com", True, "+15551234567"),
    ("15551234567", "https://example.com", True, "+15551234567"),
    ("555123456", "https://example.com", False, None),
    ("+375296167777", "https://example.ru", False, "+375296167777"),
    (None, "https://example.ru", False, "-"),
    ("", "https://example.ru", False, "-"),
    *UA,
]


def test_phone_cases(evaluate):
    home = urls.home_country(F.col("url"))
    rows = evaluate(
        "phone string, url string", [c[:2] for c in CASES],
        phone=F.col("phone"), url=F.col("url"),
        likely=phones.is_likely_phone(F.col("phone"), home),
        normalized=phones.normalize_phone(F.col("phone"), home),
    )
    got = {(r[0], r[1]): r[2:] for r in rows}
    for phone, url, likely, normalized in CASES:
        result = got[(phone, url)]
        if likely is not None:
            assert result[0] is likely, (phone, url)
        if normalized is not None:
            assert (result[1] or "-") == normalized, (phone, url)


def test_set_of_candidates(evaluate):
    found = ["+7 (999) 123-45-67", "8(916)1234567", "invalid", "123", "4941234567", "+375296167777", "9161234567"]
    (row,) = evaluate("c array<string>", [(found,)], v=phones.valid_phones(F.col("c"), F.lit("7")))
    assert row[0] == ["+79161234567", "+79991234567"]


def test_normalizing_is_idempotent(evaluate):
    home = urls.home_country(F.col("url"))
    first = evaluate("phone string, url string", [c[:2] for c in CASES], n=phones.normalize_phone(F.col("phone"), home), u=F.col("url"))
    kept = [r for r in first if r[0]]
    again = evaluate("phone string, url string", kept, before=F.col("phone"), after=phones.normalize_phone(F.col("phone"), home))
    assert kept and all(before == after for before, after in again)


def test_cleaning(evaluate):
    raw = [("8-916-123-45-67",), ("abc",), ("+1+2+3",), (None,), ("+7 (999) 123-45-67",), (" +1 x",)]
    assert [r[0] for r in evaluate("p string", raw, c=phones.clean_phone(F.col("p")))] == [
        "89161234567", "", "+123", "", "+79991234567", "+1"
    ]


def test_digit_shapes(evaluate):
    sequential = "123456 234567 345678 456789 567890 098765 987654 876543 765432 654321".split()
    plain = "12345 123459 111111 123".split()
    perfect = "12121212 34343434 123321 1234554321 123454321 111111 121212129".split()
    rough = "9161234567 1234567890 1212121".split()
    rows = evaluate(
        "d string", [(d,) for d in sequential + plain + perfect + rough],
        d=F.col("d"), s=phones.is_sequential(F.col("d")), p=phones.is_too_perfect(F.col("d")),
    )
    got = {r[0]: r[1:] for r in rows}
    assert all(got[d][0] for d in sequential) and not any(got[d][0] for d in plain)
    assert all(got[d][1] for d in perfect)
    assert not any(got[d][1] for d in ("9161234567", "1234567890"))
    assert got["1212121"][1] is True  # a palindrome


def test_reasons_come_in_rule_order(evaluate):
    cases = {
        "123": "length", "1111111": "not_phone_pattern", "4941234567": "suspicious_start",
        "7777788": "few_unique_digits", "+20000000017": "many_zeros", "+9991234568": "country_code",
        "+71589871646": "ru_area", "+4412345671": "country_length", "+375296167777": "ru_domain",
        "8916123": "local_length", "6161234568": "local_format", "text": "no_digits",
    }
    rows = evaluate("p string", [(p,) for p in cases], p=F.col("p"), r=phones.phone_reject_reason(F.col("p"), F.lit("7")))
    assert dict(rows) == cases
    (row,) = evaluate("p string", [("9161234568",)], r=phones.phone_reject_reason(F.col("p"), F.lit(None).cast("string")))
    assert row[0] == "no_home_country"


def test_country_codes():
    codes = lookups.country_codes()
    assert len(codes) == len(set(codes)) == 208
    assert [sum(len(c) == n for c in codes) for n in (1, 2, 3)] == [2, 44, 162]
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]


def test_result_level_check(evaluate):
    rows = evaluate("p string", [("123",), ("abc",), ("",), ("123456",), ("+79991234567",)], ok=phones.site_phone_ok(F.col("p")))
    assert [r[0] for r in rows] == [False, False, False, True, True]
