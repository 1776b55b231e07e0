import itertools
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from contactlake.functions import emails, urls

VALID = "test@gmail.com user.name@company.co.uk test+filter@gmail.com user_name@my-work-domain.com test@123.com test@example.technology x@mail6.example.com".split()
INVALID = ["test@com", "@example.com", "test@.com", "test!@domain.com", "test@example.com", "test@test.ru", "test@localhost", "a" * 65 + "@gmail.com", "test@domain!.com", "a@b@c.com", "", None, "a@b.com|foo"]


def test_valid_emails(evaluate):
    rows = evaluate("e string", [(e,) for e in VALID + INVALID], ok=emails.is_valid_email(F.col("e")))
    assert [r[0] for r in rows] == [True] * len(VALID) + [False] * len(INVALID)
    (row,) = evaluate("e string", [("  TEST@GMAIL.COM  ",)], n=emails.normalize_email(F.col("e")))
    assert row[0] == "test@gmail.com"


def test_result_level_check(evaluate):
    rows = evaluate("e string", [("notanemail",), ("bad@",), ("@bad.com",), ("a@b.c",), ("a@b@c.d",)], ok=emails.site_email_ok(F.col("e")))
    assert [r[0] for r in rows] == [False, False, True, True, False]


def reference_normalize(link, base):
    link = link.strip()
    if not link or link.startswith(("#", "mailto:", "tel:", "javascript:", "data:")):
        return None
    try:
        parts = urlparse(urljoin(base, link))
    except ValueError:
        return None
    return f"{parts.scheme}://{parts.netloc}{parts.path}".rstrip("/") if parts.scheme and parts.netloc else None


def test_normalize_matches_the_standard_library(evaluate):
    bases = ["https://a.ru", "https://a.ru/", "http://a.ru/x/y", "https://a.ru/x/y/?q=1#f", "https://A.ru:8080/x;p=1", "http://a.ru//x//y.html", ""]
    links = ["", " /x ", "x", "x/", "./x", "../x", "../../../x", "..", ".", "?q=1", "#a", "//b.com/z", "HTTPS://B.com/Z/", "https://b.com/a/../b/./c/..", "mailto:x@y.z", "tel:1", "javascript:x", "data:x", "a//b", "/a//b//", "x;p=1?q", "http:rel", "ftp://f/x", "/..//x", "/a/./../b", "b c", "://", "not-a-url", "host.com", "/x?y=/z/..", "https://[::1/x", "https://[::1]/x", "x\ty", "é/ü", "..x/..y", "/a/..", "/a/b/."]
    pairs = list(itertools.product(links, bases))
    rows = evaluate("l string, b string", pairs, n=urls.normalize_url(F.col("l"), F.col("b")))
    wrong = [(p, r[0], reference_normalize(*p)) for p, r in zip(pairs, rows) if r[0] != reference_normalize(*p)]
    assert not wrong, wrong[:10]


def test_resolve_matches_the_standard_library(evaluate):
    bases = ["https://a.ru/x/y?z=1", "https://a.ru/x/", "https://a.ru"]
    links = ["", "k", "../k?a=b#c", "?n=2", "#only", "//b.com", "mailto:x@y.z", "/r;p", "https://b.com/p?q#f", "./", "../.."]
    pairs = list(itertools.product(links, bases))
    rows = evaluate("l string, b string", pairs, n=urls.resolve_url(F.col("l"), F.col("b")))
    wrong = [(p, r[0], urljoin(p[1], p[0])) for p, r in zip(pairs, rows) if r[0] != urljoin(p[1], p[0])]
    assert not wrong, wrong[:10]


def test_same_domain(evaluate):
    cases = [("https://example.com", True), ("https://sub.example.com", True), ("/relative", True), ("./x", True), ("https://example.org", False), ("", False), ("   ", False), (None, False), ("not-a-url", False), ("https://example.com:8080/", False), ("https://notexample.com", False)]
    rows = evaluate("u string", [(c[0],) for c in cases], s=urls.is_same_domain(F.col("u"), F.lit("example.com")))
    assert [r[0] for r in rows] == [c[1] for c in cases]


def test_validate_and_domain(evaluate):
    cases = [
        ("https://example.com", True, "example.com"), ("ftp://example.com", True, "example.com"),
        ("https://sub.example.com:8080/path", True, "sub.example.com:8080"), ("example.com", False, "example.com"),
        ("", False, None), ("   ", False, None), ("not-a-url", False, None), ("http://", False, None), ("://", False, None), (None, False, None),
    ]
    rows = evaluate("u string", [(c[0],) for c in cases], v=urls.validate_url(F.col("u")), d=urls.get_domain(F.col("u")))
    assert rows == [c[1:] for c in cases]


def test_home_country(evaluate):
    cases = [("https://example.ru", "7"), ("https://a.b.CO.UK/x", "44"), ("https://a.ru:8080", None), ("http://localhost/x.ru", None), (None, None), ("https://x.zz", None)]
    rows = evaluate("u string", [(c[0],) for c in cases], h=urls.home_country(F.col("u")))
    assert [r[0] for r in rows] == [c[1] for c in cases]


def test_schemes_that_are_not_listed(evaluate):
    cases = [("whatsapp://send/a;b", "https://x.org/"), ("x", "myscheme://h/a/b"), ("a;b", "https://x.org/c"), ("/y", "whatsapp://h/a;b")]
    rows = evaluate("l string, b string", cases, r=urls.resolve_url(F.col("l"), F.col("b")), n=urls.normalize_url(F.col("l"), F.col("b")))
    assert [r[0] for r in rows] == [urljoin(b, link) for link, b in cases]
    assert [r[1] for r in rows] == ["whatsapp://send/a;b", None, "https://x.org/a", None]


def test_hosts_with_characters_that_stand_for_delimiters(evaluate):
    (bad, good) = evaluate("u string", [("https://ex\u2100ample.org/",), ("https://ex\u00e4mple.org/",)], v=urls.validate_url(F.col("u")), d=urls.get_domain(F.col("u")))
    assert bad == (False, None) and good == (True, "ex\u00e4mple.org")
