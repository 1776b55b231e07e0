"""URL functions: splitting, resolving, normalising and comparing, as columns."""

from __future__ import annotations

import json
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import SPACE, bind, named_struct, strip
from contactlake.lookups import TLD_COUNTRY

# RFC 3986, appendix B, with the scheme limited to legal characters
SPLIT_PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
NON_PAGE_LINK = r"^(?:#|mailto:|tel:|javascript:|data:)"
# --- fixed values: schemes whose last path segment has parameters, and that links can be relative to
PARAMETER_SCHEMES = ("", "ftp", "hdl", "http", "https", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "shttp", "sip", "sips", "tel")
RELATIVE_SCHEMES = (
    "", "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp", "prospero", "rtsp", "rtsps", "rtspu",
    "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss",
)
# characters that become one of / ? # @ : when a host name is normalised
DELIMITER_LIKES = "".join(
    chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
)


class UrlParts(NamedTuple):
    scheme: Column
    netloc: Column
    path: Column
    params: Column
    query: Column
    fragment: Column


def _without_controls(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_parts(url: Column) -> Column:
    """``struct(scheme, netloc, path, params, query, fragment)`` of a URL.

    The scheme is lower case, the netloc as written, with port. One match finds
    all parts; a line end, which a URL cannot hold any more, separates them.
    """

    def has_parameters(p: Column) -> Column:
        return F.contains(p[2], F.lit(";")) & F.lower(p[0]).isin(*PARAMETER_SCHEMES)

    found = F.split(F.regexp_replace(_without_controls(url), SPLIT_PATTERN, "$1\n$2\n$3\n$4\n$5"), "\n")
    return bind(
        found,
        lambda p: named_struct(
            scheme=F.lower(p[0]),
            netloc=p[1],
            path=F.when(has_parameters(p), F.regexp_replace(p[2], r";[^/]*$", "")).otherwise(p[2]),
            params=F.when(has_parameters(p), F.regexp_extract(p[2], r";([^/]*)$", 1)).otherwise(""),
            query=p[3],
            fragment=p[4],
        ),
    )


def _fields(parts: Column) -> UrlParts:
    return UrlParts(*[parts.getField(name) for name in UrlParts._fields])


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(_without_controls(url), SPLIT_PATTERN, 2)


def _well_formed(netloc: Column) -> Column:
    """Brackets in a netloc come in pairs, and no character stands for a delimiter;
    otherwise the URL counts as invalid."""
    paired = F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]"))
    plain = F.octet_length(netloc) == F.length(netloc)
    return paired & (plain | ~netloc.rlike(f"[{DELIMITER_LIKES}]"))


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path.

    The text so far stands for the list of segments kept, each with a ``/`` before
    it; ``..`` may also take away the empty first segment, the root.
    """
    folded = F.aggregate(
        F.split(path, "/"),
        F.lit(""),
        lambda done, seg: F.when(seg == "..", F.regexp_replace(done, r"/[^/]*$", ""))
        .when(seg == ".", done)
        .otherwise(F.concat(done, F.lit("/"), seg)),
    )
    closing = F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise("")
    return bind(
        F.substr(F.concat(folded, closing), F.lit(2)),
        lambda p: F.when(p == "", F.lit("/")).otherwise(_rooted(p)),
    )


def _rooted(path: Column) -> Column:
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve_parts(link: UrlParts, base: UrlParts) -> UrlParts:
    """Parts of a link seen from a base URL, by the usual reference resolution rules."""
    absolute = (link.netloc != "") | ((link.scheme != "") & (link.scheme != base.scheme))
    same_page = (link.path == "") & (link.params == "")
    from_root = link.path.startswith("/")
    folder = F.regexp_extract(base.path, r"^.*/", 0)
    beside = F.regexp_replace(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link.path), r"/{2,}", "/"
    )
    joined = F.when(from_root, link.path).otherwise(_rooted(beside))
    resolved = F.when(joined.rlike(r"/\.\.?(?:/|$)"), _fold_dots(joined)).otherwise(joined)
    return UrlParts(
        scheme=F.when(link.scheme != "", link.scheme).when(base.scheme.isin(*RELATIVE_SCHEMES), base.scheme).otherwise(""),
        netloc=F.when(absolute, link.netloc).otherwise(base.netloc),
        path=F.when(absolute, _rooted(link.path))
        .when(same_page, _rooted(base.path))
        .otherwise(resolved),
        params=F.when(absolute | ~same_page, link.params).otherwise(base.params),
        query=F.when(absolute | ~same_page | (link.query != ""), link.query).otherwise(base.query),
        fragment=link.fragment,
    )


def _with_both(link: Column, base_parts: Column, use) -> Column:
    """``use(link, link parts, base parts)`` with the parts bound."""
    both = named_struct(link=link, parts=url_parts(link), base=base_parts)
    return bind(
        both,
        lambda b: use(b.getField("link"), _fields(b.getField("parts")), _fields(b.getField("base"))),
    )


def _parts_struct(parts: UrlParts) -> Column:
    return named_struct(**parts._asdict())


def resolve_url(link: Column, base: Column) -> Column:
    """Absolute form of ``link`` as found on the page ``base``; NULL when either is."""

    def tail(mark: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")

    def text(parts: UrlParts) -> Column:
        return F.concat(
            F.when(parts.scheme != "", F.concat(parts.scheme, F.lit(":"))).otherwise(""),
            F.when(parts.netloc != "", F.concat(F.lit("//"), parts.netloc)).otherwise(""),
            parts.path,
            tail(";", parts.params),
            tail("?", parts.query),
            tail("#", parts.fragment),
        )

    def resolve(link_text: Column, parts: UrlParts, base_parts: UrlParts) -> Column:
        other_scheme = (parts.scheme != "") & (parts.netloc == "") & (parts.scheme != base_parts.scheme)
        return (
            F.when(link_text == "", base)
            .when((base == "") | other_scheme | ~base_parts.scheme.isin(*RELATIVE_SCHEMES), link_text)
            .otherwise(bind(_parts_struct(resolve_parts(parts, base_parts)), lambda r: text(_fields(r))))
        )

    return F.when(base.isNotNull(), _with_both(link, url_parts(base), resolve))


def normalize_url(link: Column, base: Column) -> Column:
    """``scheme://netloc/path`` of a link, or NULL when it does not lead to a page."""
    return normalize_from(link, url_parts(F.coalesce(base, F.lit(""))))


def normalize_from(link: Column, base_parts: Column) -> Column:
    """The same with the parts of the base URL, for many links of one page."""

    def page_url(parts: UrlParts) -> Column:
        usable = (parts.scheme != "") & (parts.netloc != "") & _well_formed(parts.netloc)
        text = F.concat(parts.scheme, F.lit("://"), parts.netloc, parts.path)
        return F.when(usable, F.rtrim(text, F.lit("/")))

    def resolve(link_text: Column, parts: UrlParts, base: UrlParts) -> Column:
        resolved = bind(_parts_struct(resolve_parts(parts, base)), lambda r: page_url(_fields(r)))
        return F.when((link_text != "") & ~link_text.rlike(NON_PAGE_LINK), resolved)

    return _with_both(strip(F.coalesce(link, F.lit(""))), base_parts, resolve)


def _blank(url: Column) -> Column:
    return url.isNull() | url.rlike(f"(?U)^{SPACE}*$")


def netloc_in_domain(netloc: Column, base_domain: Column) -> Column:
    return (netloc == base_domain) | F.endswith(netloc, F.concat(F.lit("."), base_domain))


def is_same_domain(url: Column, base_domain: Column) -> Column:
    """Whether a URL is on a domain or one of its subdomains; local references count."""
    return bind(
        netloc_of(url),
        lambda netloc: F.when(_blank(url) | ~_well_formed(netloc), F.lit(False))
        .when(netloc != "", netloc_in_domain(netloc, base_domain))
        .otherwise(url.rlike(r"^(?:/|\./|\.\./)")),
    )


def validate_url(url: Column) -> Column:
    """Whether a URL has both a scheme and a netloc."""
    return bind(
        url_parts(F.coalesce(url, F.lit(""))),
        lambda p: (p.getField("scheme") != "") & (p.getField("netloc") != "") & _well_formed(p.getField("netloc")),
    )


def get_domain(url: Column) -> Column:
    """Netloc with port, or a bare domain name as given, or NULL."""
    head = F.substring_index(url, ":", 1)
    return bind(
        netloc_of(url),
        lambda netloc: F.when(_blank(url) | ~_well_formed(netloc), F.lit(None).cast("string"))
        .when(netloc != "", netloc)
        .when(F.contains(url, F.lit(".")) & ~F.contains(head, F.lit("/")), url),
    )


def tld_of(url: Column) -> Column:
    """Last label of the netloc, lower case; '' for a netloc without a dot."""
    return F.lower(F.regexp_extract(netloc_of(url), r"\.([^.]*)$", 1))


def home_country(url: Column) -> Column:
    """Calling code of the country a site's top-level domain stands for, or NULL."""
    codes = F.from_json(F.lit(json.dumps(TLD_COUNTRY)), "map<string,string>")
    return F.try_element_at(codes, tld_of(F.coalesce(url, F.lit(""))))


def domain_slug(url: Column) -> Column:
    return F.replace(netloc_of(url), F.lit("."), F.lit("_"))
