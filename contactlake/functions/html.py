"""HTML as columns: one tokenising pattern, then array expressions over the tokens.

The pattern only uses possessive and lazy quantifiers that Java runs in a loop,
so long pages neither overflow the stack nor backtrack. A tag is a name and a list of
attributes: a quote only opens a value behind "=", so stray quotes in names and unquoted
values are harmless, and a value whose quote never closes is read as if it had none. An
unclosed comment, script or style element reaches to the end of the page. So does a tag
without ">": it is one token, which is markup and holds no attribute, and nothing
behind it is tried again as the start of a tag.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import bind, collapse_spaces, strip
from contactlake.lookups import named_entities

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
# attribute by attribute: a quote opens a value only behind "="; elsewhere, and where it never
# closes, it is a character like any other
_ATTRIBUTE_LIST = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+"
_NAME_ENDS = r"(?![^\s/>])"
_ENTITY = r"&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);?"


def _element(name: str) -> str:
    """An element from its start tag to its end tag or the end of the page."""
    return rf"<{name}{_NAME_ENDS}{_ATTRIBUTE_LIST}(?:>.*?(?:</{name}\s*>|\z)|\z)"


TOKEN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|{_element('script')}|{_element('style')}"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTE_LIST}(?:>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    rf"|{_ENTITY}"
    r"|[^<&]++|[<&]"
)
_RAW_ELEMENT = rf"(?is)^<(?:script|style){_NAME_ENDS}{_ATTRIBUTE_LIST}>(.*?)(?:</(?:script|style)\s*>)?\z"
_REMOVED_ELEMENTS = "(?is)" + "|".join(_element(name) for name in ("script", "style", "noscript"))
# tags that can carry a contact or a link; a tag that never closes carries nothing
MARKUP_PATTERN = r"(?is)^<(?:(?:a|meta|link)[\s/]|[a-z].*?data-(?:email|phone)).*>\z"


def html_tokens(html: Column) -> Column:
    """Comments, script/style elements, tags, entities and text runs, in page order."""
    return F.regexp_extract_all(html, F.lit(TOKEN_PATTERN), F.lit(0))


def _entity_map() -> Column:
    """The named entities as a map literal, read from one JSON text by the optimizer."""
    return F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")


def _decode_entity(token: Column) -> Column:
    """One entity token as text; unknown names and impossible numbers stay as written."""
    decimal = F.regexp_extract(token, r"^&#0*([0-9]{1,7});?$", 1).try_cast("int")
    hexadecimal = F.conv(
        F.nullif(F.regexp_extract(token, r"^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1), F.lit("")), 16, 10
    ).try_cast("int")
    code = F.coalesce(decimal, hexadecimal)
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    name = F.regexp_extract(token, r"^&([A-Za-z][A-Za-z0-9]*);?$", 1)
    return F.when(token.startswith("&#"), F.when(valid, numeric).otherwise(token)).otherwise(
        F.coalesce(F.try_element_at(_entity_map(), name), token)
    )


def decode_entities(text: Column) -> Column:
    """Text (such as an attribute value) with its entities decoded."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?i){_ENTITY}|[^&]++|&"), F.lit(0))
    decoded = F.transform(
        pieces, lambda p: F.when(p.startswith("&"), _decode_entity(p)).otherwise(p)
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def tokens_text(tokens: Column, block_separator: str = "") -> Column:
    """Text of a page from its tokens.

    Script and style bodies count as text and are not entity-decoded; comments
    and tags give ``block_separator`` (nothing by default).
    """

    def piece(token: Column) -> Column:
        raw_element = token.rlike(rf"(?i)^<(?:script|style){_NAME_ENDS}")
        markup = token.rlike(r"^<[A-Za-z/!?]")
        return (
            F.when(~token.rlike("^[<&]"), token)
            .when(token.startswith("&"), _decode_entity(token))
            .when(raw_element, F.regexp_extract(token, _RAW_ELEMENT, 1))
            .when(markup, F.lit(block_separator))
            .otherwise(token)
        )

    return collapse_spaces(F.array_join(F.transform(tokens, piece), ""))


def html_text(html: Column, block_separator: str = "") -> Column:
    return tokens_text(html_tokens(html), block_separator)


# attributes that are read, in their order in the arrays of ``markup_tags``
_ATTRIBUTES = ("href", "rel", "content", "name", "property", "http-equiv", "data-email", "data-phone")


def _attribute_pattern(name: str) -> str:
    """Reads attribute by attribute from the tag name on, so a name that only occurs
    inside another attribute's value is not taken."""
    other = rf"(?!{name}\s*+=)[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
    return rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++|{other})*+{name}\s*+=\s*+({_VALUE})"


def _attribute_text(raw: Column) -> Column:
    return decode_entities(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, entities decoded; '' when absent."""
    return bind(F.regexp_extract(tag, _attribute_pattern(name), 1), _attribute_text)


def markup_tags(tokens: Column) -> Column:
    """The few tags that can carry a contact or a link, taken apart.

    Each is an array: the tag name, then the values of ``_ATTRIBUTES`` (NULL where
    the tag cannot have them).
    """

    def read(tag: Column) -> Column:
        wanted = {
            "href": tag.rlike(r"(?i)^<(?:a|link)[\s/]"),
            "rel": tag.rlike(r"(?i)^<link[\s/]"),
            "content": tag.rlike(r"(?i)^<meta[\s/]"),
            "data-email": tag.rlike(r"(?i)data-"),
        }
        for name, like in (("name", "content"), ("property", "content"), ("http-equiv", "content"), ("data-phone", "data-email")):
            wanted[name] = wanted[like]
        raw = [F.when(wanted[n], F.regexp_extract(tag, _attribute_pattern(n), 1)) for n in _ATTRIBUTES]
        name = F.lower(F.regexp_extract(tag, r"^<([A-Za-z0-9]+)", 1))
        return F.concat(F.array(name), F.transform(F.array(*raw), _attribute_text))

    return F.transform(
        F.filter(tokens, lambda t: t.startswith("<") & t.rlike(MARKUP_PATTERN)), read
    )


def _value(tag: Column, name: str) -> Column:
    return tag[1 + _ATTRIBUTES.index(name)]


def _values(tags: Column, name: str, keep=None) -> Column:
    """Non-empty values of one attribute, in page order, of the tags that pass ``keep``."""
    chosen = F.filter(tags, lambda t: (_value(t, name) != "") & keep(t)) if keep else tags
    values = F.transform(chosen, lambda t: _value(t, name))
    return values if keep else F.filter(values, lambda v: v != "")


def raw_hrefs(tags: Column) -> Column:
    """Every non-empty ``a/@href`` exactly as written."""
    return _values(tags, "href", lambda t: t[0] == "a")


def anchor_hrefs(hrefs: Column) -> Column:
    """Trimmed, non-empty, distinct targets of anchors."""
    return F.array_distinct(F.filter(F.transform(hrefs, strip), lambda h: h != ""))


def data_emails(tags: Column) -> Column:
    return F.array_distinct(F.filter(_values(tags, "data-email"), lambda v: F.contains(v, F.lit("@"))))


def data_phones(tags: Column) -> Column:
    return F.array_distinct(_values(tags, "data-phone"))


def meta_phones(tags: Column) -> Column:
    def is_telephone(tag: Column) -> Column:
        return (_value(tag, "name") == "telephone") | (_value(tag, "property") == "telephone")

    return F.array_distinct(_values(tags, "content", is_telephone))


def _cut_parameters(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^?&]*", 0)


def mailto_emails(hrefs: Column) -> Column:
    """Addresses of ``mailto:`` anchors, without their parameters."""
    targets = F.filter(hrefs, lambda h: h.startswith("mailto:"))
    cleaned = F.transform(
        targets, lambda h: _cut_parameters(strip(F.replace(h, F.lit("mailto:"), F.lit(""))))
    )
    return F.array_distinct(F.filter(cleaned, lambda e: F.contains(e, F.lit("@"))))


def tel_numbers(hrefs: Column) -> Column:
    """Numbers of ``tel:`` anchors, parameters kept."""
    targets = F.filter(hrefs, lambda h: h.startswith("tel:"))
    cleaned = F.transform(targets, lambda h: strip(F.replace(h, F.lit("tel:"), F.lit(""))))
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def tel_numbers_strict(numbers: Column) -> Column:
    """The same numbers cut at the first parameter."""
    return F.array_distinct(F.filter(F.transform(numbers, _cut_parameters), lambda p: p != ""))


def page_links(tags: Column, hrefs: Column) -> Column:
    """Distinct link targets of anchors, meta refresh and canonical links, as written."""
    anchors = F.filter(
        anchor_hrefs(hrefs), lambda h: ~h.rlike(r"^(?:#|javascript:|mailto:|tel:|data:)")
    )
    refresh = F.transform(
        _values(tags, "content", lambda t: _value(t, "http-equiv") == "refresh"),
        lambda c: F.regexp_extract(c, r"(?iU)url=([^\s\x1c-\x1f]+)", 1),
    )
    canonical = _values(tags, "href", lambda t: _value(t, "rel") == "canonical")
    return F.array_distinct(
        F.concat(anchors, F.filter(refresh, lambda u: u != ""), canonical)
    )


def clean_html(html: Column) -> Column:
    """The page without its script, style and noscript elements."""
    return F.regexp_replace(html, _REMOVED_ELEMENTS, "")
