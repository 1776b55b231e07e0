"""Bytes of fetched pages as text: the charset they are in, and decoding, as columns.

A byte order mark decides first, then the content type, then the first ``<meta>`` that names a
charset within the first 1,024 bytes. Names that are not known do not count. Where nothing
decides, bytes that are valid UTF-8 are read as that, all others as windows-1252.
Bytes that a charset does not have become the replacement character; nothing fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the charsets that are read, and the names that pages use for them
UTF_8, UTF_16LE, UTF_16BE, FALLBACK = "utf-8", "utf-16le", "utf-16be", "windows-1252"
NAMES = {
    "utf-8": ["utf-8", "utf8", "unicode-1-1-utf-8"],
    "utf-16le": ["utf-16", "utf-16le", "unicode"],
    "utf-16be": ["utf-16be"],
    "windows-1252": ["windows-1252", "cp1252", "iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "latin-1", "l1", "ascii", "us-ascii"],
    "windows-1250": ["windows-1250", "cp1250"],
    "windows-1251": ["windows-1251", "cp1251", "win-1251"],
    "windows-1253": ["windows-1253", "cp1253"],
    "windows-1254": ["windows-1254", "cp1254", "iso-8859-9", "latin5"],
    "windows-1257": ["windows-1257", "cp1257"],
    "iso-8859-2": ["iso-8859-2", "latin2", "l2"],
    "iso-8859-5": ["iso-8859-5", "cyrillic"],
    "iso-8859-7": ["iso-8859-7", "greek"],
    "iso-8859-15": ["iso-8859-15", "latin9"],
    "koi8-r": ["koi8-r", "koi8"],
    "koi8-u": ["koi8-u"],
    "ibm866": ["ibm866", "cp866"],
}
HEAD_BYTES = 1024
_REPLACEMENT = "�"
_HIGH = bytes(range(128, 256))


def _known(label: Column) -> Column:
    names = {name: charset for charset, names in NAMES.items() for name in names}
    return F.try_element_at(F.from_json(F.lit(json.dumps(names)), "map<string,string>"), F.lower(label))


def charset_of(body: Column, content_type: Column) -> Column:
    """The charset of a page's bytes; ``content_type`` may be null."""
    mark = F.hex(F.substring(body, 1, 3))
    by_mark = F.when(mark == "EFBBBF", UTF_8).when(mark.startswith("FFFE"), UTF_16LE).when(mark.startswith("FEFF"), UTF_16BE)
    by_header = _known(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i)charset\s*=\s*["']?\s*([^\s;"']+)""", 1))
    head = F.decode(F.substring(body, 1, HEAD_BYTES), "ISO-8859-1")
    named = _known(F.regexp_extract(head, r"""(?is)<meta(?=[\s/])[^>]*?[\s;"']charset\s*=\s*["']?\s*([^\s"'/>;]+)""", 1))
    # a page whose markup could be read as ASCII is not in UTF-16, whatever it says
    by_meta = F.when(named.startswith("utf-16"), UTF_8).otherwise(named)
    guess = F.when(F.is_valid_utf8(body.cast("string")), UTF_8).otherwise(FALLBACK)
    return F.coalesce(by_mark, by_header, by_meta, guess)


def _single_byte(latin: Column, charset: str) -> Column:
    """Text of a charset with a byte a character, from the same bytes read as ISO-8859-1."""
    codec = {"ibm866": "cp866"}.get(charset, charset)
    own = "".join(bytes([b]).decode(codec, "replace") for b in _HIGH)
    return F.translate(latin, _HIGH.decode("iso-8859-1"), own)


def _utf_16(body: Column, little: bool) -> Column:
    """UTF-16 with lone surrogates replaced; an odd last byte is dropped."""
    latin = F.decode(F.substring(body, F.lit(1), F.floor(F.octet_length(body) / 2).cast("int") * 2), "ISO-8859-1")
    unit = lambda high: f".{high}" if little else f"{high}."
    whole = rf"(?:{unit('[^\xd8-\xdf]')}|{unit('[\xd8-\xdb]')}{unit('[\xdc-\xdf]')})"
    mended = F.regexp_replace(latin, rf"(?s)\G({whole}*+){unit('[\xd8-\xdf]')}", "$1\xfd\xff" if little else "$1\xff\xfd")
    return F.decode(F.encode(mended, "ISO-8859-1"), "UTF-16LE" if little else "UTF-16BE")


def decoded(body: Column, charset: Column) -> Column:
    """Text of ``body`` in ``charset`` (one of ``NAMES``), without a byte order mark."""
    latin = F.decode(body, "ISO-8859-1")
    text = F.when(charset == UTF_8, F.make_valid_utf8(body.cast("string")))
    text = text.when(charset == UTF_16LE, _utf_16(body, True)).when(charset == UTF_16BE, _utf_16(body, False))
    for name in NAMES:
        if name not in (UTF_8, UTF_16LE, UTF_16BE):
            text = text.when(charset == name, _single_byte(latin, name))
    return F.regexp_replace(text, "^﻿", "")
