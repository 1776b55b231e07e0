"""Extraction settings, checked once on the driver."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from contactlake import lookups

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """What to look for and how strictly to check it.

    ``max_pages`` is the page budget of a site walk; None walks the whole site. The two ``validate_*``
    switches select strict mode (country and domain rules) or simple mode.
    ``block_separator`` is put where a tag stood; the default keeps the text of
    adjacent elements attached.
    """

    max_pages: int | None = 50
    validate_emails: bool = True
    validate_phones: bool = True
    email_pattern: str = lookups.EMAIL_PATTERN
    phone_patterns: tuple[str, ...] = lookups.PHONE_PATTERNS
    block_separator: str = ""

    def __post_init__(self) -> None:
        if self.max_pages is not None and self.max_pages < 1:
            raise ValueError(f"max_pages must be at least 1, got {self.max_pages}")
        usable_patterns([self.email_pattern], strict=True)
        object.__setattr__(self, "phone_patterns", tuple(usable_patterns(self.phone_patterns)))


def usable_patterns(patterns, strict: bool = False) -> list[str]:
    """Patterns that Spark can run; the others are logged and left out.

    Patterns of one's own need a running session: the engine that will run them is asked.
    """
    kept = []
    for pattern in patterns:
        problem = None if pattern in _GIVEN else _problem(pattern)
        if problem and strict:
            raise ValueError(f"invalid pattern {pattern!r}: {problem}")
        if problem:
            log.error("pattern %r left out: %s", pattern, problem)
            continue
        kept.append(pattern)
    return kept


_GIVEN = frozenset([lookups.EMAIL_PATTERN, *lookups.PHONE_PATTERNS])


@lru_cache(maxsize=256)
def _problem(pattern: str) -> str | None:
    """Why Spark does not take a pattern; asked of one literal."""
    spark = SparkSession.active()
    try:
        spark.range(1).select(F.regexp_like(F.lit(""), F.lit(f"(?iU){pattern}"))).collect()
    except PySparkException as exc:
        return str(exc).split("\n")[0]
    return None
