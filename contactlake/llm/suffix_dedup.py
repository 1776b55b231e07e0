"""Repeated byte strings, removed by suffix sorting with bucket-pointer refinement.

The suffixes of a shard's text are sorted as far as the length of a window. Positions start in
buckets by their first bytes; a bucket is refined by the bucket identifiers found at a
later offset, which doubles what the order rests on each time. What a round finds is what
the next one looks up. Positions alone in their bucket are never sorted again. Positions
that end up in one bucket begin with the same window, and all but the first are repeats.

``repeats`` says how equal windows come to one shard without the corpus being sorted as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from contactlake.llm import repeats

WINDOW_BYTES = 100
FIRST_BYTES = 8
UNIT = repeats.Unit("bytes", repeats.byte_units, repeats.byte_border, WINDOW_BYTES, 32, 60_000, 65_536)


def judge(runs: repeats.Runs, window: int = WINDOW_BYTES):
    """For each window: its first unit, whether it is a repeat, and whether the source lacks it."""
    # Eight bytes make one number: the first buckets.
    packed = np.zeros(len(runs.values), np.uint64)
    for i in range(FIRST_BYTES):
        packed[: len(packed) - i] |= (runs.values[i:] - np.uint64(1)) << np.uint64(8 * i)
    starts, first = repeats.window_groups(runs.values, runs.ends, window, packed, FIRST_BYTES)
    return starts, first < starts, ~runs.is_source[np.searchsorted(runs.ends, first, "right")]


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), a row for each row with an id.

    Removes every byte under a string of 100 bytes that starts earlier in the corpus (smaller
    doc_id, or earlier in the document). Null text is empty. Rows without doc_id are left out;
    rows that repeat a doc_id are taken to repeat its text too. Other columns are not read.
    """
    return repeats.remove_repeats(docs, UNIT, judge, b"").withColumnRenamed("n_units", "n_bytes")

