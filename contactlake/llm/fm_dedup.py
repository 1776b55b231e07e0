"""Repeated word sequences, found with a compressed FM-index for each shard.

A shard's source text is kept as its Burrows-Wheeler transform in a wavelet matrix: one
packed bit vector for each bit of a word number, with a running count every 64 bits. Backward
search takes a pattern from its last word to its first; each step maps an interval of the
suffix order by rank queries, and the search ends where the interval is empty. The length
reached is the matching statistic of the place where the pattern ends. The intervals of all
short patterns are kept in a table, which takes the place of the first steps.

Documents are streamed against the index. Only matches of a window or more count, so the search
asks for stretches of many windows first, then for shorter ones where these fail, and at last
for single windows. What the index does not hold cannot repeat the source; such windows
are compared with each other, by the shard or, for sources that were split, across shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import byte_text, repeats

WINDOW_WORDS = 20
#: Windows that are asked for at once, from long stretches to single windows.
STRETCHES = (20, 5, 1)
#: Units of the patterns whose intervals are kept.
KEPT_UNITS = 16
UNIT = repeats.Unit("words", repeats.word_units, repeats.word_border, WINDOW_WORDS, 5, 25_000, 8192)


class WaveletMatrix:
    """Rank queries on a sequence of small numbers, a packed bit vector a level."""

    def __init__(self, values: np.ndarray, n_values: int):
        self.levels = max(1, int(n_values - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 8 - len(packed) % 8)).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.bits.append(packed)
            self.counts.append(ones)
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def follow(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where ``places`` go when sorted down to ``symbols``."""
        for k in range(self.levels):
            word = places >> 6
            mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            bit = (symbols >> (self.levels - 1 - k)) & 1
            places = np.where(bit == 1, self.zeros[k] + ones, places - ones)
        return places


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; ends of the text are told apart by their place."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:] if step < n else later[:0]
        order = np.lexsort((later, rank))
        new = np.append(False, (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Index of runs of units; no match spans two runs."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, places: np.ndarray):
        self.names = np.unique(values)
        # A closing unit of its own behind each run, all smaller than the words.
        closing = len(ends)
        words = np.searchsorted(self.names, values) + closing
        text = np.insert(words, ends, np.arange(closing))
        self.first_word = closing
        order = suffix_order(text)
        self.matrix = WaveletMatrix(text[order - 1], closing + len(self.names))
        symbols = np.arange(closing, closing + len(self.names))
        self.before = np.searchsorted(np.sort(text), symbols)
        self.origin = self.matrix.follow(symbols, np.zeros(len(symbols), np.int64))
        self.size = len(text)
        # Smallest place in the corpus of any interval of the suffix order, by powers of two.
        where = np.insert(places, ends, np.iinfo(np.int64).max)[order]
        self.least = [where]
        closed = byte_text.mixed(np.arange(closing).astype(np.uint64) + np.uint64(1))
        hashes = byte_text.grams(np.insert(values, ends, closed), KEPT_UNITS)
        ranks = np.flatnonzero(order < len(hashes))
        self.kept, at, count = np.unique(hashes[order[ranks]], return_index=True, return_counts=True)
        self.kept_low = ranks[at]
        self.kept_high = self.kept_low + count
        while len(where) > 1 << (len(self.least) - 1):
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            self.least.append(np.minimum(last, np.append(last[half:], last[len(last) - half :])))

    def search(self, values: np.ndarray, hashes: np.ndarray, starts: np.ndarray, length: int):
        """Intervals of the patterns ``values[s : s + length]``; empty where there is none.

        ``hashes`` are those of the runs of ``KEPT_UNITS`` values; no pattern is shorter.
        """
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        tail = hashes[starts + length - KEPT_UNITS]
        row = np.minimum(np.searchsorted(self.kept, tail), len(self.kept) - 1)
        alive = np.flatnonzero(self.kept[row] == tail) if len(self.kept) else np.zeros(0, np.int64)
        low[alive], high[alive] = self.kept_low[row[alive]], self.kept_high[row[alive]]
        for back in range(KEPT_UNITS + 1, length + 1):
            if not len(alive):
                break
            unit = values[starts[alive] + length - back]
            name = np.minimum(np.searchsorted(self.names, unit), len(self.names) - 1)
            here = self.names[name] == unit
            high[alive[~here]] = low[alive[~here]]
            alive, name = alive[here], name[here]
            both = np.concatenate([low[alive], high[alive]])
            both = self.matrix.follow(np.tile(name + self.first_word, 2), both) + np.tile(self.before[name] - self.origin[name], 2)
            low[alive], high[alive] = both[: len(alive)], both[len(alive) :]
            alive = alive[high[alive] > low[alive]]
        return low, high

    def first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.least[k][low[on]], self.least[k][high[on] - (1 << k)])
        return out


def judge(runs: repeats.Runs, window: int = WINDOW_WORDS):
    """For each window: its first unit, whether it is a repeat, and whether the source lacks it."""
    begins = np.append(0, runs.ends[:-1])
    run_of = np.repeat(np.arange(len(runs.ends)), runs.ends - begins)
    place = np.arange(len(runs.values))
    starts = place[place + window <= runs.ends[run_of]]
    removed, unknown = np.zeros(len(runs.values), bool), np.zeros(len(runs.values), bool)
    inside = np.repeat(runs.is_source, runs.ends - begins)
    if inside.any():
        source_ends = np.cumsum((runs.ends - begins)[runs.is_source])
        index = FMIndex(runs.values[inside], source_ends, place[inside])
        hashes = byte_text.grams(runs.values, KEPT_UNITS)
        asked = starts[runs.wanted[run_of[starts]]]
        for stretch in STRETCHES:
            # Windows still open, in groups that follow each other within a run.
            if not len(asked):
                break
            new = np.append(True, (asked[1:] != asked[:-1] + 1) | (run_of[asked[1:]] != run_of[asked[:-1]]))
            head = np.flatnonzero(new)
            offset = np.arange(len(asked)) - np.repeat(head, np.diff(np.append(head, len(asked))))
            new |= offset % stretch == 0
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(asked)))
            missed = np.zeros(len(head), bool)
            for n in np.unique(size):
                group = np.flatnonzero(size == n)
                low, high = index.search(runs.values, hashes, asked[head[group]], int(n) + window - 1)
                hit = high > low
                missed[group] = ~hit
                earlier = np.zeros(len(group), bool)
                earlier[hit] = index.first_place(low[hit], high[hit]) < asked[head[group]][hit]
                # A stretch of the source that only matches itself may still repeat in parts.
                missed[group[hit & ~earlier]] = n > 1
                for k in range(int(n)):
                    removed[asked[head[group[earlier]]] + k] = True
            left = np.repeat(missed, size)
            if stretch == 1:
                unknown[asked[left]] = True
            asked = asked[left]
    else:
        unknown[starts] = True
    # What no source holds is compared with itself.
    rest = np.flatnonzero(unknown)
    if len(rest):
        gap = np.append(True, (rest[1:] != rest[:-1] + 1) | (run_of[rest[1:]] != run_of[rest[:-1]]))
        head, tail = rest[gap], rest[np.append(gap[1:], True)] + window
        sizes = tail - head
        units = np.repeat(head - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        own, first = repeats.window_groups(runs.values[units], np.cumsum(sizes), window)
        removed[units[own]] |= first < own
    return starts, removed[starts], unknown[starts]


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept`` (binary), a row for each row with an id.

    Removes every word under a window of 20 words whose sequence starts earlier in the corpus
    (smaller doc_id, or earlier in the document); kept words are joined by a space. Null text has
    no words. Rows without doc_id are left out; rows that repeat a doc_id are taken to
    repeat its text too. Other columns are not read.
    """
    return repeats.remove_repeats(docs, UNIT, judge, b" ").withColumnRenamed("n_units", "n_words")
