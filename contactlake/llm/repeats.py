"""Where a window of consecutive units (words or bytes) stood earlier in the corpus.

Every window has an anchor: the smallest hash among its short grams. Equal windows have equal
anchors, and a text has several times fewer anchors than windows. Anchors are counted over
the corpus; those that occur once are forgotten with all their windows. The first document
(smallest id) with an anchor is its source. The windows left go to the shard of
their anchor's source, as runs of text, so that equal windows meet.

A long source is cut into pieces by place, each a source of its own. A piece that many documents
repeat has its runs cut into parts by document, no more than there are documents, each with a
copy of the piece's own runs. What does not stand in the source is then compared across
parts by a hash of the window, the first one of each part for all.

Texts beyond a size are read in stretches that overlap by a window, so that what a task holds
of a text does not grow with it. Hashes have a key that is drawn for each run; in a shard
words count as equal if two hashes under different keys agree.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import byte_text
from contactlake.llm.common import save


class Unit(NamedTuple):
    name: str
    split: Callable  # bytes, ends, key -> value, text number, start and end of each unit
    border: Callable  # bytes, place -> the next place that no unit spans
    window: int
    gram: int
    shard_anchors: int  # anchors of a shard, which bounds its memory
    piece: int  # units of a source's piece
    part_anchors: int = 200  # no part of a source is made smaller
    stretch: int = 1 << 21  # longer texts are read in stretches of so many bytes
    key: int = 0


def byte_units(data: np.ndarray, ends: np.ndarray, key: int = 0):
    place = np.arange(len(data))
    return data.astype(np.uint64) + np.uint64(1), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), place, place + 1


def byte_border(data: np.ndarray, place: int) -> int:
    return min(place, len(data))


def word_units(data: np.ndarray, ends: np.ndarray, key: int = 0):
    return byte_text.words(data, ends, key=key)


def word_border(data: np.ndarray, place: int) -> int:
    while place < len(data):
        found = np.flatnonzero(byte_text.blanks(data[place : place + 65_536]))
        if len(found):
            return place + int(found[0])
        place += 65_536
    return len(data)


def stretches(data: np.ndarray, ends: np.ndarray, unit: Unit, overlap: int):
    """``units before, own units, (values, text numbers, starts, ends), bytes``: all texts at once, or a long one bit by bit.

    A stretch ends with ``overlap`` units more than its own, where there are as many.
    """
    if len(ends) > 2 or len(data) <= 2 * unit.stretch:
        units = unit.split(data, ends, unit.key)
        yield 0, len(units[0]), units, data
        return
    at = before = 0
    while at < len(data):
        cut = end = unit.border(data, at + unit.stretch)
        units = unit.split(data[at:cut], np.array([0, cut - at]), unit.key)
        own = len(units[0])
        while end < len(data) and len(units[0]) < own + overlap:
            end = unit.border(data, end + 64 * overlap)
            units = unit.split(data[at:end], np.array([0, end - at]), unit.key)
        yield before, own, units, data[at:end]
        at, before = cut, before + own


class Runs(NamedTuple):
    """Runs of a shard in the order of the corpus; windows are numbered by their first unit."""

    values: np.ndarray
    ends: np.ndarray  # of each run, as unit numbers
    is_source: np.ndarray  # by run
    wanted: np.ndarray  # by run: its windows are judged here


def window_keys(values: np.ndarray, owner: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the grams, and for each window its smallest one (0: it spans two texts)."""
    hashes = byte_text.grams(values, unit.gram, unit.key) | np.uint64(1)
    width = unit.window - unit.gram + 1
    if len(values) < unit.window:
        return hashes, np.zeros(0, np.uint64)
    least = byte_text.sliding(np.minimum, hashes, width)
    least[owner[: len(least)] != owner[unit.window - 1 :]] = 0
    return hashes, least


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """``anchor, doc_id, n, piece``: the anchors of each document, how often they stand in it and the piece of the first place."""
    width = unit.window - unit.gram + 1
    pad = np.zeros(width - 1, np.uint64)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, _, data, ends in byte_text.chunks(batch.column("text")):
                before_chosen = np.zeros(0, bool)
                for before, n_own, (values, owner, _, _), _ in stretches(data, ends, unit, unit.window - 1):
                    hashes, least = window_keys(values, owner, unit)
                    least = least[:n_own]
                    if not len(least):
                        continue
                    hashes = hashes[: len(least) + width - 1]
                    chosen = byte_text.sliding(np.maximum, np.concatenate([pad, least, pad]), width) == hashes
                    known = before_chosen
                    before_chosen = chosen[n_own:].copy()
                    chosen[: len(known)] &= ~known[: len(chosen)]
                    place = np.flatnonzero(chosen)
                    key, own = hashes[place], owner[place]
                    order = np.lexsort((key, own))
                    key, own, place = key[order], own[order], place[order]
                    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, np.int64)
                    count = np.diff(np.append(new, len(key)))
                    piece = (place[new] - np.searchsorted(owner, own[new]) + before) // unit.piece
                    columns = [pa.array(key[new].view(np.int64)), pa.array(ids[first + own[new]]), pa.array(count), pa.array(piece)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "n", "piece"])

    return docs.mapInArrow(run, "anchor long, doc_id long, n long, piece long")


def runs_of(docs: DataFrame, unit: Unit) -> DataFrame:
    """Runs of windows with one source, for documents with the ``known`` anchors.

    ``place`` has the piece of the source (upper half) and its number of parts (lower half); a run of
    the source itself goes to every part.
    """
    schema = "source long, place long, doc_id long, start int, body binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            lists = batch.column("known")
            for first, end, data, ends in byte_text.chunks(batch.column("text")):
                known = lists.slice(first, end - first).flatten()
                names = known.field("anchor").to_numpy().view(np.uint64)
                names, at = np.unique(names, return_index=True)
                all_sources, all_places = (known.field(c).to_numpy()[at] for c in ("source", "place"))
                for before, n_own, (values, owner, begin, stop), part in stretches(data, ends, unit, unit.window - 1):
                    _, least = window_keys(values, owner, unit)
                    least = least[:n_own]
                    if not len(least):
                        continue
                    where = np.minimum(np.searchsorted(names, least), len(names) - 1)
                    hit = (names[where] == least) & (least != 0)
                    sources, places = all_sources[where], all_places[where]
                    own = owner[: len(least)]
                    change = (sources[1:] != sources[:-1]) | (places[1:] != places[:-1]) | (own[1:] != own[:-1])
                    starts = np.flatnonzero(hit & np.append(True, ~hit[:-1] | change))
                    stops = np.flatnonzero(hit & np.append(~hit[1:] | change, True)) + unit.window - 1
                    zero = np.searchsorted(owner, own[starts]) - before
                    raw = part.tobytes()
                    columns = (
                        sources[starts], places[starts], ids[first + own[starts]], starts - zero,
                        [raw[a:b] for a, b in zip(begin[starts].tolist(), stop[stops].tolist())],
                    )
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["source", "place", "doc_id", "start", "body"])

    rows = docs.mapInArrow(run, schema)
    n_parts = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    home = F.pmod(F.xxhash64("doc_id"), n_parts).cast("int")
    own = F.col("doc_id") == F.col("source")
    rows = rows.withColumns({"n_parts": n_parts, "home": home, "piece": F.shiftright("place", 32).cast("int")})
    rows = rows.withColumn("part", F.explode(F.when(own, F.sequence(F.lit(0), F.col("n_parts") - 1)).otherwise(F.array("home"))))
    role = F.when(~own, 0).when(F.col("part") == F.col("home"), 2).otherwise(1)
    flags = role + F.when(F.col("n_parts") > 1, 4).otherwise(0)
    return rows.select("source", "piece", "part", flags.alias("flags"), "doc_id", "start", "body")


def window_groups(values: np.ndarray, ends: np.ndarray, window: int, key: np.ndarray | None = None, depth: int = 1):
    """Windows (by first unit) within runs and, for each, the first window equal to it.

    Bucket-pointer refinement. ``key`` puts places into buckets by their first ``depth`` units
    (by default one unit). A bucket for twice the length is found by sorting on the buckets at
    a place and at that length further on. Places alone in their bucket are final and
    are only looked up from then on.
    """
    n = len(values)
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))
    place = np.arange(n)
    active = place[place + depth <= end_of]
    key = (values if key is None else key)[active]
    label = place.copy()
    while True:
        order = np.argsort(key)
        sorted_key, members = key[order], active[order]
        head = np.append(True, sorted_key[1:] != sorted_key[:-1]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(order)))
        # A bucket is named by a member, so that names of final buckets stay apart from new ones.
        fresh = place.copy()
        fresh[members] = np.repeat(members[first], size)
        label = fresh
        if depth == window:
            break
        step = min(depth, window - depth)
        active = np.sort(members[np.repeat(size > 1, size)])
        active = active[active + depth + step <= end_of[active]]
        key = label[active] * np.int64(n + 1) + label[active + step]
        depth += step
    starts = place[place + window <= end_of]
    least = np.full(n, n)
    least[members[first]] = np.minimum.reduceat(members, first) if len(first) else 0
    named = label[starts]
    return starts, np.where(least[named] < n, least[named], starts)


def told_apart(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``values``, or where equal ones have different ``others``, new values that tell all pairs apart."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    if not (others[order][1:] != others[order][:-1])[same].any():
        return values
    number = np.unique(np.stack([values, others]), axis=1, return_inverse=True)[1].ravel()
    return byte_text.mixed(number.astype(np.uint64) + np.uint64(1))


def shard_results(table: pa.Table, unit: Unit, judge: Callable[[Runs], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """``doc_id, start, end`` of what is removed; with hashes, windows to compare across parts."""
    doc, start, flags = (table.column(c).to_numpy() for c in ("doc_id", "start", "flags"))
    order = np.lexsort((-(flags & 3), start, doc))
    keep = np.append(True, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1]))
    table = table.take(pa.array(order[keep]))
    doc, start, flags = (table.column(c).to_numpy() for c in ("doc_id", "start", "flags"))
    role, split = flags & 3, flags >= 4
    bodies = table.column("body").to_pylist()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    cuts = np.cumsum([0, *map(len, bodies)])
    values, owner = unit.split(data, cuts, unit.key)[:2]
    if unit.name == "words":
        values = told_apart(values, unit.split(data, cuts, unit.key + 1)[0])
    ends = np.searchsorted(owner, np.arange(len(bodies)), "right")
    # A run with the text of an earlier one is a repeat as a whole.
    seen, again = {}, np.zeros(len(bodies), bool)
    for i, body in enumerate(bodies):
        key = hashlib.blake2b(body, digest_size=16).digest()
        again[i] = seen.setdefault(key, i) != i and role[i] == 0
    base = np.append(0, ends[:-1])
    from_doc, from_start, to = [doc[again]], [start[again]], [start[again] + (ends - base)[again]]
    rest = np.flatnonzero(~again)
    sizes = (ends - base)[rest]
    on = np.repeat(~again, ends - base)
    runs = Runs(values[on], np.cumsum(sizes), role[rest] > 0, role[rest] != 1)
    starts, removed, unknown = judge(runs)
    run_of = np.searchsorted(runs.ends, starts, "right")
    first_unit = (runs.ends - sizes)[run_of]
    at = start[rest][run_of] + starts - first_unit
    # Removed windows that follow each other become one range.
    gone = np.flatnonzero(removed & runs.wanted[run_of])
    if len(gone):
        gap = np.append(True, (starts[gone][1:] != starts[gone][:-1] + 1) | (run_of[gone][1:] != run_of[gone][:-1]))
        head, tail = gone[gap], gone[np.append(gap[1:], True)]
        from_doc.append(doc[rest][run_of[head]])
        from_start.append(at[head])
        to.append(at[tail] + unit.window)
    doc_col, start_col, end_col = np.concatenate(from_doc), np.concatenate(from_start), np.concatenate(to)
    n_ranges = len(doc_col)
    open_ = np.flatnonzero(unknown & ~removed & split[rest][run_of])
    hashes = [np.zeros(0, np.uint64)] * 2
    if len(open_):
        # The same values in all parts of a source: those before equal ones were told apart.
        plain = unit.split(data, cuts, unit.key)[0][on] if unit.name == "words" else runs.values
        hashes = [byte_text.grams(v, unit.window, unit.key)[starts[open_]] for v in (plain, byte_text.mixed(plain ^ np.uint64(unit.key)))]
        doc_col = np.concatenate([doc_col, doc[rest][run_of[open_]]])
        start_col = np.concatenate([start_col, at[open_]])
        end_col = np.concatenate([end_col, at[open_] + unit.window])
    hash_cols = [
        pa.concat_arrays([pa.nulls(n_ranges, pa.int64()), pa.array(h.view(np.int64))]) for h in hashes
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_col, pa.int64()), pa.array(start_col, pa.int32()), pa.array(end_col, pa.int32()), *hash_cols],
        names=["doc_id", "start", "end", "hash_a", "hash_b"],
    )


def kept_rows(docs: DataFrame, unit: Unit, joined: bytes) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept`` (binary) for documents and their ``ranges``."""
    schema = "doc_id long, n_units long, n_removed long, n_spans long, kept binary"

    def stay(units, data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[bytes]:
        _, owner, begin, stop = units
        raw, kept = data.tobytes(), []
        zero = np.searchsorted(owner, np.arange(len(ends)))
        for i in range(len(ends) - 1):
            a, b = zero[i], zero[i + 1]
            if joined == b"":
                kept.append(data[ends[i] : ends[i + 1]][~gone[a:b]].tobytes() if gone[a:b].any() else raw[ends[i] : ends[i + 1]])
            elif not gone[a:b].any():
                kept.append(joined.join(raw[ends[i] : ends[i + 1]].split()))
            else:
                on = a + np.flatnonzero(~gone[a:b])
                kept.append(joined.join(raw[s:e] for s, e in zip(begin[on].tolist(), stop[on].tolist())))
        return kept

    def run(batches):
        for batch in batches:
            ranges = batch.column("ranges")
            for first, end, data, ends in byte_text.chunks(batch.column("text")):
                own = ranges.slice(first, end - first)
                sizes = np.array([0 if n is None else n for n in own.value_lengths().to_pylist()], np.int64)
                flat = own.flatten()
                of = np.repeat(np.arange(end - first), sizes)
                low, high = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
                counts, kept, open_ = np.zeros((3, end - first), np.int64), [], False
                for before, _, units, part in stretches(data, ends, unit, 0):
                    owner = units[1]
                    zero = np.searchsorted(owner, np.arange(end - first + 1))
                    # Ends counted up and down over all units; ranges never leave their text.
                    change = np.zeros(len(owner) + 1, np.int32)
                    for places, by in ((low, 1), (high, -1)):
                        np.add.at(change, np.clip(zero[of] + places - before, zero[of], zero[of + 1]), by)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = gone & np.append(True, ~gone[:-1] | (owner[1:] != owner[:-1])) if len(gone) else gone
                    if before and open_ and len(gone):
                        spans[0] = False  # goes on from the stretch before
                    open_ = bool(len(gone) and gone[-1])
                    counts += [np.bincount(owner[on], minlength=end - first) for on in (slice(None), gone, spans)]
                    kept.append(stay(units, part, ends if part is data else np.array([0, len(part)]), gone))
                kept = kept[0] if len(kept) == 1 else [joined.join(k[0] for k in kept if k[0])]
                columns = [batch.column("doc_id").slice(first, end - first), *map(pa.array, counts), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_units", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, unit: Unit, judge: Callable, joined: bytes) -> DataFrame:
    """Documents without the units that an earlier, equal window covers; see ``kept_rows``."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    unit = unit._replace(key=secrets.randbits(62))
    found = anchors(docs, unit)
    counts = found.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.sum("n").alias("n"), F.count("*").alias("n_docs")).filter("n > 1")
    # Only long documents have more than one piece. Partitioned by anchor as the counts are, they are not moved again.
    long = anchors(docs.filter(F.octet_length("text") > unit.piece), unit).filter("piece > 0")
    long = long.groupBy("anchor", F.col("doc_id").alias("of")).agg(F.min("piece").alias("piece")).withColumnRenamed("anchor", "name")
    counts = counts.join(long, (F.col("anchor") == F.col("name")) & (F.col("source").bitwiseXOR(F.col("of")) == 0), "left")
    counts = save(counts.select("anchor", "source", F.coalesce("piece", F.lit(0).cast("long")).alias("piece"), "n", "n_docs"), "anchors", "zstd")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // unit.shard_anchors))
    # Parts are small against a shard, so that shards come out even.
    weights = counts.groupBy("source", "piece").agg(F.sum("n").alias("weight"), F.max("n_docs").alias("n_docs"))
    n_parts = F.least(F.ceil(F.col("weight") / F.lit(total // (4 * shards) + unit.part_anchors)), "n_docs")
    place = F.shiftleft(F.col("piece"), 32).bitwiseOR(n_parts).alias("place")
    # Keys of their own: both sides are exchanged and frequent anchors can be split.
    known = counts.join(weights.select("source", "piece", place), ["source", "piece"])
    known = known.select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("other"), "source", "place")
    known = found.select("doc_id", F.col("anchor").bitwiseXOR(F.lit(1)).alias("other")).join(known, "other")
    anchor = F.col("other").bitwiseXOR(F.lit(1)).alias("anchor")
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct(anchor, "source", "place")).alias("known"))
    runs = runs_of(docs.join(known, "doc_id"), unit).repartition(shards, "source", "piece", "part")

    def shard(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield shard_results(pa.Table.from_batches(rows), unit, judge)

    results = save(runs.mapInArrow(shard, "doc_id long, start int, end int, hash_a long, hash_b long"), "repeats", "zstd")
    open_ = results.filter("hash_a is not null")
    hashes = ["hash_a", "hash_b"]
    firsts = open_.groupBy(*hashes).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("last_id > first_id")
    firsts = firsts.select(F.col("hash_a").bitwiseXOR(F.lit(1)).alias("other"), "hash_b", "first_id")
    later = open_.withColumn("other", F.col("hash_a").bitwiseXOR(F.lit(1))).join(firsts, ["other", "hash_b"]).filter("doc_id > first_id")
    ranges = results.filter("hash_a is null").select("doc_id", "start", "end").union(later.select("doc_id", "start", "end"))
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return kept_rows(docs.join(ranges, "doc_id", "left"), unit, joined)
