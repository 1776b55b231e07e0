"""Vectors as short codes: one codebook entry for each of eight parts, found with LAESA pivots.

Each component becomes floor(4096 * x), each vector eight equal consecutive parts. Each part
position has a codebook of at most 16 entries, which starts as that part of the vectors with the
smallest ids and moves to the floored mean of its parts for a fixed number of rounds.

The nearest entry is found as LAESA does. A few of the starting entries are pivots and stay
fixed. Distances from every part to its pivots are computed once and saved with the parts. In a
round only the few distances from entries to pivots are new; the largest difference between the
two is a lower bound of the distance from part to entry. Entries are tried in the order of their
bounds, and a part is done as soon as the next bound exceeds its best exact distance. Exact
distances are sums of integers, so ties go to the lower index whatever the order was.

A round is one pass over the saved parts that sends the sums of each entry to the shuffle, never
a vector; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import match, save

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
#: Saved distances have 24 bits; a bound is lowered by more than their rounding.
ROUNDING = 2.5e-7
PARTS_TABLE = "vec_id bigint, size int, parts array<int>, pivots array<float>"


class Codebook(NamedTuple):
    entries: np.ndarray  # part, entry, position
    pivots: np.ndarray  # part, pivot, position


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances from ``rows`` (row, part, position) to ``points`` (part, point, position)."""
    out = np.empty((len(rows), *points.shape[:2]))
    for i in range(points.shape[1]):
        gap = rows - points[None, :, i]
        out[:, :, i] = np.sqrt((gap * gap).sum(2))
    return out


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` entries of each part, each the farthest from those taken before."""
    out = np.empty((len(entries), min(n, entries.shape[1]), entries.shape[2]), np.int64)
    for part, points in enumerate(entries):
        nearest = np.full(len(points), np.inf)
        chosen = 0
        for i in range(out.shape[1]):
            out[part, i] = points[chosen]
            gap = points - points[chosen]
            nearest = np.minimum(nearest, (gap * gap).sum(1))
            chosen = int(nearest.argmax())
    return out


def nearest(rows: np.ndarray, to_pivots: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry and squared distance of each part, and how many exact distances it took."""
    n, k = len(rows), book.entries.shape[1]
    which, error, tried = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64), 0
    from_entries = distances(book.pivots.transpose(1, 0, 2), book.entries)  # pivot, part, entry
    for part in range(PARTS):
        own = to_pivots[:, part].astype(np.float64)
        bound = np.zeros((n, k))
        for pivot, of_entries in enumerate(from_entries[:, part]):
            near = own[:, pivot, None]
            np.maximum(bound, np.abs(near - of_entries) - ROUNDING * (near + of_entries), out=bound)
        bound *= bound
        order = np.argsort(bound, axis=1, kind="stable")
        best, index, open_rows = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.arange(n)
        for place in range(k):
            entry = order[open_rows, place]
            go = bound[open_rows, entry] <= best[open_rows]
            open_rows, entry = open_rows[go], entry[go]
            if not len(open_rows):
                break
            gap = rows[open_rows, part] - book.entries[part, entry]
            exact = (gap * gap).sum(1)
            tried += len(open_rows)
            better = (exact < best[open_rows]) | ((exact == best[open_rows]) & (entry < index[open_rows]))
            best[open_rows[better]], index[open_rows[better]] = exact[better], entry[better]
        which[:, part], error[:, part] = index, best
    return which, error, tried


def _by_size(batch: pa.RecordBatch, column: str):
    """Rows of equal vector length together: ``length, row numbers, rows (row, part, position)``."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = batch.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(size), at, flat.reshape(len(at), PARTS, -1).astype(np.int64 if column == "parts" else np.float32)


def whole_parts(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, size, parts`` of the vectors that count, components as whole numbers.

    Vectors whose length is no multiple of eight are filled up with zeros.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    size = F.size("embedding")
    largest = F.sqrt(F.lit(2.0**61) / F.greatest(size, F.lit(1)))
    fits = F.forall("embedding", lambda x: F.abs(x) * SCALE < largest)
    wide = F.raise_error(F.lit("a component is too large for exact distances in 64 bits")).cast("array<int>")
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.pmod(-size, F.lit(PARTS))))
    return rows.select("vec_id", "label", size.alias("size"), F.when(fits, filled).otherwise(wide).alias("parts"))


def starting_books(rows: DataFrame) -> dict[int, Codebook]:
    """By vector length: the parts of the smallest ids, at most ``ENTRIES`` rows a length."""
    ids = rows.select("size", "vec_id").distinct().withColumn("rank", F.expr("row_number() OVER (PARTITION BY size ORDER BY vec_id NULLS LAST)"))
    ids = ids.filter(F.col("rank") <= ENTRIES)
    first = match(rows, ids, ["size", "vec_id"]).groupBy("size", "rank").agg(F.min("parts").alias("parts"))
    found: dict[int, list] = {}
    for row in sorted(first.collect(), key=lambda r: (r["size"], r["rank"])):
        found.setdefault(row["size"], []).append(row["parts"])
    books = {}
    for size, parts in found.items():
        entries = np.array(parts, np.int64).reshape(len(parts), PARTS, -1).transpose(1, 0, 2)
        books[size] = Codebook(entries, far_apart(entries, PIVOTS))
    return books


def with_pivots(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """Adds ``pivots``, the distances from each part to the fixed pivots."""
    schema = rows.schema.simpleString()[7:-1] + ",pivots:array<float>"

    def run(batches):
        for batch in batches:
            out = [None] * batch.num_rows
            for size, at, parts in _by_size(batch, "parts"):
                found = distances(parts, books[size].pivots).astype(np.float32).reshape(len(at), -1)
                for i, row in zip(at, found):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, "pivots"])

    return rows.mapInArrow(run, schema)


def moved(rows: DataFrame, books: dict[int, Codebook]) -> dict[int, Codebook]:
    """Each entry at the floored mean of the parts nearest to it; unused ones stay."""

    def run(batches):
        sums = {}
        for batch in batches:
            pivots = {size: p for size, _, p in _by_size(batch, "pivots")}
            for size, _, parts in _by_size(batch, "parts"):
                which, _, _ = nearest(parts, pivots[size], books[size])
                shape = books[size].entries.shape
                total, count = sums.setdefault(size, (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)))
                for part in range(PARTS):
                    np.add.at(total[part], which[:, part], parts[:, part])
                    count[part] += np.bincount(which[:, part], minlength=shape[1])
        for size, (total, count) in sums.items():
            at = np.argwhere(count > 0)
            columns = [pa.array(np.full(len(at), size), pa.int32()), pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32())]
            columns += [pa.array(count[tuple(at.T)]), pa.array(list(total[tuple(at.T)]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "part", "entry", "n", "total"])

    sums = rows.select("size", "parts", "pivots").mapInArrow(run, "size int, part int, entry int, n bigint, total array<bigint>")
    sums = sums.select("size", "part", "entry", "n", F.posexplode("total").alias("place", "value"))
    sums = sums.groupBy("size", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    entries = {size: book.entries.copy() for size, book in books.items()}
    for row in sums.collect():
        entries[row["size"]][row["part"], row["entry"], row["place"]] = row["value"] // row["n"]
    return {size: Codebook(entries[size], book.pivots) for size, book in books.items()}


def book_digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(map(str, book.entries.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256, n_tried`` by the given codebooks."""
    digests = {size: book_digest(book) for size, book in books.items()}
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {label}, code string, error bigint, codebooks_sha256 string, n_tried double"

    def run(batches):
        for batch in batches:
            code, digest = [""] * batch.num_rows, [""] * batch.num_rows
            error, tried = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            pivots = {size: p for size, _, p in _by_size(batch, "pivots")}
            for size, at, parts in _by_size(batch, "parts"):
                which, gaps, n = nearest(parts, pivots[size], books[size])
                text = which.astype(np.uint8).tobytes().hex()
                for i, row in enumerate(at):
                    code[row], digest[row] = text[2 * PARTS * i : 2 * PARTS * (i + 1)], digests[size]
                error[at], tried[at] = gaps.sum(1), n / len(at)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error), pa.array(digest), pa.array(tried)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256", "n_tried"])

    return rows.select("vec_id", "label", "size", "parts", "pivots").mapInArrow(run, schema)


def fit(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Codebook]]:
    """The saved parts with their pivot distances, and the codebooks after ``rounds`` rounds."""
    rows = whole_parts(embeddings)
    books = starting_books(rows)
    rows = save(with_pivots(rows, books), "parts")
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return rows, books


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors ``(vec_id, embedding, label, ...)``.

    Returns ``vec_id, code, error, label_error, codebooks_sha256, n_tried``, one row per row that
    counts. Rows whose vector is null or holds null or non-finite numbers are left out. Vectors of
    different lengths have codebooks of their own, an empty vector has the code of entry 0 and no
    error; with fewer than 16 ids there are fewer entries. A repeated id is one start, with the
    smallest of its vectors; a null id counts as the largest. Repeated rows all count and all come
    out. A null label is a label; ``label_error`` sums ``error`` over a label. ``n_tried`` is the
    mean number of exact distances that the row's batch took. A component beyond the range of
    exact 64-bit distances (32,768 for 64 numbers) is an error. Other columns are not read; an
    empty table gives an empty result.
    """
    rows, books = fit(embeddings, rounds)
    codes = save(coded(rows, books), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return match(codes, sums, ["label"]).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "n_tried")
