"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles, hashed by one function under a key that is drawn for
each run. Its sketch is the k
smallest hashes. Documents with equal sets are one class and go on as one.

Candidates. Each retained value has an inverted list of the classes that retain it. Two
sets with a similarity of the limit or more share at least ``min_shared`` of 64 retained values
(26 at 0.75), but for a chance of about 1e-8, as the 64 smallest values of their union are
common ones with that probability each; sets that are retained in full share as many as the limit asks
for. So a class with fewer values on lists of two or more has no partner. Of the others, with n retained values, only the n - min_shared + 1 on the shortest lists
count: two classes that share min_shared values share one of these. Values of passages that
stand everywhere come last in that order and are left out, unless a text has little else.

Groups. A list is known by its first member (smallest id). Lists with the same first member are
one group, so that the many lists of a family of copies are searched once. A group larger than
a block is cut by a hash into parts, and each pair of parts is searched on its own.

Search. Within a part the overlaps of retained values are counted by a matrix product over
the lists, the sketch of the union estimates the similarity, and pairs well under the limit
are dropped. The rest is verified on full sets, the most similar first, and a pair
whose members are already connected is left out: a part gives a spanning forest of verified
links and never all pairs.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from contactlake.llm import byte_text
from contactlake.llm.common import components, match, save

SHINGLE = 5
SKETCH = 64
PERCENT = 75
PART = 256
#: Hashes that one step of the verification looks up.
VERIFIED_AT_ONCE = 1_000_000
#: Estimates may be wrong; pairs this far under the limit are dropped (over five standard deviations).
MARGIN = 0.30
#: Chance that two sets at the limit share fewer retained values than are asked for.
MISSED = 2e-9


def min_shared(percent: int) -> int:
    """Retained values that two sets at the limit share, but for the chance ``MISSED``; one at least."""
    p, chance = percent / 100, 0.0
    for n in range(SKETCH):
        chance += math.comb(SKETCH, n) * p**n * (1 - p) ** (SKETCH - n)
        if chance > MISSED:
            return max(n, 1)
    return SKETCH


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, keep: int | None = SKETCH, also: list[str] = (), key: int = 0) -> DataFrame:
    """``doc_id, n_shingles, print_a, print_b, shingles`` (sorted, the smallest ``keep``), and columns to pass on.

    Shingles are 64-bit hashes under ``key``.
    """
    fields = [StructField(n, LongType()) for n in ("doc_id", "n_shingles", "print_a", "print_b")]
    fields = [*fields, StructField("shingles", ArrayType(LongType())), *(docs.schema[c] for c in also)]

    def run(batches):
        for batch in batches:
            for first, end, data, ends in byte_text.chunks(batch.column("text")):
                h, owner, _, _ = byte_text.words(data, ends, True, key)
                counts = np.bincount(owner, minlength=end - first)
                starts = np.concatenate([[0], np.cumsum(counts)])
                sets = []
                for i in range(end - first):
                    own = h[starts[i] : starts[i + 1]]
                    sets.append(np.unique(byte_text.grams(own, min(shingle, len(own)))) if len(own) else own)
                sizes = np.array([len(x) for x in sets])
                part = [x[:keep] for x in sets]
                flat = np.concatenate(part) if part else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]), pa.int32()), pa.array(flat.view(np.int64))
                )
                prints = [[int(f(x).sum(dtype=np.uint64).view(np.int64)) for x in sets] for f in (lambda x: x, byte_text.mixed)]
                passed = [batch.column(c).slice(first, end - first) for c in ("doc_id", *also)]
                columns = [passed[0], pa.array(sizes, pa.int64()), *(pa.array(p, pa.int64()) for p in prints), lists, *passed[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(run, StructType(fields))


def estimates(sketches: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Similarity of each row's and column's set, estimated on the sketch of their union.

    Up to the smaller of two sketches' ends both sets are known in full: what is common there
    is set against all that is there. An end only counts for sets larger than their sketch.
    """
    values, at = np.unique(np.concatenate(sketches), return_inverse=True)
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    several = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(several) - 1
    table = np.zeros((len(sketches), max(int(several.sum()), 1)), np.float32)
    on = several[at]
    table[owner[on], number[at[on]]] = 1
    overlap = table[rows] @ table[columns].T
    tops = np.array([x[-1] if n > len(x) else np.uint64(2**64 - 1) for x, n in zip(sketches, sizes)], np.uint64)
    known = np.stack([np.searchsorted(sketches[i], tops[columns], "right") for i in rows])
    known = known + np.stack([np.searchsorted(sketches[j], tops[rows], "right") for j in columns]).T
    return overlap / np.maximum(known - overlap, 1)


def verified_links(ids: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs ``rows`` x ``columns`` of sorted sets."""
    sizes = np.array([len(x) for x in sets])
    margin = max(MARGIN, 5.5 * math.sqrt(percent / 100 * (1 - percent / 100) / SKETCH))
    likely = estimates([x[:SKETCH] for x in sets], sizes, rows, columns) >= percent / 100 - margin
    parent = np.arange(len(ids))  # every member points at the root itself
    found = []
    for i, x in enumerate(rows.tolist()):
        ys = columns[likely[i]]
        small, large = np.minimum(sizes[x], sizes[ys]), np.maximum(sizes[x], sizes[ys])
        ys = ys[(100 * small >= percent * large) & (parent[ys] != parent[x])]
        for ys in np.array_split(ys, 1 + int(sizes[ys].sum()) // VERIFIED_AT_ONCE):
            if not len(ys):
                continue
            flat = np.concatenate([sets[y] for y in ys])
            place = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            common = np.add.reduceat((sets[x][place] == flat).astype(np.int64), np.cumsum(sizes[ys]) - sizes[ys])
            for y in ys[100 * common >= percent * (sizes[x] + sizes[ys] - common)].tolist():
                if parent[x] != parent[y]:
                    parent[parent == parent[y]] = parent[x]
                    found.append((int(ids[x]), int(ids[y])))
    return found


def search(key: tuple[pa.Scalar, ...], table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links of one pair of parts; ``side`` says in which part a member is."""
    ids = table.column("doc_id").to_numpy()
    side = table.column("side").to_numpy()
    lists = table.column("shingles").combine_chunks()
    flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    order = np.argsort(ids, kind="stable")
    first, second = order[side[order] == 0], order[side[order] == 1]
    low, high = key[1].as_py(), key[2].as_py()
    links = []
    if len(first) and (low == high or len(second)):
        links = verified_links(ids, sets, first, first if low == high else second, percent)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for documents ``(doc_id, text, ...)``.

    One row per doc_id. Rows without doc_id are left out; rows that repeat a doc_id are one
    document, the one with the most shingles. Texts without words have no shingles and are
    linked with nothing. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    secret = secrets.randbits(63)
    sketches = save(shingle_sets(docs, shingle, key=secret), "sketches")
    whole = ["n_shingles", "print_a", "print_b"]
    one = sketches.groupBy("doc_id").agg(F.max(F.struct(*whole)).alias("best")).select("doc_id", "best.*")
    one = save(one, "documents")
    classes = one.filter("n_shingles > 0").groupBy(*whole).agg(F.min("doc_id").alias("first_id"))
    classes = save(classes, "classes")
    keys = ["doc_id", *whole]
    reps = sketches.join(classes.withColumnRenamed("first_id", "doc_id"), keys, "left_semi").dropDuplicates(keys)

    # Inverted lists of the retained values; only their lengths are kept.
    entries = reps.select("doc_id", F.size("shingles").alias("n_kept"), F.explode("shingles").alias("value"))
    # A key of its own, so that both sides of the join are exchanged and long lists can be split.
    lists = entries.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1")
    lists = lists.select(F.col("value").bitwiseXOR(F.lit(1)).alias("other"), "length")
    shared = entries.select("doc_id", "n_kept", F.col("value").bitwiseXOR(F.lit(1)).alias("other")).join(lists, "other")
    shared = shared.select("doc_id", "n_kept", F.col("other").bitwiseXOR(F.lit(1)).alias("value"), "length")
    # Where the partner's set is retained in full as well, the limit itself says how many are shared.
    need = F.when(F.col("n_kept") * 100 <= SKETCH * percent, F.ceil(F.col("n_kept") * percent / 100)).otherwise(F.lit(min_shared(percent))).cast("int")
    rare = (
        shared.groupBy("doc_id", "n_kept")
        .agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("values"))
        .withColumn("need", need)
        .filter(F.size("values") >= F.col("need"))
        .select("doc_id", F.explode(F.slice("values", F.lit(1), F.size("values") - F.col("need") + 1)).alias("v"))
        .select("doc_id", F.col("v.value").alias("value"))
    )
    rare = save(rare, "lists")
    heads = rare.groupBy("value").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = match(rare, heads, ["value"]).select("head", "doc_id").distinct()
    members = save(members, "groups")

    # Groups larger than a part are searched as pairs of parts.
    parts = members.groupBy("head").agg(F.ceil(F.count("*") / PART).cast("int").alias("n_parts"))
    cut = match(members, parts, ["head"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int"))
    pairs = cut.select("head", "doc_id", "part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other"))
    pairs = pairs.select(
        "head",
        "doc_id",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
    )
    wanted = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("head", "low", "high", "side")).alias("places"))
    wanted = wanted.join(classes.withColumnRenamed("first_id", "doc_id"), "doc_id").select(
        "doc_id", F.struct("places", *(F.col(c).alias(f"of_{c}") for c in whole)).alias("wanted")
    )
    sets = shingle_sets(docs.join(wanted, "doc_id"), shingle, None, ["wanted"], secret)
    # Of rows that repeat an id, the one that counts.
    for c in whole:
        sets = sets.filter(F.col(c) == F.col(f"wanted.of_{c}"))
    links = sets.select("doc_id", "shingles", F.explode("wanted.places").alias("p")).select("doc_id", "shingles", "p.*")
    verified = lambda key, table: search(key, table, percent)
    links = links.groupBy("head", "low", "high").applyInArrow(verified, "a long, b long").distinct()
    found = components(save(links, "links"))
    named = classes.join(found, F.col("first_id") == F.col("node"), "left").select(
        *whole, F.coalesce("component", "first_id").alias("component_id")
    )
    placed = match(one, named, whole, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which one of each group stays, all columns; rows without doc_id stay too."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
