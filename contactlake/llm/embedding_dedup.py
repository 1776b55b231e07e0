"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least c lie at most eps = sqrt(2 - 2c) apart. They are turned to
the principal directions of a bounded sample of their length and put into a grid of side eps on the
leading ones. Sorted by label and grid cell, the vectors are a sequence that is cut into blocks of a fixed
number. Two blocks are joined only if their boxes are at most eps apart in the leading
directions; a join halves both blocks again and again, leaves out halves that are provably
distant, and compares what is left by one product of matrices in double precision.

Equal vectors of a label are one from the start, with a count. A join of two blocks gives each
vector's number of links and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import components, match, save

COSINE = 0.98
LEAD = 8
BLOCK = 512
LEAF = 64
#: Numbers in the sample that principal directions are found from, and rows of a length at least.
SAMPLE_VALUES = 1_000_000
LEAST_ROWS = 64
#: Rounding may not part a pair: boxes are kept this much further apart.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def directions(vectors: DataFrame, values: int = SAMPLE_VALUES) -> dict[int, np.ndarray]:
    """By vector length: leading principal directions as columns, found from a sample drawn by a hash.

    The sample holds about ``values`` numbers, divided between the lengths, and ``LEAST_ROWS`` rows of each at least.
    """
    counts = {r["size"]: r["count"] for r in vectors.groupBy("size").count().collect()}
    wanted = {size: max(LEAST_ROWS, values // (max(size, 1) * len(counts))) for size in counts}
    rates = [(size, min(1.0, 1.2 * wanted[size] / n)) for size, n in counts.items()]
    rates = F.broadcast(vectors.sparkSession.createDataFrame(rates, "size int, rate double"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "first_id"), F.lit(1 << 30)) / (1 << 30)
    rows = vectors.select("size", "first_id", "embedding", draw.alias("draw")).join(rates, "size").filter("draw < rate")
    sample: dict[int, list] = {}
    for row in sorted(rows.select("size", "draw", "first_id", "embedding").collect(), key=lambda r: (r["size"], r["draw"], r["first_id"])):
        own = sample.setdefault(row["size"], [])
        if len(own) < wanted[row["size"]]:
            own.append(row["embedding"])
    found = {}
    for size in counts:
        own = np.array(sample.get(size, []), np.float64).reshape(-1, size)
        own /= np.sqrt((own**2).sum(1, keepdims=True))
        spread, axes = np.linalg.eigh(np.cov(own, rowvar=False).reshape(size, size) if len(own) > 1 else np.eye(size))
        found[size] = axes[:, np.argsort(-spread)[:LEAD]]
    return found


def grid(vectors: DataFrame, found: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Adds ``lead`` (leading coordinates of the unit vector, zeros where there are fewer) and ``cells``."""
    shared = vectors.sparkSession.sparkContext.broadcast(found)
    schema = vectors.schema.simpleString()[7:-1] + ",lead:array<double>,cells:array<int>"

    def run(batches):
        own = shared.value
        for batch in batches:
            lead = np.zeros((batch.num_rows, LEAD))
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                on = np.flatnonzero(sizes == size)
                rows = _matrix(batch.column("embedding").take(pa.array(on)))
                lead[on, : own[int(size)].shape[1]] = rows @ own[int(size)] / np.sqrt((rows**2).sum(1, keepdims=True))
            cells = np.floor(lead / eps).astype(np.int32)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * LEAD)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (lead, cells)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "lead", "cells"])

    return vectors.mapInArrow(run, schema)


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in grid order with the number of their ``block``: one label and length a block."""
    order = ["label", "size", *[F.try_element_at("cells", F.lit(i + 1)) for i in range(4)], "first_id"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = rows.schema.simpleString()[7:-1] + ",block:bigint"

    def run(batches):
        number, count, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist())):
                if key != last or count == BLOCK:
                    number, count, last = number + 1, 0, key
                count += 1
                out[i] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    return rows.mapInArrow(run, schema)


def near_blocks(placed: DataFrame, eps: float) -> DataFrame:
    """``a, b`` (a <= b): blocks of one label whose boxes are at most ``eps`` apart."""
    width = LEAD
    at = lambda i: F.coalesce(F.try_element_at("lead", F.lit(i + 1)), F.lit(0.0))
    boxes = placed.groupBy("label", "size", "block").agg(
        F.array(*[F.min(at(i)) for i in range(width)]).alias("low"), F.array(*[F.max(at(i)) for i in range(width)]).alias("high")
    )
    boxes = save(boxes, "boxes")
    cell = lambda side, i: F.floor(F.element_at(side, i + 1) / eps).cast("int")

    def spread(frame, more, prefix):
        for i in (0, 1):
            frame = frame.withColumn(f"c{i}", F.explode(F.sequence(cell("low", i) - more, cell("high", i) + more)))
        return frame.select("label", "size", "c0", "c1", *[F.col(c).alias(prefix + c) for c in ("block", "low", "high")])

    left, right = spread(boxes, 0, "a_"), spread(boxes, 1, "b_")
    pairs = left.join(right, ["label", "size", "c0", "c1"]).filter("a_block <= b_block")
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col("b_low")[i] - F.col("a_high")[i], F.col("a_low")[i] - F.col("b_high")[i]), 2) for i in range(width)
    )
    return pairs.filter(gap <= (eps + SLACK) ** 2).select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct()


def join_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between two blocks, or within one: ``a, b`` for links, ``a, n`` for numbers of links."""
    eps = math.sqrt(2 - 2 * COSINE) + SLACK
    same = key[0].as_py() == key[1].as_py()
    side = table.column("block").to_numpy() != key[0].as_py()
    ids, copies = table.column("first_id").to_numpy(), table.column("copies").to_numpy()
    vectors = _matrix(table.column("embedding").combine_chunks())
    lead = _matrix(table.column("lead").combine_chunks())
    norms = np.sqrt((vectors**2).sum(1))
    order = np.lexsort((*lead[:, ::-1].T,))
    first = order[~side[order]]
    second = first if same else order[side[order]]
    counts = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))
    links = []

    def apart(a, b):
        gap = np.maximum(0, np.maximum(lead[b].min(0) - lead[a].max(0), lead[a].min(0) - lead[b].max(0)))
        return (gap**2).sum() > eps**2

    todo = [(first, second)] if len(first) and len(second) else []
    while todo:
        a, b = todo.pop()
        if apart(a, b):
            continue
        if len(a) > LEAF or len(b) > LEAF:
            halves = [(x, y) for x in np.array_split(a, 2 if len(a) > 1 else 1) for y in np.array_split(b, 2 if len(b) > 1 else 1)]
            todo.extend(halves)
            continue
        hit = vectors[a] @ vectors[b].T / np.outer(norms[a], norms[b]) >= COSINE
        if same:
            hit &= a[:, None] != b[None, :]
        if not hit.any():
            continue
        counts[a] += hit @ copies[b]
        if not same:
            counts[b] += hit.T @ copies[a]
        for i, j in np.argwhere(hit):
            x, y = parent[a[i]], parent[b[j]]
            if x != y:
                parent[parent == y] = x
                links.append((ids[a[i]], ids[b[j]]))
    some = np.flatnonzero(counts)
    kinds = pa.int64()
    return pa.table(
        {
            "a": pa.array([*(int(x) for x, _ in links), *ids[some].tolist()], kinds),
            "b": pa.array([*(int(y) for _, y in links), *([None] * len(some))], kinds),
            "n": pa.array([*([0] * len(links)), *counts[some].tolist()], kinds),
        }
    )


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for vectors ``(vec_id, embedding, label, ...)``.

    Vectors of the same label and length are linked from a cosine of ``COSINE`` on. Vectors
    that are null, zero or hold null or non-finite numbers, and vectors without label, are linked
    with nothing. Rows without vec_id are left out; rows that repeat id, label and vector are
    one. Other columns are not read; an empty table gives an empty result.
    """
    eps = math.sqrt(2 - 2 * COSINE)
    rows = embeddings.filter("vec_id is not null").select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>")).distinct()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    whole = ["label", "embedding"]
    classes = rows.filter(good).groupBy(*whole).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = save(classes.withColumn("size", F.size("embedding")), "vectors")
    # Twice as many ranges as shuffle partitions, so that ranges come out even.
    n = 2 * int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = save(blocks(grid(classes, directions(classes), eps), n), "grid")
    pairs = save(near_blocks(placed, eps), "pairs")
    asked = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    loaded = asked.join(placed.select("block", "first_id", "copies", "embedding", "lead"), "block")
    found = save(loaded.groupBy("a", "b").applyInArrow(join_blocks, "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("first_id")).agg(F.sum("n").alias("others"))
    linked = components(found.filter("b is not null")).withColumnRenamed("node", "first_id")
    named = classes.join(counts, "first_id", "left").join(linked, "first_id", "left").select(
        *whole,
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "first_id").alias("component_id"),
    )
    out = match(rows, named, whole, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
