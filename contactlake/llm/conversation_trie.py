"""Trie of conversation beginnings as balanced parentheses, a sequence for each shard.

Nodes in depth-first order are cut into shards of a fixed number. A shard writes an opening
parenthesis for each of its nodes and a closing one where its subtree ends; the excess of opening
over closing ones is kept with the least excess of each block and of runs of blocks. ``findclose``
walks these minima up and down to the first place where the excess falls below that of a node,
which delimits the subtree. Leaves are pairs "()", counted by rank; savings are differences of
a cumulative array.

A node whose subtree goes on in later shards lies on the spine of both. A shard knows at which
place a spine node of a given depth ends in it, if it does; the first later shard with such a place
closes the node, and the cumulative values of both shards give its sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import WORD, match, save
from contactlake.llm.turn_tree import ROOT, numbered, tree, turn_rows

SHARD_NODES = 1 << 19
BLOCK = 64
#: Ids of one hash run that are put together before they move.
PIECE_IDS = 4096
GROUP, SHARED = 20, 4
SHARD = "kind int, shard bigint, least bigint, below bigint, leaves bigint, saved bigint, closed boolean"


class Minima:
    """Least values of blocks and, level by level, of two neighbours of the level below."""

    def __init__(self, values: np.ndarray, block: int = BLOCK):
        self.block, self.size = block, len(values)
        big = np.iinfo(np.int64).max
        padded = np.full(-(-max(len(values), 1) // block) * block, big, np.int64)
        padded[: len(values)] = values
        self.rows = padded.reshape(-1, block)
        self.levels = [self.rows.min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, big) if len(low) % 2 else low
            self.levels.append(low.reshape(-1, 2).min(1))

    def _within(self, at: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place of block ``at`` from ``start`` on with a value of at most ``target``, or -1."""
        out = np.full(len(at), -1, np.int64)
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            hit = (self.rows[at[part]] <= target[part, None]) & (np.arange(self.block) >= start[part, None])
            out[part] = np.where(hit.any(1), at[part] * self.block + hit.argmax(1), -1)
        return out

    def first(self, place: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each query the first place behind ``place`` with a value of at most ``target``; ``size`` if none."""
        place, target = place.astype(np.int64), target.astype(np.int64)
        at = place // self.block
        found = self._within(at, place % self.block + 1, target)
        todo = np.flatnonzero(found < 0)
        node, level = at[todo], np.zeros(len(todo), np.int64)
        hit = np.full(len(todo), -1, np.int64)  # node of a level whose least value is low enough
        going = np.arange(len(todo))
        for h, low in enumerate(self.levels):
            right = node[going] + 1
            fits = (right % 2 == 1) & (right < len(low))  # the right neighbour under the same parent
            ok = fits & (low[np.minimum(right, len(low) - 1)] <= target[todo[going]])
            hit[going[ok]], level[going[ok]] = right[ok], h
            going = going[~ok]
            node[going] //= 2
        for h in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero((hit >= 0) & (level == h))
            left = hit[down] * 2
            right = self.levels[h - 1][left] > target[todo[down]]
            hit[down], level[down] = left + right, h - 1
        found[todo] = self.size
        some = hit >= 0
        found[todo[some]] = self._within(hit[some], np.zeros(int(some.sum()), np.int64), target[todo[some]])
        return found


def subtrees(depth: np.ndarray, leaf: np.ndarray, saving: np.ndarray) -> dict[str, np.ndarray]:
    """Leaves and savings below each node of a stretch of the depth-first order.

    ``closed`` tells whether the subtree ends within the stretch; if not, ``leaves`` and ``saved``
    are those in front of the node. ``records`` are the nodes that end some earlier stretch's nodes.
    """
    least = np.minimum.accumulate(depth)
    excess = depth - least + 1
    closes = np.append(excess[:-1] - excess[1:] + 1, excess[-1])
    opens_at = np.arange(len(depth)) + np.append(0, np.cumsum(closes[:-1]))
    bits = np.zeros(int(len(depth) + closes.sum()), np.int8)
    bits[opens_at] = 1
    level = np.cumsum(bits * np.int64(2) - 1)
    ends = Minima(level).first(opens_at, level[opens_at] - 1)
    pairs = np.append((bits[:-1] == 1) & (bits[1:] == 0), False)
    pairs[opens_at[-1]] = leaf[-1]  # the next shard may hold children of the last node
    rank = np.append(0, np.cumsum(pairs))
    nodes_before = np.cumsum(bits)
    total = np.append(0, np.cumsum(saving))
    closed = ends < len(bits) - excess[-1]
    leaves = np.where(closed, rank[ends] - rank[opens_at], rank[opens_at])
    saved = np.where(closed, total[nodes_before[ends]] - total[:-1], total[:-1])
    records = np.flatnonzero(np.append(True, least[1:] < least[:-1]))
    below = np.append(np.iinfo(np.int64).max, least[records[1:] - 1])
    return {
        "leaves": leaves, "saved": saved, "closed": closed, "records": records, "below": below, "least": least[-1:],
        "record_leaves": rank[opens_at[records]], "record_saved": total[records], "total": np.array([rank[-1], total[-1]]),
    }


def shards(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Rows of three kinds: 0 a node with its sums, 1 a place that closes spine nodes, 2 a shard's total."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "saving"]
    rows = nodes.repartitionByRange(n, "path", "depth").sortWithinPartitions("path", "depth").select(*columns)
    kinds = "key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint"
    schema = f"{kinds}, {SHARD}"
    fields = [pa.field("key", pa.binary()), *[pa.field(c, pa.int64()) for c in columns[1:6]]]

    def table(held: pa.Table, number: int) -> pa.Table:
        depth = held.column("depth").to_numpy()
        found = subtrees(depth, held.column("n_children").to_numpy() == 0, held.column("saving").to_numpy())
        at = found["records"]
        rows, n_rows = held.select(columns[:6]), (len(depth), len(at), 1)
        empty = pa.table({f.name: pa.nulls(len(at) + 1, f.type) for f in fields})
        depths = np.concatenate([depth, depth[at], found["least"]])
        rows = pa.concat_tables([rows.cast(pa.schema(fields)), empty]).set_column(1, "depth", pa.array(depths))
        more = {
            "kind": pa.array(np.repeat([0, 1, 2], n_rows), pa.int32()),
            "shard": pa.array(np.full(sum(n_rows), number)),
            "least": pa.array(np.repeat(found["least"], sum(n_rows))),
            "below": pa.array(np.concatenate([depth * 0, found["below"], [0]])),
            "leaves": pa.array(np.concatenate([found["leaves"], found["record_leaves"], found["total"][:1]])),
            "saved": pa.array(np.concatenate([found["saved"], found["record_saved"], found["total"][1:]])),
            "closed": pa.array(np.concatenate([found["closed"], np.zeros(len(at) + 1, bool)])),
        }
        for name, column in more.items():
            rows = rows.append_column(name, column)
        return rows

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while size + batch.num_rows >= shard_nodes:
                take = shard_nodes - size
                yield from table(pa.Table.from_batches([*held, batch.slice(0, take)]), number).to_batches()
                number, held, size, batch = number + 1, [], 0, batch.slice(take)
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
        if size:
            yield from table(pa.Table.from_batches(held), number).to_batches()

    return rows.mapInArrow(run, schema)


def merged(found: DataFrame) -> DataFrame:
    """Nodes of all shards with the sums of their whole subtrees: ``n_leaves, saved_tokens``."""
    totals = sorted(found.filter("kind = 2").select("shard", "least", "leaves", "saved").collect())
    number = np.array([t["shard"] for t in totals], np.int64)
    least = Minima(np.array([t["least"] for t in totals], np.int64))
    before = {c: np.append(0, np.cumsum([t[c] for t in totals])).astype(np.int64) for c in ("leaves", "saved")}

    def place(batches):
        """Sums from the start of the first shard on, and the shard that closes an open node."""
        for batch in batches:
            at = np.searchsorted(number, batch.column("shard").to_numpy())
            depth = batch.column("depth").to_numpy()
            closes = least.first(at, depth) if len(at) else at
            data = {name: batch.column(name) for name in batch.schema.names}
            for c in ("leaves", "saved"):
                data[c] = pa.array(batch.column(c).to_numpy() + before[c][at])
                data[f"end_{c}"] = pa.array(np.full(batch.num_rows, before[c][-1]))
            data["closes_in"] = pa.array(closes, mask=closes >= len(number))
            data["nth"] = pa.array(at)
            yield pa.RecordBatch.from_pydict(data)

    def placed(rows, names):
        rows = rows.select(*names)
        return rows.mapInArrow(place, rows.schema.simpleString()[7:-1] + ",end_leaves:bigint,end_saved:bigint,closes_in:bigint,nth:bigint")

    columns = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children"]
    closed = found.filter("kind = 0 and closed").select(*columns, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    spine = placed(found.filter("kind = 0 and not closed"), [*columns, "shard", "leaves", "saved"])
    ends = placed(found.filter("kind = 1"), ["shard", "depth", "below", "leaves", "saved"])
    ends = ends.select(F.col("nth").alias("at"), F.col("depth").alias("from_depth"), "below", F.col("leaves").alias("to_leaves"), F.col("saved").alias("to_saved"))
    ends_here = (F.col("closes_in") == F.col("at")) & (F.col("depth") >= F.col("from_depth")) & (F.col("depth") < F.col("below"))
    spine = spine.join(ends, ends_here, "left").select(
        *columns,
        (F.coalesce("to_leaves", "end_leaves") - F.col("leaves")).alias("n_leaves"),
        (F.coalesce("to_saved", "end_saved") - F.col("saved")).alias("saved_tokens"),
    )
    return closed.unionByName(spine)


def end_digests(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """``key, ends_sha256`` for ``(key, conv_id)``: SHA-256 of the sorted ids, joined by commas.

    Ids of a node are sorted across parts and joined to pieces where they lie; only pieces go
    to the task that hashes a node, one after the other.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        part, nth, last, ids = TaskContext.get().partitionId(), 0, None, []

        def out():
            return pa.RecordBatch.from_pydict({
                "key": pa.array([last], pa.binary()), "part": pa.array([part], pa.int32()),
                "nth": pa.array([nth], pa.int64()), "ids": pa.array([",".join(map(str, ids))]),
            })

        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (key != last or len(ids) == piece_ids):
                    yield out()
                    nth, ids = nth + 1, []
                last = key
                ids.append(conv)
        if ids:
            yield out()

    def digests(batches):
        last, state = None, None
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b",")
                else:
                    if state:
                        keys.append(last)
                        sums.append(state.hexdigest())
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(sums, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([last], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    order = ["key", "conv_id"]
    found = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = save(found.mapInArrow(pieces, "key binary, part int, nth bigint, ids string"), "ends")
    found = found.repartition(n, "key").sortWithinPartitions("key", "part", "nth")
    return found.mapInArrow(digests, "key binary, ends_sha256 string")


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, digest, n_words)`` of the turns and ``(conv_id, n_turns)`` of the conversations."""
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = turn_rows(conversations).select("conv_id", "turn", "digest", words.alias("n_words"))
    rows = save(numbered(rows).drop("turn"), "ordered")
    return rows, save(rows.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conversations")


def rebuilt(rows: DataFrame, convs: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversation c with the first crc32(c) % shared turns of c - c % group in place of its own."""
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = convs.withColumns({"h": own, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    convs = match(convs, bases, ["base"], "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    convs = save(convs.select("conv_id", "base", "h", "taken", "total"), "rebuilt")
    kept = match(rows, convs.select("conv_id", "h", "taken", "total"), ["conv_id"]).filter("depth > h")
    kept = kept.withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    places = convs.filter("taken > 0").select("conv_id", "total", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("depth"))
    first = rows.filter(F.col("depth") < shared).withColumnRenamed("conv_id", "base")
    taken = match(places, first, ["base", "depth"])
    columns = ["conv_id", "depth", "digest", "n_words", (F.col("depth") == F.col("total")).alias("last")]
    return kept.select(*columns).unionByName(taken.select(*columns)), convs.select("conv_id", F.col("total").alias("n_turns"))


def trie(rows: DataFrame, convs: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Nodes of the trie of conversations ``(conv_id, n_turns)`` with turns ``(conv_id, depth, digest, n_words, last)``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and ``key``, the node's name.
    """
    turns, nodes = tree(rows)
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    # Of all conversations the driver learns their number and the smallest id.
    smallest, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    root = nodes.sparkSession.range(1 if n_convs else 0).select(
        F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(smallest).cast("long").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<binary>").alias("path"),
    )
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(smallest).cast("long")))
    nodes = nodes.select(*root.columns).unionByName(root)
    nodes = match(nodes, children, ["key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("n_words"))
    found = merged(save(shards(nodes, shard_nodes), "shards"))
    ends = turns.filter("last").select("key", "conv_id").unionByName(convs.filter("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    found = match(found, end_digests(ends), ["key"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "key"
    )


def rebuilt_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Trie of the rebuilt conversations of ``(conv_id, turn, role, text, ...)``.

    Turns are ordered by turn, null first, and turns at the same place by a digest of role and
    text; repeated rows are turns of their own. Null role and text count as empty; rows without
    conv_id are left out. A rebuilt conversation may have no turn: it ends at the root. Other columns are
    not read; an empty table has no node, not even the root.
    """
    return trie(*rebuilt(*ordered_turns(conversations)), shard_nodes)
