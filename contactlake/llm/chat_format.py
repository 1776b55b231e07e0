"""Conversations in a chat template, shared beginnings written once.

All conversations are merged into a tree of turns. Its nodes are written depth first into one
stream of tokens, so what conversations share at their start stands there once. A node's row
says where it starts in the stream, which position its first token has in a conversation, and
which earlier stretches of the stream its tokens attend to besides their own node: one for each
run of turns without a branch between the root and the node.

The template marks turns by control strings, which have token ids of their own. Control strings
that occur in texts or roles are broken up by a backslash behind their first character, and
backslashes are doubled; both are undone when reading. Only the text of assistant turns is under
the loss mask.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import match, save
from contactlake.llm.turn_tree import numbered, tree, turn_rows

#: Where the ranks of the tokens are; never copied into the repository.
MODEL_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the model's vocabulary expects text to be cut.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
TEXT_START, TEXT_END, ASKED, ASKED_END, ROLE, ROLE_END = range(len(CONTROL))
#: Longer texts are encoded in stretches of this many characters.
STRETCH = 1 << 20
ROWS_AT_ONCE = 64

_BREAK = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])")
_SEGMENT = re.compile(r"(?s)\[INST\](.*)\[/INST\]|(?:\[ROLE\](.*?)\[/ROLE\])?<s>(.*)</s>")


def escape(text: str) -> str:
    """``text`` without control strings; see ``unescape``."""
    return _BREAK.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def load(path: str = MODEL_FILE) -> dict[bytes, int]:
    """Read the ranks on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Coder:
    """Tokens of segments and back; control strings have the ids behind the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.own = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def text(self, text: str) -> list[int]:
        text = escape(text)
        if len(text) <= STRETCH:
            return self.own.encode_ordinary(text)
        return [t for i in range(0, len(text), STRETCH) for t in self.own.encode_ordinary(text[i : i + STRETCH])]

    def segment(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Tokens of a turn, and from where to where the loss mask reaches."""
        mark, body = self.first, self.text(text)
        if role == "user":
            return [mark + ASKED, *body, mark + ASKED_END], 0, 0
        if role == "assistant":
            return [mark + TEXT_START, *body, mark + TEXT_END], 1, 1 + len(body)
        return [mark + ROLE, *self.text(role), mark + ROLE_END, mark + TEXT_START, *body, mark + TEXT_END], 0, 0

    def read(self, tokens: list[int]) -> str:
        """The formatted text of tokens."""
        out, held = [], []
        for token in tokens:
            if token < self.first:
                held.append(token)
            else:
                out += [self.own.decode_bytes(held), CONTROL[token - self.first].encode()]
                held = []
        return b"".join([*out, self.own.decode_bytes(held)]).decode("utf-8", "surrogateescape")


_coders: dict[str, Coder] = {}


def coder_of(name: str, ranks) -> Coder:
    """The coder of broadcast ``ranks``, made once in a worker process."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(ranks.value)
    return _coders[name]


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: texts and tokens take far more room as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def turn_of(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    asked, role, said = _SEGMENT.fullmatch(formatted).groups()
    if asked is not None:
        return "user", unescape(asked)
    return ("assistant" if role is None else unescape(role)), unescape(said)


class Formatted(NamedTuple):
    stream: DataFrame  # start, position, n_tokens, tokens, loss_from, loss_to, run_start, attend, depth
    ends: DataFrame  # conv_id, start (of the conversation's last turn)


def segments(nodes: DataFrame, turns: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``key, tokens, n_tokens, loss_from, loss_to`` of the nodes, from one row with their turn."""
    texts = turns.select("conv_id", "digest", "role", "text").dropDuplicates(["conv_id", "digest"])
    rows = match(nodes.select("key", "conv_id", "digest"), texts, ["conv_id", "digest"]).select("key", "role", "text")
    shared = nodes.sparkSession.sparkContext.broadcast(ranks)
    name = uuid.uuid4().hex

    def run(batches):
        coder = coder_of(name, shared)
        for batch in few_rows(batches):
            made = [coder.segment(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "tokens": pa.array([m[0] for m in made], pa.list_(pa.int32())),
                "n_tokens": pa.array([len(m[0]) for m in made], pa.int64()),
                "loss_from": pa.array([m[1] for m in made], pa.int64()), "loss_to": pa.array([m[2] for m in made], pa.int64()),
            })

    return rows.mapInArrow(run, "key binary, tokens array<int>, n_tokens bigint, loss_from bigint, loss_to bigint")


def starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the number of tokens before a node in depth-first order.

    Nodes are put in order across parts; a part sums up its own, and the driver adds up one number a part.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = save(rows.repartitionByRange(n, "path", "depth").withColumn("part", F.spark_partition_id()), "order")
    before, offsets = 0, []
    for part, total in sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        offsets.append((part, before))
        before += total
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint"))
    here = F.expr("sum(n_tokens) OVER (PARTITION BY part ORDER BY path, depth ROWS UNBOUNDED PRECEDING)")
    rows = rows.withColumn("up_to", here).join(offsets, "part")
    return rows.withColumn("start", F.col("offset") + F.col("up_to") - F.col("n_tokens")).drop("part", "up_to", "offset")


def stretches(rows: DataFrame) -> DataFrame:
    """``run, run_start, above, base``: what the nodes of a run attend to before it, and how many tokens that is."""
    runs = rows.groupBy("path").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("n_tokens")).alias("to"))
    runs = save(runs.withColumn("run", F.element_at("path", -1)), "runs")
    higher = runs.select("run", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("higher"))
    higher = match(higher, runs.select(F.col("run").alias("higher"), "from", "to"), ["higher"])
    higher = higher.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("above"), F.sum(F.col("to") - F.col("from")).alias("base"))
    found = match(runs.select("run", F.col("from").alias("run_start")), higher, ["run"], "left")
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return found.withColumns({"above": F.coalesce("above", none), "base": F.coalesce("base", F.lit(0).cast("long"))})


def format_conversations(conversations: DataFrame, ranks: dict[bytes, int]) -> Formatted:
    """The token stream of conversations ``(conv_id, turn, role, text, ...)`` and where they end.

    ``stream`` has a row for every distinct beginning: ``start`` in the stream, ``position`` of its
    first token in a conversation, ``tokens``, the part ``loss_from`` to ``loss_to`` of them that is under the
    loss mask, and ``attend``, the stretches of the stream (from, to) that its tokens see besides
    those before them in the row. ``run_start`` is where the run of turns without a branch begins that it belongs to.

    Turns are ordered by turn, null first, and turns at the same place by a digest of role and
    text; repeated rows are turns of their own. Null role and text count as empty; rows without
    conv_id are left out. Long texts are written whole. Other columns are not read; an empty table gives empty tables.
    """
    turns = turn_rows(conversations)
    names, nodes = tree(numbered(turns.select("conv_id", "turn", "digest")).drop("turn"))
    written = save(segments(nodes, turns, ranks), "segments")
    rows = match(nodes.select("key", "path", "depth"), written.select("key", "n_tokens"), ["key"])
    rows = save(starts(rows), "layout")
    rows = match(rows.withColumn("run", F.element_at("path", -1)).drop("path"), stretches(rows), ["run"])
    own = F.when(F.col("start") > F.col("run_start"), F.array(F.struct(F.col("run_start").alias("from"), F.col("start").alias("to"))))
    rows = rows.select(
        "key", "start", (F.col("base") + F.col("start") - F.col("run_start")).alias("position"), "run_start",
        F.concat("above", F.coalesce(own, F.array().cast("array<struct<from:bigint,to:bigint>>"))).alias("attend"), "depth",
    )
    stream = save(match(written, rows, ["key"]), "stream")
    ends = names.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    return Formatted(stream.drop("key"), match(ends, stream.select("key", "start"), ["key"]).select("conv_id", "start"))


def read_back(formatted: Formatted, ranks: dict[bytes, int]) -> DataFrame:
    """Digests of every conversation, from the tokens its last turn attends to.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Each distinct conversation
    is read once, turn by turn, whatever its length.
    """
    stream, ends = formatted
    spark = stream.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = save(ends, "last_turns")
    last = match(stream.select("start", "n_tokens", "run_start", "attend"), ends.select("start").distinct(), ["start"])
    earlier = F.filter("attend", lambda a: a["from"] < F.col("run_start"))
    own = F.array(F.struct(F.col("run_start").alias("from"), (F.col("start") + F.col("n_tokens")).alias("to")))
    seen = last.select(F.col("start").alias("end"), F.explode(F.concat(earlier, own)).alias("seen"))
    seen = seen.select("end", F.struct(F.col("seen.from").alias("run")).alias("run"), F.col("seen.to").alias("to"))
    # The narrow side stands on the right: a join holds the rows of one key of that side.
    rows = stream.select(F.struct(F.col("run_start").alias("run")).alias("run"), "start", "tokens", "loss_from", "loss_to")
    rows = rows.join(seen, "run").filter("start < to").select("end", "start", "tokens", "loss_from", "loss_to")
    rows = rows.repartition(n, "end").sortWithinPartitions("end", "start")
    shared, name = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex
    names = ["end", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        coder, end, state = coder_of(name, shared), None, None

        def finished():
            n_turns, turns, loss_chars, loss, chars = state
            return dict(zip(names, (end, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)))

        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))
        for batch in few_rows(batches):
            out = []
            for row in batch.to_pylist():
                if row["end"] != end:
                    if state:
                        out.append(finished())
                    end, state = row["end"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = coder.read(row["tokens"])
                role, said = turn_of(text)
                learned = unescape(coder.read(row["tokens"][row["loss_from"] : row["loss_to"]]))
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogateescape"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogateescape"))
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state:
            yield pa.RecordBatch.from_pylist([finished()], schema)

    kinds = "end bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    found = rows.mapInArrow(run, kinds).withColumnRenamed("end", "start")
    return match(ends, found, ["start"]).drop("start")
