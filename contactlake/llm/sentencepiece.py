"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is a lattice: an edge for every vocabulary piece at every place, and for every single
character. The best path over it is found from left to right. At each place only the best
edge that ends there is kept, with the place it starts from; an edge is never longer than the
longest piece, so paths that can still win end in a window of that length. As soon as all of
them go through one boundary, the ids up to it are final, are handed out, and their part of
the window is dropped. Memory is thus bounded by the window, not by the text.

What makes a path best depends on the kind of model. For unigram models it is the sum of
piece scores. For BPE models it is that merging would leave it as it is: an edge may follow
another if merging their joined text gives just these two pieces. One edge at each place has
that property, so the path is exactly what merging the whole text yields.

A white-space mark only ever begins a piece, so the boundary before a run of marks is one that
every path goes through. Words are therefore committed one by one, and the ids of frequent
words are kept in a table of bounded size.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from contactlake.llm.byte_text import mixed

#: Where the model file is; never copied into the repository.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MAX_WORDS, MAX_PAIRS = 700_000, 400_000
#: Runs up to this length are searched side by side; texts that are taken together.
SHORT, TEXTS_AT_ONCE = 32, 1024


class Vocabulary(NamedTuple):
    pieces: dict[str, int]
    scores: list[float]
    texts: list[bytes]  # what an id stands for when decoding
    byte_ids: list[int]  # by byte, or empty
    unknown: int
    bpe: bool
    prefix: bool


def load(path: str = MODEL_FILE) -> Vocabulary:
    """Read a model file on the driver. Only models that leave the text as it is can be used."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models without normalisation are supported")
    kind = type(model.pieces[0])
    pieces, texts, byte_ids, unknown = {}, [], [], 0
    for i, p in enumerate(model.pieces):
        texts.append(b"" if p.type == kind.CONTROL else p.piece.encode())
        if p.type == kind.NORMAL:
            pieces[p.piece] = i
        elif p.type == kind.BYTE:
            byte_ids.append(i)
            texts[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == kind.UNKNOWN:
            unknown, texts[i] = i, b" \xe2\x81\x87 "
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a white-space mark behind another character")
    return Vocabulary(pieces, [p.score for p in model.pieces], texts, byte_ids, unknown, model.trainer_spec.model_type == 2, rules.add_dummy_prefix)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.pieces), default=1)
        self.floor = min(vocabulary.scores, default=0.0) - UNKNOWN_PENALTY
        self.joined = {p[i : i + 2] for p in vocabulary.pieces for i in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.slots = None
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and from the left, until none joins to a piece."""
        parts, pieces, scores = list(text), self.v.pieces, self.v.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def path(self, text: str):
        """The pieces of the best path, handed out as soon as they are final."""
        pieces, longest, bpe = self.v.pieces, self.longest, self.v.bpe
        base = 0  # all before it is handed out
        start, gain = {}, {0: 0.0}
        last = {0: ""}
        for end in range(1, len(text) + 1):
            low = max(base, end - longest)
            if bpe:
                for j in range(low, end):
                    piece = text[j:end]
                    if (j == end - 1 or piece in pieces) and (j == 0 or self.fits(last[j], piece)):
                        start[end], last[end] = j, piece
                        break
            else:
                best = None
                for j in range(low, end):
                    found = pieces.get(text[j:end])
                    if found is None and j < end - 1:
                        continue
                    total = gain[j] + (self.v.scores[found] if found is not None else self.floor)
                    if best is None or total > best:
                        best, start[end] = total, j
                gain[end] = best
            if end - base >= 4 * longest:
                # The boundaries on every path that ends within the window.
                common = None
                for tip in range(end - longest + 1, end + 1):
                    trail = set()
                    while tip > base:
                        trail.add(tip)
                        tip = start[tip]
                    common = trail if common is None else common & trail
                if common:
                    new = max(common)
                    yield from self._between(text, start, base, new)
                    for k in range(base, new):
                        start.pop(k, None), gain.pop(k, None), last.pop(k, None)
                    base = new
        yield from self._between(text, start, base, len(text))

    @staticmethod
    def _between(text: str, start, base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(text[start[end] : end])
            end = start[end]
        return out[::-1]

    def ids(self, text: str) -> bytes:
        """Ids, four bytes each, of a text that no path can leave a piece over its ends."""
        out = array("i")
        for piece in self.path(text):
            found = self.v.pieces.get(piece)
            if found is not None:
                out.append(found)
            elif self.v.byte_ids:
                out.extend(self.v.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.v.unknown)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of one text, four bytes each."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, four bytes each. Words are keyed without the mark before them."""
        split = [text.replace(SPACE, " ").split(" ") for text in texts]
        met = set().union(*split)
        met.discard("")
        fresh = met - self.words.keys()
        if len(self.words) + len(fresh) > MAX_WORDS:
            # Words met since the last change are kept for one more, so that frequent ones stay.
            self.before, self.words = self.words, {}
            fresh = met
        known = {part: self.before[part] for part in fresh & self.before.keys()}
        self.words.update(known)
        self.words.update(self._words(list(fresh - known.keys())))
        out = []
        for text, parts in zip(texts, split):
            if not text:
                out.append(b"")
            elif not self.v.prefix:
                out.append((self.ids(parts[0]) if parts[0] else b"") + self._marked(parts[1:]))
            else:
                out.append(self._marked(parts))
        return out

    def _marked(self, parts: list[str]) -> bytes:
        """Ids of parts with a mark before each."""
        get = self.words.get
        if "" not in parts:
            return b"".join(map(get, parts))
        out, marks = [], 0
        for part in parts:
            marks += 1
            if part:
                out.append(self.ids(SPACE * marks + part) if marks > 1 else get(part))
                marks = 0
        if marks:
            out.append(self.ids(SPACE * marks))
        return b"".join(out)

    def _words(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of words: the runs between boundaries that no piece spans are committed one by one."""
        plain = [part for part in parts if part.isalpha()]
        other = [part for part in parts if not part.isalpha()]
        texts = [SPACE + part for part in plain]
        runs = [self._runs(SPACE + part) for part in other]
        need = set(texts).union(*runs)
        known = self._together([r for r in need if len(r) <= SHORT]) if self.v.bpe else {}
        for run in need - known.keys():
            known[run] = self.ids(run)
        out = dict(zip(plain, map(known.__getitem__, texts)))
        for part, own in zip(other, runs):
            out[part] = b"".join(map(known.__getitem__, own))
        return out

    def _runs(self, text: str) -> list[str]:
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def _tables(self) -> None:
        """Pieces by the hash of their text, in two tables so that collisions find a place."""
        names = list(self.v.pieces)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(SHORT, self.base)))
        hashes = np.zeros(len(names), np.uint64)
        for i, name in enumerate(names):
            value = 0
            for c in name:
                value = (value * int(self.base) + ord(c)) & (1 << 64) - 1
            hashes[i] = value
        self.hash_of = np.zeros(len(self.v.scores) + 1, np.uint64)
        ids = np.array([self.v.pieces[n] for n in names], np.int32)
        self.hash_of[ids] = hashes
        self.slots = []
        for shift in (42, 20):
            table = np.full(1 << 22, -1, np.int32)
            slot = ((mixed(hashes) >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.int64)
            table[slot] = ids
            self.slots.append((shift, table))
            left = table[slot] != ids
            hashes, ids = hashes[left], ids[left]
        self.rest = dict(zip(hashes.tolist(), ids.tolist()))
        if self.rest:
            raise ValueError("two pieces have one place in both tables")
        self.pair_keys = np.full(1 << 22, -1, np.int64)
        self.pair_fits = np.zeros(1 << 22, bool)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        spread = mixed(hashes)
        out = np.full(len(hashes), -1, np.int32)
        for shift, table in self.slots:
            found = table[((spread >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.int64)]
            good = (found >= 0) & (self.hash_of[found] == hashes)
            out[good] = found[good]
        return out

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for pairs of ids; single characters without a piece follow behind the ids."""
        key = left.astype(np.int64) << 21 | right
        slot = (mixed(key.view(np.uint64)) >> np.uint64(42)).astype(np.int64)
        good = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            good = good.copy()
            unique, back = np.unique(key[new], return_inverse=True)
            fits = np.array([self.fits(self._text(k >> 21), self._text(k & (1 << 21) - 1)) for k in unique.tolist()])
            good[new] = fits[back]
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], good[new]
        return good

    def _text(self, number: int) -> str:
        n = len(self.v.scores)
        return self.v.texts[number].decode() if number < n else chr(number - n)

    def _together(self, runs: list[str]) -> dict[str, bytes]:
        """The best paths of many short runs, those of one length side by side."""
        if self.slots is None:
            self._tables()
        n_ids, out = len(self.v.scores), {}
        runs.sort(key=len)
        for size, group in itertools.groupby(runs, len):
            for at in itertools.batched(group, 20_000):
                codes = np.frombuffer("".join(at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size)
                prefix = np.zeros((size + 1, len(at)), np.uint64)
                for i in range(size):
                    prefix[i + 1] = prefix[i] * self.base + codes[:, i]
                last = np.zeros((size + 1, len(at)), np.int32)
                start = np.zeros((size + 1, len(at)), np.int8)
                for end in range(1, size + 1):
                    rows = np.arange(len(at))
                    for j in range(max(0, end - self.longest), end):
                        found = self._find(prefix[end, rows] - prefix[j, rows] * self.powers[end - j])
                        if j == end - 1:
                            found = np.where(found < 0, n_ids + codes[rows, j].astype(np.int32), found)
                        good = found >= 0
                        if j:
                            some = np.flatnonzero(good)
                            good[some] = self._fit(last[j, rows[some]], found[some])
                        last[end, rows[good]] = found[good]
                        start[end, rows[good]] = j
                        rows = rows[~good]
                        if not len(rows):
                            break
                ids = np.zeros((len(at), size), np.int32)
                tip, count, each = np.full(len(at), size), np.zeros(len(at), np.int64), np.arange(len(at))
                while (on := np.flatnonzero(tip)).size:
                    count[on] += 1
                    ids[on, size - count[on]] = last[tip[on], each[on]]
                    tip[on] = start[tip[on], on]
                odd = (ids >= n_ids).any(1)
                raw, width = ids.tobytes(), 4 * size
                for i, (run, n) in enumerate(zip(at, count.tolist())):
                    out[run] = self.ids(run) if odd[i] else raw[(i + 1) * width - 4 * n : (i + 1) * width]
        return out


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of ``ids``; bytes that are not UTF-8 become replacement characters."""
    raw = b"".join(map(vocabulary.texts.__getitem__, ids))
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker, so that its tables serve all tasks."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared(NamedTuple):
    id: str
    broadcast: object

    @property
    def value(self):
        return self.broadcast.value


def _share(frame: DataFrame, vocabulary: Vocabulary) -> _Shared:
    # A vocabulary has a fixed size, some hundred kilobytes.
    return _Shared(uuid.uuid4().hex, frame.sparkSession.sparkContext.broadcast(vocabulary))


def encode(docs: DataFrame, vocabulary: Vocabulary, check: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of a column of that name, one row for each row.

    Null and empty texts have no ids. Nothing is cut and nothing moves between tasks. With
    ``check``, ``round_trip`` says whether decoding gives the text back; a white-space mark
    that stands in a text as a character counts as the space that it is encoded as.
    """
    shared = _share(docs, vocabulary)
    added = ["ids", "round_trip"] if check else ["ids"]
    columns = [c for c in docs.columns if c not in added]

    def run(batches):
        encoder = _encoder(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                texts = [text or "" for text in batch.column("text").to_pylist()]
                coded = encoder.encode_all(texts)
                ends = np.cumsum([0, *map(len, coded)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                more = [ids]
                if check:
                    back = [decode(memoryview(c).cast("i"), encoder.v) for c in coded]
                    more.append(pa.array([x == y.replace(SPACE, " ") for x, y in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, *added])

    frame = docs.select(*columns)
    kinds = [StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    return frame.mapInArrow(run, StructType([*frame.schema.fields, *kinds[: len(added)]]))


def decode_ids(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with ``decoded`` for its column ``ids``; null ids give an empty text."""
    shared = _share(rows, vocabulary)
    columns = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = [decode(x or (), own) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "decoded"])

    frame = rows.select(*columns)
    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("decoded", StringType())]))
