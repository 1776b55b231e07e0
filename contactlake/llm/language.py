"""Language identification with string kernels.

Two texts are as alike as the n-grams they share: the blended spectrum kernel of presence
counts the distinct character n-grams, for n from 1 to 3, that stand in both, divided by the
root of the product of their numbers. A bounded sample of texts is mapped to its kernels with a
few landmark texts (Nystroem), and for each language ridge regression tells it from the rest
in that space. A text's scores are linear in its kernels with the landmarks, and these are
products of its n-grams' presence with the landmarks' presence: many texts are scored by
one product of matrices.

N-grams are kept as slots of a table of fixed size, so that a text is a bit vector. Every language is
learned: the more there are, the fewer texts and landmarks each gets, down to a minimum, so that
the sample on the driver is bounded up to 768 languages and grows with them beyond. Scoring moves
nothing and reads every whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import byte_text

SLOT_BITS = 15
MAX_N = 3
#: Bounds of the sample: texts and landmarks a language, for up to so many languages.
MAX_TEXTS, FULL_LANGUAGES, LANDMARKS = 400, 64, 24
#: Where there are more, each gets fewer of both, but not less than this.
MIN_TEXTS, MIN_LANDMARKS = 16, 2
RIDGE = 1e-2
UNKNOWN = "und"
#: Characters of texts whose presence table is made at once.
TEXTS_AT_ONCE = 64

_LETTER_SQL = r"\p{L}"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # by slot and language
    offset: np.ndarray


def has_letter(text: str) -> bool:
    """Whether a letter stands in it; digits, numerals such as ½ or Ⅷ and marks are none."""
    return any(map(str.isalpha, text))


def learned(doc_id) -> F.Column:
    """Whether this document may be learned from."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def presence(texts: list[str]) -> np.ndarray:
    """Which n-grams stand in each text, a row of 0 and 1 for each; case and digits do not count."""
    out = np.zeros((len(texts), 1 << SLOT_BITS), np.float32)
    for row, text in zip(out, texts):
        # A long text is taken in stretches; n-grams over their borders are taken with the next.
        for at in range(0, max(len(text), 1), 1 << 18):
            part = text[max(0, at - MAX_N + 1) : at + (1 << 18)].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            h = np.zeros(len(codes), np.uint64)
            for n in range(1, MAX_N + 1):
                if len(codes) < n:
                    break
                h = h[: len(codes) - n + 1] * byte_text.BASE + codes[n - 1 :] + np.uint64(n)
                row[byte_text.mixed(h) >> np.uint64(64 - SLOT_BITS)] = 1
    return out


def each(most: int, least: int, languages: int) -> int:
    """How many of ``most`` a language gets where there are so many languages."""
    return min(most, max(least, most * FULL_LANGUAGES // max(languages, 1)))


def sample(docs: DataFrame, max_texts: int) -> tuple[np.ndarray, list[str]]:
    """Presence of the n-grams of learned texts, up to a number for each language, by a hash of the id."""
    docs = docs.filter("doc_id is not null and text is not null and lang is not null").filter(learned(F.col("doc_id")))
    docs = docs.filter(F.col("text").rlike(_LETTER_SQL))
    names = docs.groupBy("lang").count().collect()
    if not names:
        return np.zeros((0, (1 << SLOT_BITS) // 8), np.uint8), []
    max_texts = each(max_texts, MIN_TEXTS, len(names))
    # More than are wanted, so that none of many languages comes out with too few.
    draws = max(1.2 * max_texts, max_texts + 4 * max_texts**0.5 + 8)
    rates = [(r["lang"], int((1 << 30) * min(1.0, draws / r["count"])) + 1) for r in names]
    rates = docs.sparkSession.createDataFrame(rates, "lang string, rate long")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column("text").to_pylist()
                bits = np.packbits(presence(texts).astype(np.uint8), axis=1)
                good = [has_letter(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("draw"), part.column("doc_id"), pa.array([b.tobytes() if g else None for b, g in zip(bits, good)], pa.binary())],
                    names=["lang", "draw", "doc_id", "bits"],
                )

    drawn = docs.withColumn("draw", draw).join(F.broadcast(rates), "lang").filter("draw < rate")
    drawn = drawn.select("lang", "draw", F.col("doc_id").cast("long"), "text")
    rows = drawn.mapInArrow(run, "lang string, draw long, doc_id long, bits binary").filter("bits is not null")
    taken: dict[str, int] = {}
    bits, langs = [], []
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["bits"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= max_texts:
            bits.append(np.frombuffer(r["bits"], np.uint8))
            langs.append(r["lang"])
    return np.array(bits, np.uint8).reshape(len(bits), (1 << SLOT_BITS) // 8), langs


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS) -> Model:
    """Fit to ``docs`` (``doc_id``, ``text``, ``lang``). Without learned texts all is unknown."""
    bits, langs = sample(docs, max_texts)
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << SLOT_BITS, 0), np.float32), np.zeros(0))
    place = {x: k for k, x in enumerate(languages)}
    kind = np.array([place[x] for x in langs])
    n_marks = each(LANDMARKS, MIN_LANDMARKS, len(languages))
    starts = np.searchsorted(kind, np.arange(len(languages) + 1))  # texts come language by language
    marks = np.concatenate([np.arange(a, min(a + n_marks, b)) for a, b in zip(starts[:-1], starts[1:])])
    landmarks = np.unpackbits(bits[marks], axis=1).astype(np.float32)
    landmarks /= np.sqrt(landmarks.sum(1, keepdims=True))

    def kernels(which: np.ndarray) -> np.ndarray:
        rows = np.unpackbits(bits[which], axis=1).astype(np.float32)
        return (rows @ landmarks.T / np.sqrt(rows.sum(1, keepdims=True))).astype(np.float64)

    blocks = lambda places: (places[at : at + 256] for at in range(0, len(places), 256))
    # The kernels among landmarks whiten the map; directions without weight are left out.
    size, vectors = np.linalg.eigh(np.concatenate([kernels(x) for x in blocks(marks)]))
    keep = size > 1e-6 * size[-1]
    whiten = vectors[:, keep] / np.sqrt(size[keep])
    share = 1 / np.bincount(kind, minlength=len(languages))[kind]  # languages count alike
    share /= share.sum()
    level = np.bincount(kind, share, len(languages))
    # Sums over the texts, block by block: the kernels of all of them never lie in memory.
    centre, by_language = np.zeros(whiten.shape[1]), np.zeros((whiten.shape[1], len(languages)))
    ridge = RIDGE / len(bits) * np.eye(whiten.shape[1])
    for which in blocks(np.arange(len(bits))):
        features = kernels(which) @ whiten
        moved = features * share[which, None]
        centre += moved.sum(0)
        ridge += moved.T @ features
        np.add.at(by_language.T, kind[which], moved)
    ridge -= np.outer(centre, centre)
    beta = np.linalg.solve(ridge, by_language - np.outer(centre, level))
    return Model(languages, (landmarks.T @ (whiten @ beta)).astype(np.float32), level - centre @ beta)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``, one row for each row of ``docs``.

    The score is the winner's regression value, kept to [0, 1]; ties go to the first name.
    ``und`` with score 0 where the text is null or has no letter. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = [bool(own.languages) and has_letter(t) for t in texts]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if any(known):
                    rows = presence(texts)
                    values = rows @ own.weights / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)) + own.offset
                    best = values.argmax(1)
                    names = [own.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    scores = np.where(known, np.clip(values.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
