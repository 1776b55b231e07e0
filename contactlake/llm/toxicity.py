"""Toxicity by multiple-instance learning.

A document is a bag of sentences and has one label for all of them. A sentence with the
distinct words x scores p = sigmoid(bias + sum of the words' weights); the document's score
is the noisy-or 1 - prod(1 - p) of its sentences, so that one offending sentence is enough.
Bias and weights are fitted to document labels by gradient steps on the log loss with a
penalty that sets the weights of uninformative words to zero; the words left are fitted again
almost without one. How strict the penalty is, a kept-back part of the sample decides. The same
sentence scores then say where the offence is.

Fitting happens on the driver, on a sample with fixed bounds (documents a class and words in
all), drawn by a hash of the id and cut to whole texts in that order. Scoring reads every whole text where it lies, moves nothing
and keeps nothing of one document for the next.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample.
MAX_DOCS_A_CLASS = 4000
MAX_WORDS = 3_000_000
MIN_DOCS = 6
#: Tried in this order; the share of the sample that they are tried on.
PENALTIES = (2e-4, 4e-4)
LIGHT_PENALTY = 5e-5
KEPT_BACK = 4
TEXTS_AT_ONCE = 64
STEPS = 250

_SENTENCE_END = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences that are not blank, as code points of ``text``."""
    spans, start = [], 0
    for end in _SENTENCE_END.finditer(text):
        spans.append((start, end.start()))
        start = end.end()
    spans.append((start, len(text)))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def learned(doc_id) -> F.Column:
    """Whether labels of this document may be learned from."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def taken(sizes: list[int], most: int) -> list[int]:
    """Places of the whole texts of one class that ``most`` characters hold, for sizes in the order of the draw.

    Texts over a sixteenth of ``most`` have half of it to themselves, so that neither they nor
    the others use up all; what the others leave is theirs too. The others are taken up to
    the first that does not fit. Where nothing fits, the shortest text stands for the class.
    """
    ordinary = [i for i, n in enumerate(sizes) if n * 16 <= most]
    long = [i for i, n in enumerate(sizes) if n * 16 > most]
    out, used = [], 0

    def fill(places: list[int], limit: int) -> None:
        nonlocal used
        for i in places:
            if used + sizes[i] <= limit:
                out.append(i)
                used += sizes[i]

    fill(long, most // 2)
    for i in ordinary:
        if used + sizes[i] > most:
            break
        out.append(i)
        used += sizes[i]
    else:
        fill([i for i in long if i not in out], most)
    return sorted(out) or sorted(range(len(sizes)), key=sizes.__getitem__)[:1]


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_words: int):
    """Texts, labels and the labelled rows of each class, within the bounds of the module.

    A class draws its ids by a hash and keeps those whose texts fit its part of the words:
    one half, or more where the other class needs less. Where rows lie does not matter.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(learned(F.col("doc_id")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_docs) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1]).withColumn("draw", order)
    rows = docs.filter("text is not null").select("doc_id", "text")
    # Rows that repeat an id count as one text. At most max_docs ids a class come to the driver.
    lengths = rows.join(F.broadcast(chosen), "doc_id").groupBy("toxic", "draw", "doc_id").agg(F.sum(F.length("text")).alias("size"))
    lengths = sorted(lengths.collect())
    classes = [[r for r in lengths if r["toxic"] == y] for y in (0, 1)]
    weights = [sum(r["size"] for r in c) for c in classes]
    most = [max(4 * max_words // 2, 4 * max_words - w) for w in reversed(weights)]
    ids = [c[i]["doc_id"] for c, m in zip(classes, most) for i in taken([r["size"] for r in c], m)]
    wanted = chosen.sparkSession.createDataFrame([(i,) for i in ids], labels.select("doc_id").schema)
    marks = {r["doc_id"]: r["toxic"] for r in lengths}
    # Exactly the rows counted above.
    found = sorted(rows.join(F.broadcast(wanted), "doc_id").collect())
    return [r["text"] for r in found], np.array([marks[r["doc_id"]] for r in found], np.int64), sizes


def train(bags: list[list[set[str]]], marks: np.ndarray, sizes: dict[int, int], penalty: float) -> Model:
    """Bias and weights for documents as bags of sentences; classes weigh as many rows as ``sizes`` says.

    The penalty chooses the words; their weights are then fitted under ``LIGHT_PENALTY`` alone,
    so that a strict choice does not make the chosen words weak.
    """
    seen = Counter(w for bag in bags for w in set().union(*bag))
    chosen = descend(bags, marks, sizes, sorted(w for w, n in seen.items() if n >= MIN_DOCS), penalty)
    return descend(bags, marks, sizes, sorted(chosen.weights), LIGHT_PENALTY) if penalty > LIGHT_PENALTY else chosen


def descend(bags: list[list[set[str]]], marks: np.ndarray, sizes: dict[int, int], names: list[str], penalty: float) -> Model:
    place = {w: i for i, w in enumerate(names)}
    ids, counts, parts = [], [], []
    for bag in bags:
        parts.append(len(bag))
        for s in bag:
            own = [place[w] for w in s if w in place]
            ids.extend(own)
            counts.append(len(own))
    ids, counts = np.array(ids, np.int64), np.array(counts)
    sentence = np.repeat(np.arange(len(counts)), counts)
    starts = np.concatenate([[0], np.cumsum(parts)[:-1]])
    owner = np.repeat(np.arange(len(bags)), parts)
    drawn = np.bincount(marks, minlength=2)
    share = np.array([sizes[0], sizes[1]]) / drawn
    importance = share[marks] / share[marks].sum()
    w, bias = np.zeros(len(names)), float(np.log(0.02 / (1 + np.mean(parts))))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, w[ids], len(counts))
        soft = np.logaddexp(0, z)
        total = np.maximum(np.add.reduceat(soft, starts), 1e-12)
        pull = np.where(marks == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) * importance
        g = pull[owner] * np.exp(z - soft)
        grad = np.append(np.bincount(ids, g[sentence], len(names)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = 0.15 / (1 + step / 100)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        scale = rate / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-7)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - penalty * scale, 0)
        bias -= move[-1]
    return Model(float(bias), {n: float(x) for n, x in zip(names, w) if x})


def bag_loss(model: Model, bags: list[list[set[str]]], marks: np.ndarray, sizes: dict[int, int]) -> float:
    """Mean log loss over the documents, the classes weighed as in training."""
    weights, drawn = model.weights, np.bincount(marks, minlength=2)
    loss = np.zeros(2)
    for bag, mark in zip(bags, marks):
        total = sum(np.logaddexp(0, model.bias + sum(weights.get(w, 0.0) for w in s)) for s in bag)
        loss[mark] += total if mark == 0 else -np.log(-np.expm1(-max(total, 1e-12)))
    return float((loss / np.maximum(drawn, 1) * [sizes[0], sizes[1]]).sum() / (sizes[0] + sizes[1]))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS_A_CLASS, max_words: int = MAX_WORDS) -> Model:
    """Fit to ``labels`` (``doc_id``, ``toxic``). Without rows of both classes nothing is toxic.

    The penalty is the one of ``PENALTIES`` that does best on every fourth document of the sample
    when fitted to the others; with it the model is fitted to all. Small samples keep none back.
    """
    texts, marks, sizes = sample(docs, labels, max_docs, max_words)
    if len(set(marks.tolist())) < 2:
        return Model(-40.0, {})
    # A word counts once a sentence; words of few documents are left out.
    bags = [[set(_LETTERS.findall(t[a:b].lower())) for a, b in sentences(t)] or [set()] for t in texts]
    nth = np.empty(len(marks), np.int64)
    for y in (0, 1):
        nth[marks == y] = np.arange((marks == y).sum())
    back = nth % KEPT_BACK == KEPT_BACK - 1
    if np.bincount(marks[back], minlength=2).min() < 10:
        return train(bags, marks, sizes, PENALTIES[0])
    chosen = lambda on: ([b for b, x in zip(bags, on) if x], marks[on], sizes)
    losses = [bag_loss(train(*chosen(~back), p), *chosen(back)) for p in PENALTIES]
    return train(bags, marks, sizes, PENALTIES[int(np.argmin(losses))])


def scored(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score, and start, end and score of its offending sentences."""
    weights, bias = model.weights, model.bias
    total, found = 0.0, []
    plain = np.logaddexp(0, bias)
    text = text or ""
    for start, end in sentences(text):
        known = [weights[w] for w in set(_LETTERS.findall(text[start:end].lower())) if w in weights]
        if known:
            z = bias + sum(known)
            total += np.logaddexp(0, z)
            if z >= 0:
                found.append((start, end, float(1 / (1 + np.exp(-z)))))
        else:
            total += plain
    return float(-np.expm1(-total)), found


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, few of them as Python objects at a time."""
    for at in range(0, len(column), TEXTS_AT_ONCE):
        yield from column.slice(at, TEXTS_AT_ONCE).to_pylist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``offending`` (start, end, score of sentences at 0.5 or more).

    One row for each row of ``docs``. Null and empty texts have the score 0; ends count code
    points of the text; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        fitted = shared.value
        for batch in batches:
            rows = [scored(t, fitted) for t in texts_of(batch.column("text"))]
            spans = [[dict(zip(("start", "end", "score"), s)) for s in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), pa.array(spans, span)],
                names=["doc_id", "score", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents scored under ``threshold``, all columns, in one pass over the rows.

    Null and empty texts score 0 and stay; repeated rows are judged each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only the texts go to Python, and only the decisions come back.
    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        fitted = shared.value
        return pa.array([scored(t, fitted)[0] < threshold for t in texts_of(texts)], pa.bool_())

    return docs.filter(stays("text"))
