"""Mixing, toxicity, SentencePiece, language and main text."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactlake.llm import language, main_text, mixing, sentencepiece, toxicity

# --- mixing ------------------------------------------------------------------
SIZES = {"big": 60, "mid": 12, "small": 4, None: 6}


@pytest.fixture
def sources(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), s) for k, (s, n) in enumerate(SIZES.items(), 1) for i in range(1000 * k, 1000 * k + n)]
    rows += [(1, "", "empty"), (2, None, "empty"), (3, None, "big"), (3, None, "big")]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, block int, mix_source string")


def by_source(frame):
    out = collections.defaultdict(lambda: [0, 0, 0, set()])
    for r in frame.collect():
        t = out[r.source]
        t[0], t[1], t[2] = t[0] + r.n_tokens, t[1] + 1, t[2] + r.n_tokens * r.n_copies
        t[3].add(r.weight)
    return out


@pytest.mark.parametrize("target, passes, ratio", [(0.95, 4.0, 1.0), (0.8, 1.2, 1.0), (1.0, 100.0, 3.0), (0.0, 2.0, 0.4)])
@pytest.mark.parametrize("block", [65536, 20])
def test_mixture(sources, target, passes, ratio, block):
    mixed = mixing.mix_sources(sources, target, passes, ratio, block_tokens=block)
    assert mixed.count() == sources.count()
    found = by_source(mixed)
    total = sum(t[0] for t in found.values())
    shares = {s: t[0] / total for s, t in found.items() if t[0]}

    def weights(a):
        raw = {s: p**a for s, p in shares.items()}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def most(a):
        return max(ratio * weights(a)[s] / p for s, p in shares.items())

    # plain bisection by halves
    def last(holds, low, high):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    a = 1.0 if entropy(1) >= target * math.log(len(shares)) else last(lambda x: entropy(x) >= target * math.log(len(shares)), 0, 1)
    if most(a) > passes:
        a = 1.0 if most(1) > passes else 1 - last(lambda x: most(1 - x) <= passes, 0, 1 - a)
    want = weights(a)
    longest = max(r.n_tokens for r in mixed.select("n_tokens").collect())
    for s, (tokens, _, taken, weight) in found.items():
        assert len(weight) == 1
        if tokens:
            assert weight.pop() == pytest.approx(want[s], abs=1e-6)
            assert -longest - 1 <= taken - want[s] * total * ratio <= 1
        else:
            assert taken == 0


def test_mixture_is_a_permutation_prefix(sources):
    """More budget only adds documents, and the outcome does not depend on partitions."""
    few, more = (mixing.mix_sources(sources.filter("source = 'big'"), budget_ratio=b) for b in (0.3, 0.7))
    few, more = ({r.doc_id: r.n_copies for r in f.collect()} for f in (few, more))
    assert all(n <= more[d] for d, n in few.items()) and 0 < sum(few.values()) < sum(more.values())
    again = mixing.mix_sources(sources.repartition(7)).select("doc_id", "source", "n_copies")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixing.mix_sources(sources).select("doc_id", "source", "n_copies").collect()))


def test_mixture_of_nothing_and_realised(sources):
    assert mixing.mix_sources(sources.limit(0)).count() == 0
    rows = mixing.realise(sources)
    assert rows.columns == sources.columns
    copies = {r.doc_id: r.n_copies for r in mixing.mix_sources(sources).filter("text is not null and source <> 'empty'").collect()}
    got = collections.Counter(r.doc_id for r in rows.filter("text is not null").collect())
    assert all(got[d] == n for d, n in copies.items())


@pytest.mark.parametrize("block", [65536, 50])
def test_long_documents_do_not_use_up_the_budget(spark, block):
    """One document with most of a source comes behind the others, wherever the hash puts it."""
    for seed in range(6):
        rows = [(0, "w " * 900, "a"), (99, "w " * 2000, "a"), *((i, "w " * 5, "a") for i in range(1, 81))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        copies = {r.doc_id: r.n_copies for r in mixing.mix_sources(docs, budget_ratio=0.1, seed=seed, block_tokens=block).collect()}
        assert copies.pop(0) == copies.pop(99) == 0 and sum(copies.values()) * 5 == 330
        most = {r.doc_id: r.n_copies for r in mixing.mix_sources(docs, budget_ratio=0.4, seed=seed, block_tokens=block).collect()}
        assert most[99] == 0 and all(n == 1 for d, n in most.items() if d != 99)


# --- toxicity ----------------------------------------------------------------
def toxic_rows(n):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(f"w{r.randint(0, 60)}" for _ in range(8)) for _ in range(r.randint(1, 9))]
        bad = i % 5 == 0
        if bad:
            lines[r.randrange(len(lines))] += r.choice([" awful", " nasty"])
        rows.append((i, ". ".join(lines) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows(600)
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return *frames, toxicity.fit(*frames)


def test_held_out_documents_and_sentences(toxic):
    docs, labels, model = toxic
    scored = toxicity.score(docs, model).join(labels, "doc_id").join(docs, "doc_id").filter(~toxicity.learned(F.col("doc_id"))).collect()
    assert len(scored) > 60 and all((r.score >= 0.5) == (r.toxic == 1) for r in scored)
    for r in scored:
        parts = [r.text.lower()[s.start : s.end] for s in r.offending]
        assert bool(parts) == (r.toxic == 1) and all("awful" in p or "nasty" in p for p in parts)


def test_toxicity_learns_only_what_it_may(spark, toxic):
    docs, labels, model = toxic
    turned = labels.withColumn("toxic", F.when(toxicity.learned(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


def test_noisy_or_by_hand():
    model = toxicity.Model(-2.0, {"bad": 3.0})
    p, q = 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-1))
    score, spans = toxicity.scored("Fine day. A BAD bad thing!\n\n...", model)
    assert score == pytest.approx(1 - (1 - p) * (1 - q)) and spans[0][:2] == (9, 25)
    assert toxicity.scored(None, model) == toxicity.scored(" \n.", model) == (0.0, [])


def plain_objective(bias, weights, bags, marks, sizes, penalty):
    total = {0: 0.0, 1: 0.0}
    for bag, mark in zip(bags, marks):
        clean = 1.0
        for words in bag:
            clean *= 1 - 1 / (1 + math.exp(-bias - sum(weights.get(w, 0) for w in words)))
        total[mark] -= math.log(clean if mark == 0 else 1 - clean)
    share = {y: sizes[y] / list(marks).count(y) for y in (0, 1)}
    whole = sum(share[y] for y in marks)
    return sum(total[y] * share[y] for y in (0, 1)) / whole + penalty * sum(map(abs, weights.values()))


def test_training_ends_where_no_step_lowers_the_loss():
    rows, labels = toxic_rows(150)
    bags = [[set(t.lower().split()) for t in text.split(".") if t.strip()] for _, text in rows]
    marks, sizes = np.array([y for _, _, y in labels]), {0: 900, 1: 100}
    names = sorted({w for b in bags for s in b for w in s})
    model = toxicity.descend(bags, marks, sizes, names, 3e-3)
    found = plain_objective(model.bias, model.weights, bags, marks, sizes, 3e-3)
    assert found < plain_objective(model.bias, {}, bags, marks, sizes, 3e-3)
    assert toxicity.bag_loss(model, bags, marks, sizes) == pytest.approx(found - 3e-3 * sum(map(abs, model.weights.values())), abs=1e-9)
    for step in (-0.1, 0.1):
        assert plain_objective(model.bias + step, model.weights, bags, marks, sizes, 3e-3) > found - 2e-3
        for name in names:
            moved = model.weights | {name: model.weights.get(name, 0) + step}
            assert plain_objective(model.bias, moved, bags, marks, sizes, 3e-3) > found - 5e-4


def test_held_out_labels_of_the_given_tables(spark):
    """About a fifth of the documents marked toxic hold none of the words that mark the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").filter(~toxicity.learned(F.col("doc_id"))).select("doc_id", "text", "toxic")
    rows = toxicity.score(held, model).join(labels, "doc_id").collect()
    caught = [r.score >= 0.5 for r in rows if r.toxic == 1]
    false = [r.score >= 0.5 for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) >= 0.75 and sum(false) / len(false) <= 0.01


def test_toxicity_edges(documents, corpus, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(corpus), empty)
    assert model.weights == {} and all(r.score < 1e-6 for r in toxicity.score(documents(corpus), model).collect())
    assert toxicity.score(documents([]), model).count() == 0
    kept = toxicity.drop_toxic(documents(corpus), model)
    assert kept.count() == len(corpus) and kept.columns == documents(corpus).columns
    odd = spark.createDataFrame([(None, None), (1, None), (2, 7), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity.fit(documents(corpus), odd).weights == {}


def test_toxicity_sample_does_not_depend_on_where_rows_lie(spark):
    """The word bound holds in hash order and for each class, wherever a class stands in the table."""
    rows, labels = toxic_rows(900)
    bad = {i for i, _, t in labels if t}
    labels = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    tables = [sorted(rows, key=lambda r: (r[0] in bad) == last) for last in (True, False)]
    found = [toxicity.sample(spark.createDataFrame(t, "doc_id long, text string").coalesce(1), labels, 4000, 8000) for t in tables]
    assert sorted(found[0][0]) == sorted(found[1][0])
    for texts, marks, _ in found:
        for y in (0, 1):
            size = sum(len(t) for t, m in zip(texts, marks) if m == y)
            assert 4000 * 4 * 0.9 < size <= 4000 * 4 + 1
    docs = dict(rows)
    drawn = {i for i, t in docs.items() if t in set(found[0][0])}
    # Documents of all parts of the table are in it.
    assert {i * 6 // 900 for i in drawn & bad} == set(range(6)) == {i * 6 // 900 for i in drawn - bad}


@pytest.mark.parametrize("giant", [0, 5, 1])
@pytest.mark.parametrize("n", [9_000, 30_000, 200_000])
def test_toxicity_giant_text(spark, giant, n):
    """A giant labelled text takes neither class's place, first or last in the table."""
    rows, labels = toxic_rows(900)
    labels = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    rows = [(giant, "w1 w2. " * n)] + [r for r in rows if r[0] != giant]
    model = None
    for table in (rows, rows[::-1]):
        docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
        texts, marks, _ = toxicity.sample(docs, labels, 4000, 30_000)
        assert min(np.bincount(marks, minlength=2)) > 100
        again = toxicity.fit(docs, labels, 4000, 30_000)
        assert {w for w, x in again.weights.items() if x > 1} == {"awful", "nasty"} and (model is None or model == again)
        model = again


def test_toxicity_texts_within_a_share():
    assert toxicity.taken([], 100) == []
    assert toxicity.taken([200, 300], 100) == [0] and toxicity.taken([1, 500, 2], 100) == [0, 2]
    assert toxicity.taken([48] + [5] * 40, 100) == list(range(11))
    assert toxicity.taken([48, 45, 40, 3], 100) == [0, 1, 3]


def test_offending_sentences_stand_where_they_are_reported():
    model = toxicity.Model(-2.0, {"bad": 3.0})
    text = "İİ. Badly said! bad. A bad thing. A bad thing\nbad? fine."
    _, spans = toxicity.scored(text, model)
    assert [text[a:b] for a, b, _ in spans] == [" bad", " A bad thing", " A bad thing", "bad"]
    assert [a for a, _, _ in spans] == [15, 20, 33, 46]


# --- SentencePiece -----------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)


def test_same_ids_as_the_library(vocabulary, library):
    r = random.Random(3)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "é", "日", "x1", "(", "==", "0", "🙂", "▁", "the", "ing", "\t", "\x00", "ﬁ", "ß"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 150))) for _ in range(1500)]
    texts += [" " * 300 + "x", "=" * 999, "".join(r.choice("abcdefgh") for _ in range(20_000)), "é" * 700, "the " * 500]
    encoder = sentencepiece.Encoder(vocabulary)
    coded = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode_all(texts)]
    assert coded == library.encode(texts)
    assert [sentencepiece.decode(x, vocabulary) for x in coded] == [t.replace("▁", " ") for t in texts] == library.decode(coded)


def test_paths_are_committed_while_reading(vocabulary):
    encoder = sentencepiece.Encoder(vocabulary)
    text = "".join(random.Random(1).choice("abcdefghij") for _ in range(3000))
    path = encoder.path(text)
    first = [next(path) for _ in range(20)]
    assert text.startswith("".join(first)) and "".join(first) + "".join(path) == text


def test_unigram_paths_are_the_best_ones():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -3.2, "c": -4.0, "ca": -4.1, "bcab": -6.0}
    v = sentencepiece.Vocabulary({p: i for i, p in enumerate(pieces)}, list(pieces.values()), [p.encode() for p in pieces], [], 0, False, False)
    encoder = sentencepiece.Encoder(v)

    def best(text):
        score = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for j in range(end):
                own = pieces.get(text[j:end], encoder.floor if end - j == 1 else None)
                if own is not None:
                    score[end] = max(score[end], score[j] + own)
        return score[-1]

    r = random.Random(2)
    for n in [*range(1, 30), 200, 1000]:
        text = "".join(r.choice("abcd") for _ in range(n))
        path = list(encoder.path(text))
        assert "".join(path) == text
        assert sum(pieces.get(p, encoder.floor) for p in path) == pytest.approx(best(text))


def test_encoding_tables(documents, corpus, vocabulary, library):
    docs = documents(corpus)
    coded = sentencepiece.encode(docs, vocabulary, check=True)
    assert coded.columns == [*[c for c in docs.columns if c != "ids"], "ids", "round_trip"]
    rows = sentencepiece.decode_ids(coded, vocabulary).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") and r.round_trip
    assert sentencepiece.encode(documents([]), vocabulary).count() == 0


# --- language ----------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    r = random.Random(8)
    kinds = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "der die und nicht straße".split(), "zz": "что как это для нет".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) + r.choice(["", "s", "en"]) for _ in range(12)), k) for i in range(600) for k in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, 60)
    found = language.predict(docs, model).join(docs, "doc_id").filter(~language.learned(F.col("doc_id"))).collect()
    assert len(found) > 100 and all(x.lang == x.lang_pred and 0 <= x.score <= 1 for x in found)
    # Only texts and languages that may be learned have a say.
    other = docs.withColumn("lang", F.when(language.learned(F.col("doc_id")), F.col("lang")).otherwise("aa"))
    again = language.fit(other, 60)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)


def test_many_languages_are_all_learned(spark):
    """More languages than get the full sample: none is left out, the rare ones neither."""
    r = random.Random(11)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    words = [["".join(r.sample(letters[9 * k : 9 * k + 9], 3)) for _ in range(12)] for k in range(100)]
    rows = [(n * 100 + k, " ".join(r.choices(words[k], k=10)), f"l{k}-X") for k in range(100) for n in range(40 if k % 4 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, 20)
    assert len(model.languages) == 100
    found = language.predict(docs, model).join(docs, "doc_id").filter(~language.learned(F.col("doc_id"))).collect()
    assert len({x.lang for x in found}) > 90 and all(x.lang == x.lang_pred for x in found)


def test_sample_of_a_language():
    assert [language.each(400, 16, n) for n in (0, 1, 64, 65, 128, 1600, 9000)] == [400, 400, 400, 393, 200, 16, 16]
    assert [language.each(24, 2, n) for n in (64, 128, 768, 9000)] == [24, 12, 2, 2]
    assert language.each(8, 16, 500) == 8


def test_presence_is_exact():
    rows = language.presence(["abab", "BA", "", "a" * 600_000 + "b"])
    assert rows[0].sum() == 2 + 2 + 2 and rows[1].sum() == 3 and rows[2].sum() == 0 and rows[3].sum() == 2 + 2 + 2


def test_language_edges(documents, corpus):
    docs = documents([*corpus, (None, "some text"), (999, "123 ...")])
    model = language.fit(docs)
    found = language.predict(docs, model).collect()
    assert len(found) == docs.count()
    text = {d: t for d, t in [*corpus, (999, "123 ...")]}
    for r in found:
        if r.doc_id in text:
            known = any(map(str.isalpha, text[r.doc_id] or ""))
            assert (r.lang_pred, r.score > 0) == (("en", True) if known else ("und", False))
    nothing = language.fit(documents([]))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("text, letter", [("½ ② Ⅷ", False), ("12_3", False), ("٣", False), ("ª", True), ("漢", True), ("ʰ", True), ("1a", True), ("́", False)])
def test_what_counts_as_a_letter(spark, text, letter):
    assert language.has_letter(text) is letter
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(F.col("t").rlike(language._LETTER_SQL)).first()[0] is letter


def plain_ridge(bits, langs, n_marks):
    """Kernel ridge regression on Nystroem features, written with whole matrices."""
    names = sorted(set(langs))
    rows = np.unpackbits(bits, axis=1).astype(float)
    rows /= np.sqrt(rows.sum(1, keepdims=True))
    kernel = rows @ rows.T
    kind = np.array([names.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(kind == k)[:n_marks] for k in range(len(names))])
    size, vectors = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    keep = size > 1e-6 * size[-1]
    features = kernel[:, marks] @ (vectors[:, keep] / np.sqrt(size[keep]))
    share = 1 / np.bincount(kind)[kind]
    share /= share.sum()
    target = np.eye(len(names))[kind]
    x, y = features - share @ features, target - share @ target
    beta = np.linalg.solve((x * share[:, None]).T @ x + language.RIDGE / len(bits) * np.eye(x.shape[1]), (x * share[:, None]).T @ y)
    return names, x @ beta + share @ target


def test_language_model_against_plain_kernel_ridge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, 40)
    bits, langs = language.sample(docs, 40)
    names, values = plain_ridge(bits, langs, language.LANDMARKS)
    assert names == model.languages
    rows = np.unpackbits(bits, axis=1).astype(np.float32)
    found = rows @ model.weights / np.sqrt(rows.sum(1, keepdims=True)) + model.offset
    assert np.abs(found - values).max() < 2e-3
    texts = [(i, "word " * (i + 1) + "größe über straße") for i in range(5)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts:
        row = language.presence([text])[0]
        value = row @ model.weights / np.sqrt(row.sum()) + model.offset
        assert got[i].lang_pred == names[value.argmax()] and got[i].score == pytest.approx(min(1, max(0, value.max())), abs=1e-5)


# --- main text ---------------------------------------------------------------
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">home page of site</a>'
    '</li></ul></nav><div class="ad">buy this now and that too</div><article><h1>{h}</h1><p>{a}<br>more</p><aside>see also these</aside>'
    '<div class="comments"><p>first comment text here</p></div><p class=x>{b}</p></article><footer>&copy; about us</footer></body></html>'
)


@pytest.fixture(scope="module")
def page_model():
    return main_text.fit_pages([PAGE.format(h=f"Title {i}", a="one two " * (i % 5 + 1), b="three &amp; four") for i in range(40)])


def test_article_without_the_rest(page_model):
    got = main_text.extract(PAGE.format(h="A  title", a="Tom &amp;\n Jerry", b="the &eacute;nd &#8364;"), page_model)
    assert got == "A title\nTom & Jerry more\nthe énd €"


def test_region_is_the_best_one(page_model):
    """The scan finds the stretch that trying all of them finds."""
    r = random.Random(6)
    for _ in range(40):
        page = "".join(r.choice(["<p>", "</p>", "one two", "<nav>", "x y z", "</nav>", "<b>", "</b>", "<footer>", "</footer>", "<div class='ad'>", "</div>"]) for _ in range(12))
        parts = list(main_text.pieces(page))
        scores = [main_text.score_of(p, page, page_model, {}) for p in parts]
        best = max([0, *(sum(scores[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1))])
        first, last = main_text.best_stretch(scores)
        assert sum(scores[first:last]) == pytest.approx(best)


def test_main_text_edges(spark, page_model):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "plain words only"), (4, "u", "<p>cut <b"), (5, "u", "<" * 50_000), (6, "u", "<p>" + "word " * 50_000), (6, "u", "<p>" + "word " * 50_000), (None, None, "<script>x"), (8, "u", "<a " * 50_000)]
    frame = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, key int")
    rows = main_text.main_text(frame, page_model).collect()
    texts = {(r.page_id): r.text for r in rows}
    assert len(rows) == len(pages)
    assert texts[1] == texts[2] == texts[None] == "" and texts[3] == "plain words only" and texts[4].startswith("cut")
    assert texts[6] == " ".join(["word"] * 50_000)
    assert main_text.main_text(frame.limit(0), main_text.fit(frame.limit(0))).count() == 0
    assert main_text.extract(PAGE.format(h="Short", a="plain text of the page", b="and its end"), main_text.fit_pages([])).startswith("Short")


LINK = '<p>see <a href="/x">this page</a></p>'
LINKED_WORD = '<a href="/x">link</a> '
LIST = "<ul>" + "<li><a href='/y'>item</a></li>" * 3 + "</ul>"
DEFINED = "<dl><dt>term</dt><dd>meaning</dd></dl>"
TABLE = "<table><caption>sizes</caption><thead><tr><th>name</th><th></th></tr></thead><tbody><tr><td>a</td><td>5</td></tr></tbody></table>"


@pytest.mark.parametrize("part", [LINK, LINKED_WORD, LIST, DEFINED, TABLE])
@pytest.mark.parametrize("before, after", [(0, 60), (8, 60), (60, 8), (60, 0), (30, 300)])
def test_links_lists_and_tables_of_an_article(part, before, after):
    """What labelled pages only show in menus is kept within an article, wherever it stands in it."""
    menus = PAGE.replace("</nav>", f"{part}</nav>").replace("<footer>", f"<footer>{part}")
    model = main_text.fit_pages([menus.format(h=f"Title {i}", a="one two " * (i % 5 + 1), b="three four") for i in range(40)])
    for open_, close in (("<p>", "</p>"), ("", "")):
        inside = open_ + "start " * before + close + part + open_ + "end " * after + close
        page = menus[: menus.index("<article>")] + f"<article>{inside}</article>" + menus[menus.index("</article>") + 10 :]
        got = main_text.extract(page, model).split()
        want = [w for p in main_text.pieces(inside) if p.kind == "text" for w in inside[p.start : p.end].split()]
        assert got == want


def test_link_in_the_middle_of_a_paragraph(page_model):
    page = PAGE.format(h="", a="", b="early " * 30 + '<a href="/x">x</a> ' + "late " * 300)
    assert main_text.extract(page, page_model).split()[-331:] == ["early"] * 30 + ["x"] + ["late"] * 300


def test_menu_in_the_frame_of_the_page_stays_outside():
    menu = "<ul>" + "<li><a href='/y'>menu item</a></li>" * 9 + "</ul>"
    for frame in (menu, f"<div>{menu}</div>"):
        page = PAGE.replace("<article>", frame + "<article>")
        model = main_text.fit_pages([page.format(h=f"Title {i}", a="one two " * (i % 5 + 1), b="three four") for i in range(40)])
        got = main_text.extract(page.format(h="Head", a="plain text of the page", b="and its end " + LIST), model)
        assert got.split() == "Head plain text of the page more and its end item item item".split()


@pytest.mark.parametrize("piece", ["<li>x", "<td>x", "<b>x", "<div class=a>x ", "<p>x</i>", "<tr><td>x", "<dd><b>x", "<li><ul><b>x", "</b>x", "<a href='"])
def test_main_text_takes_linear_time(page_model, piece):
    pages = [PAGE.format(h="", a="", b=piece * (n // len(piece))) for n in (250_000, 2_500_000)]
    times = []
    for page in pages:
        start = time.perf_counter()
        text = main_text.extract(page, page_model)
        times.append(time.perf_counter() - start)
    assert times[1] < 25 * times[0] + 1 and times[1] < 60
    if "x" in piece:
        assert text.count("x") >= 2_500_000 // len(piece)


def test_elements_end_where_the_next_one_starts():
    page = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><th>g</table><dl><dt>h<dd>i<dt>j</dl><p>k<p>l<select><option>m<option>n</select>o"
    depth = {page[p.start : p.end]: [e.key for e in p.element.chain()] if p.element else [] for p in main_text.pieces(page) if p.kind == "text"}
    assert depth == {
        "a": ["ul", "li"], "b": ["ul", "li"], "c": ["ul", "li", "ul", "li"], "d": ["ul", "li"], "e": ["table", "tr", "td"], "f": ["table", "tr", "td"],
        "g": ["table", "tr", "th"], "h": ["dl", "dt"], "i": ["dl", "dd"], "j": ["dl", "dt"], "k": ["p"], "l": ["p"], "m": ["p", "select", "option"],
        "n": ["p", "select", "option"], "o": ["p"],
    }


def test_class_words_and_headers_of_an_article(page_model):
    article = (
        '<header><h1>Own title</h1></header><p class="share-price">The share price rose.</p><div class="ad">buy</div><div class="comment-list">no</div>'
        '<section class="login-trouble">Why logins fail.</section><p class="social share">tell all</p><footer>by me</footer>'
    )
    page = PAGE[: PAGE.index("<article>")].format() + f"<header>Site name</header><article>{article}</article></body>"
    for model in (page_model, main_text.fit_pages([])):
        assert main_text.extract(page, model) == "Own title\nThe share price rose.\nWhy logins fail."


def test_pages_that_are_learned_from_are_bounded(spark):
    page = PAGE.format(h="T", a="one two three", b="four")
    big = PAGE.format(h="T", a="word " * 50_000, b="four")
    deep = PAGE.format(h="T", a="<b>" * 500 + "x", b="four")
    frame = spark.createDataFrame([(i, page) for i in range(30)] + [(100, big), (101, deep), (1, deep), (None, page)], "page_id long, html string")
    assert main_text.fit(frame, max_bytes=40_000) == main_text.fit_pages([page])
    assert main_text.fit(frame.limit(0)).tags == {}
