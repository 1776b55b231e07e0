"""Registered queries against their SQL, whole tables; vectors and the pipeline against brute force."""

import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from contactlake.llm import embedding_dedup, exact_dedup, mixing, near_dedup, toxicity
from contactlake.llm.common import read
from contactlake.llm.oracles import ORACLES
from contactlake.llm.registry import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    assert compare(name, spark, connection, SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_row(spark, connection, name):
    table = {"op9": "pages"}.get(name.split("_")[0], "documents")
    assert QUERIES[name](spark, SF).count() == connection.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]


# --- vectors -----------------------------------------------------------------
def vectors(seed, n, size=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, size))
    rows = []
    for i in range(n):
        v = centres[i % 5] + r.normal(size=size) * (0.02 if i % 3 else 0.12)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(n + i, rows[i % 4][1], rows[i % 4][2]) for i in range(20)]  # equal ones
    rows += [(5000, None, 0), (5001, [0.0] * size, 0), (5002, [float("nan")] * size, 0), (5003, [1.0, None], 0), (5004, [float("inf")] * size, 1)]
    rows += [(5005, rows[0][1], None), (5006, [], 0), (5007, [1.0, 2.0], 0), (5008, [2.0, 4.0], 0), (5009, [1.0], 0), (0, rows[0][1], 0)]
    return rows


def brute(rows):
    rows = list({repr(r): r for r in rows}.values())
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, n_links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for x in range(len(good)):
        for y in range(x):
            (a, u, k), (b, v, m) = good[x], good[y]
            if k == m and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98:
                n_links[a] += 1
                n_links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {(i, n_links[i], root(i), root(i) == i) for i in parent}


@pytest.mark.parametrize("block, leaf", [(512, 64), (16, 4)])
def test_vectors(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(3, 300)
    frame = spark.createDataFrame([(*r, 1, "x") for r in [*rows, (None, rows[0][1], 0)]], "vec_id long, embedding array<float>, label int, size int, block string")
    got = {tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == brute(rows)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_every_length_has_directions_of_its_own(spark):
    """Vectors of a rarer length are told apart by the grid as well."""
    r = np.random.default_rng(8)
    rows = [(i, size, r.normal(size=size) * np.linspace(3, 0.1, size)) for i, size in enumerate([12] * 300 + [20] * 200 + [3] * 90 + [1] * 5)]
    frame = spark.createDataFrame([(i, s, [float(x) for x in v]) for i, s, v in rows], "first_id long, size int, embedding array<double>")
    found = embedding_dedup.directions(frame, 2000)
    assert {s: x.shape for s, x in found.items()} == {12: (12, 8), 20: (20, 8), 3: (3, 3), 1: (1, 1)}
    placed = embedding_dedup.grid(frame, found, 0.2).collect()
    for size in (12, 20, 3):
        assert len({tuple(x.cells[:2]) for x in placed if x["size"] == size}) > 10
    for x in placed:
        unit = np.array(x.embedding) / np.linalg.norm(x.embedding)
        assert np.allclose(x.lead[: found[x["size"]].shape[1]], unit @ found[x["size"]])


# --- the pipeline ------------------------------------------------------------
def test_stages_on_what_the_one_before_kept(spark, connection):
    docs = read(spark, SF, "documents")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        got[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r.doc_id for r in got[name])
        if name == "toxicity":
            model = toxicity.fit(before, read(spark, SF, "labels"))
            assert ids == sorted(r.doc_id for r in before.collect() if toxicity.scored(r.text, model)[0] < 0.5)
        elif name == "exact_dedup":
            assert ids == sorted(r.doc_id for r in exact_dedup.exact_duplicates(before).filter("kept").collect())
            assert len({(r.text or "").lower() for r in got[name]}) >= len(ids) - 1
        elif name == "near_dedup":
            assert ids == sorted(r.doc_id for r in near_dedup.near_duplicates(before).filter("kept").collect())
        elif name == "source_mixing":
            taken = {r.doc_id: r.n_copies for r in mixing.mix_sources(before).collect()}
            assert ids == sorted(d for d, n in taken.items() for _ in range(n))
        else:
            assert ids == sorted(r.doc_id for r in before.collect())
        docs = spark.createDataFrame(got[name], docs.schema)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, got[corpus_pipeline.STAGES[-1][0]]))


def test_stages_take_odd_tables(spark, documents, corpus):
    for rows in ([], [(None, None), (1, None), (1, None), (2, "")]):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= max(len(rows), 1)
            docs = out if name != corpus_pipeline.STAGES[-1][0] else docs
