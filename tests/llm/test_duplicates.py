"""Exact and near duplicates of documents, and repeated words and bytes, against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from conftest import prose
from conftest_llm import lowered, words_of

from contactlake.llm import byte_text, exact_dedup, fm_dedup, near_dedup, repeats, suffix_dedup
from contactlake.llm.common import components


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (100, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(documents, corpus):
    rows = [*corpus, (None, "a b c d e"), (None, "lonely")]
    groups = {}
    for d, t in set(rows):
        groups.setdefault(lowered(t), set()).add(d)
    want = set()
    for d, t in set(rows):
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.add((d, keep, len(ids), d == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(documents(rows), block_bytes=64).drop(*exact_dedup.CLASS).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_names_are_equal_only_for_equal_texts(spark):
    """Texts whose fingerprints are equal must not become one, and equal texts need no fingerprint."""
    long = "ab" * 500
    texts = [(1, long + "x"), (2, long + "x"), (3, long + "y"), (4, "z" + long), (5, ""), (6, ""), (7, "ab"), (8, "ab" * 8)]
    frame = spark.createDataFrame([(d, t, 0, d) for d, t in texts], "doc_id long, body string, n_bytes int, print long")
    for block in (16, 2, 4096):
        for share in (256, 2):
            names = {r.doc_id: (r["size"], r.name) for r in exact_dedup.name_texts(frame, block, share).collect()}
            assert names[1] == names[2] and names[5] == names[6] and len(set(names.values())) == 6


def test_frequent_blocks_do_not_meet_in_one_task(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    frame = spark.createDataFrame([(d, t, 0, d) for d, t in rows], "doc_id long, body string, n_bytes int, print long")
    blocks = exact_dedup.in_blocks(frame, 4096)
    assert [bytes(r.block) for r in exact_dedup.frequent_blocks(blocks, 256).collect()] == [b"the same text"]
    assert exact_dedup.frequent_blocks(blocks.filter("doc_id % 3 = 0"), 256) is None
    names = {r.doc_id: r.name for r in exact_dedup.name_texts(frame).collect()}
    assert len(names) == 3000 and len(set(names.values())) == 1001 and {names[i] for i, _ in rows if i % 3} == {-1}


def test_exact_drop(documents, corpus):
    kept = exact_dedup.drop_duplicates(documents(corpus))
    rows = kept.select("doc_id", "text").collect()
    assert kept.columns == documents(corpus).columns
    assert len(rows) == len({lowered(t) for _, t in corpus})
    assert exact_dedup.drop_duplicates(documents([])).count() == 0 == exact_dedup.exact_duplicates(documents([])).count()


def shingles(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = max(sets.get(d, set()), shingles(t), key=len)
    parent = {d: d for d in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {(d, len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("part", [256, 3])
def test_near_duplicates(documents, corpus, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    rows = [*corpus, (None, corpus[0][1])]
    got = near_dedup.near_duplicates(documents(rows)).collect()
    want = near_groups(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("percent", [60, 90])
def test_near_duplicates_of_another_limit(documents, percent):
    """Pairs of 200 shingles that share from half to all of them: the limit given is the one that counts."""
    sets, want = {}, {}
    for i in range(25):
        common = 132 + 3 * i
        for d in (2 * i, 2 * i + 1):
            words = [f"p{i}w{k}" for k in range(common)] + [f"d{d}w{k}" for k in range(204 - common)]
            sets[d] = " ".join(words)
        a, b = (shingles(sets[d]) for d in (2 * i, 2 * i + 1))
        linked = 100 * len(a & b) >= percent * len(a | b)
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if linked else 2 * i + 1}
    assert len(set(want.values())) not in (25, 50)
    got = near_dedup.near_duplicates(documents(list(sets.items())), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_shared_values_follow_from_the_limit():
    assert near_dedup.min_shared(75) == 26 and near_dedup.min_shared(100) == 64
    shared = [near_dedup.min_shared(p) for p in range(1, 101)]
    assert shared == sorted(shared) and shared[0] == 1


def test_near_duplicates_of_nothing(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    assert {tuple(r) for r in near_dedup.near_duplicates(documents([(1, None), (2, "")])).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    kept = near_dedup.drop_near_duplicates(documents([(1, "a b"), (2, "A b"), (None, "a b")]))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (True, None)]


def without_repeats(rows, window, split, join):
    seen, out = {}, {}
    for d, t in sorted(set((d, t) for d, t in rows if d is not None)):
        units = split(t)
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            key = tuple(units[i : i + window])
            if seen.setdefault(key, (d, i)) != (d, i):
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(units), sum(gone), spans, join([u for u, g in zip(units, gone) if not g]))
    return [(d, *out[d]) for d, _ in rows if d is not None]


@pytest.mark.parametrize("operator, window, split, join", [
    (fm_dedup.remove_repeated_words, 20, words_of, b" ".join),
    (suffix_dedup.remove_repeated_bytes, 100, lambda t: list((t or "").encode()), bytes),
])
@pytest.mark.parametrize("sizes", [{}, {"shard_anchors": 40, "part_anchors": 1}, {"stretch": 700, "piece": 90, "part_anchors": 1}])
def test_repeats(documents, corpus, operator, window, split, join, sizes, monkeypatch):
    """Also in small shards, where sources are split into parts and compared across them, and in short stretches."""
    module = fm_dedup if window == 20 else suffix_dedup
    monkeypatch.setattr(module, "UNIT", module.UNIT._replace(**sizes))
    rows = [*corpus, (None, "x"), (600, " ".join(map(str, range(3000)))), (601, " ".join(map(str, range(1000, 4000))))]
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in operator(documents(rows)).collect()]
    assert sorted(got) == sorted(without_repeats(rows, window, split, join))
    assert operator(documents([])).count() == 0


def thue_morse():
    """Two words whose polynomial hashes modulo 2^64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_stay_apart(documents):
    one, other = thue_morse()
    rows = [(1, "same " * 19 + one), (2, "same " * 19 + other), (3, one), (4, other), (5, one)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in fm_dedup.remove_repeated_words(documents(rows)).collect()}
    assert got[1][0] == 0 == got[2][0] and got[2][1] == rows[1][1]
    groups = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert groups[3] == 3 and groups[4] == 4 and groups[5] == 3


def test_equal_hashes_are_told_apart():
    values, others = np.array([7, 5, 7, 5, 9], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    found = repeats.told_apart(values, others)
    assert len({*found.tolist()}) == 4 and found[1] == found[3] and found[0] != found[2]
    assert (repeats.told_apart(values, values) == values).all()


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("operator", [fm_dedup.remove_repeated_words, suffix_dedup.remove_repeated_bytes])
@pytest.mark.parametrize("copies, mb", [(2, 8), (40, 0.5)])
def test_copies_of_a_long_text(spark, many_partitions, operator, copies, mb):
    """Copies go whole, and what is shuffled for them is in proportion to what they hold."""
    text = prose(77, int(mb * 2**20 / 8))
    rows = [(i, text if i else text + " end") for i in range(copies)] + [(900, "own " + prose(78, 50))]
    got = {r.doc_id: (r.n_removed, len(r.kept)) for r in operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, len(rows[0][1].encode())) and got[900][0] == 0
    assert all(got[i][1] == 0 for i in range(1, copies))


def test_window_groups_are_exact():
    for seed in range(60):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 200))
        values, ends = r.integers(1, 3, n).astype(np.uint64), np.unique(np.append(r.integers(1, n + 1, 3), n))
        starts, first = repeats.window_groups(values, ends, 9)
        seen, want = {}, []
        for a, b in zip(np.append(0, ends[:-1]), ends):
            want += [(i, seen.setdefault(tuple(values[i : i + 9]), i)) for i in range(a, b - 8)]
        assert list(zip(starts, first)) == want


def test_index_finds_what_is_there():
    r = np.random.default_rng(5)
    values, ends = r.integers(0, 3, 400).astype(np.uint64), np.array([150, 151, 400])
    index = fm_dedup.FMIndex(values, ends, np.arange(400))
    query = r.integers(0, 4, 3000).astype(np.uint64)
    hashes, starts = byte_text.grams(query, fm_dedup.KEPT_UNITS), np.arange(2980)
    query[: 150 - 20 + 20] = values[:150]
    hashes = byte_text.grams(query, fm_dedup.KEPT_UNITS)
    low, high = index.search(query, hashes, starts, 18)
    text = [tuple(values[i : i + 18]) for a, b in ((0, 150), (151, 400)) for i in range(a, b - 17)]
    places = [i for a, b in ((0, 150), (151, 400)) for i in range(a, b - 17)]
    for s in starts:
        there = [p for p, t in zip(places, text) if t == tuple(query[s : s + 18])]
        assert high[s] - low[s] == len(there)
        if there:
            assert index.first_place(low[s : s + 1], high[s : s + 1])[0] == min(there)


def test_words_and_hashes_of_bytes():
    import pyarrow as pa

    texts = ["a b", None, "", " x\ty\n", "ÄÖ ü", "w" * 5000 + " q", "A a"]
    for _, _, data, ends in byte_text.chunks(pa.array(texts)):
        h, owner, start, stop = byte_text.words(data, ends, lower=True)
        found = [(o, bytes(data[s:e])) for o, s, e in zip(owner, start, stop)]
        assert found == [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
        assert h[-1] == h[-2] == h[0] and len(set(h.tolist())) == len(h) - 2
