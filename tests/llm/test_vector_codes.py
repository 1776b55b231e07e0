"""Vector codes against a plain version that compares every part with every entry."""

import hashlib
import math

import numpy as np
import pytest

from contactlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, size int, parts string, error string, rank int, match_key string"


def plain(rows, rounds=6):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for size in {len(r[1]) for r in good}:
        mine = [r for r in good if len(r[1]) == size]
        whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (-size % 8) for r in mine]
        width = len(whole[0]) // 8
        parts = [[w[p * width : (p + 1) * width] for p in range(8)] for w in whole]
        ids = sorted({r[0] for r in mine}, key=lambda i: (i is None, i))[:16]
        starts = [min(w for r, w in zip(mine, parts) if r[0] == i) for i in ids]
        books = [[s[p] for s in starts] for p in range(8)]

        def nearest():
            gaps = [[[sum((a - b) ** 2 for a, b in zip(w[p], e)) for e in books[p]] for p in range(8)] for w in parts]
            return [[(min(g), g.index(min(g))) for g in row] for row in gaps]

        for _ in range(rounds):
            found = nearest()
            for p in range(8):
                for e in range(len(books[p])):
                    own = [w[p] for w, f in zip(parts, found) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for r, f in zip(mine, nearest()):
            out.append((r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), r[2], digest))
    totals = {}
    for r in out:
        totals[r[3]] = totals.get(r[3], 0) + r[2]
    return sorted([(i, c, e, totals[k], d) for i, c, e, k, d in out], key=repr)


def vectors(seed, n, size, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, size))
    return [(int(i), [float(x) for x in (centres[i % 6] + spread * r.normal(size=size)).astype(np.float32)], int(i) % 3 or None) for i in r.permutation(n)]


ODD = [
    (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 2), (904, [], 1), (905, [0.0] * 16, 2),
    (906, [-0.0001] * 16, None), (None, [0.5] * 16, 1), (None, [0.25] * 16, 1), (907, [0.1] * 3, 1), (907, [0.3] * 3, 1), (908, [0.1] * 3, 2),
]


@pytest.mark.parametrize("case", ["clusters", "ties", "few", "odd", "repeated"])
def test_codes(spark, case):
    rows = {
        "clusters": lambda: vectors(1, 200, 16, 0.1),
        "ties": lambda: [(i, [float((i * j) % 3) for j in range(16)], i % 2) for i in range(80)],
        "few": lambda: vectors(2, 5, 24, 1.0),
        "odd": lambda: vectors(3, 60, 16, 0.5) + ODD,
        "repeated": lambda: vectors(4, 40, 8, 0.3) * 3 + [(2, [0.5] * 8, 1)] * 30,
    }[case]()
    frame = spark.createDataFrame([(*r, 1, "p", "e", 2, "m") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in vector_codes.compress(frame).drop("n_tried").collect()), key=repr)
    assert got == plain(rows)


def test_bounds_never_hide_the_nearest_entry():
    r = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 22):
        entries = r.integers(-scale, scale, (8, 16, 4))
        rows = r.integers(-scale, scale, (500, 8, 4))
        rows[:16] = entries.transpose(1, 0, 2)
        book = vector_codes.Codebook(entries, vector_codes.far_apart(entries, 4))
        which, error, tried = vector_codes.nearest(rows, vector_codes.distances(rows, book.pivots).astype(np.float32), book)
        exact = ((rows[:, :, None] - entries[None]) ** 2).sum(3)
        assert (which == exact.argmin(2)).all() and (error == exact.min(2)).all()
        assert tried < 500 * 8 * 16


def test_empty_table_and_numbers_out_of_range(spark):
    frame = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(frame.limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(frame).collect()
