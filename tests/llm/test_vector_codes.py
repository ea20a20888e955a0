from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reefline.llm.vector_codes import KdTree, digest, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, error long, part int"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label). Plain Python integers throughout."""
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    order = [r for r in order if r[1]]
    size = next((len(r[1]) for r in order if len(r[1]) % parts == 0), None)
    kept = [r for r in kept if len(r[1]) == size]
    order = [r for r in order if len(r[1]) == size]
    if not kept:
        return [], []
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for r in kept:
                own[nearest(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        by_label[label] += out[-1][-1]
    return [(*r, by_label[r[1]]) for r in out], books


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    codes, books = vector_codes(df, **options)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want, want_books = brute(rows, **options)
    assert sorted((tuple(r) for r in codes.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == [list(map(list, b)) for b in want_books] or not want
    return books


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(400)]
    check(spark, rows)
    check(spark, rows, entries=9, rounds=2)
    check(spark, rows, parts=8, rounds=0)


def test_ties_and_repeats(spark):
    """Few different vectors: equal entries, equally near ones, ids that repeat with other vectors."""
    rng = np.random.default_rng(6)
    rows = [(int(i % 70), (rng.integers(-2, 3, 8) / 1024).tolist(), 1) for i in range(300)] + [(None, [0.0] * 8, None)] * 3
    books = check(spark, rows, entries=40)
    assert books.shape == (4, 40, 2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [], 1), (1, [1.0, 2.0, 3.0], 1), (2, None, 1), (3, [nan, 1.0, 1.0, 1.0], 1), (4, [None, 1.0, 1.0, 1.0], None), (5, [inf, 1.0, 1.0, 1.0], 1), (6, [-0.5, 0.25, -0.0001, 2.0], None)]
    rows += [(7, [1.0, 0.0, 0.0, 0.0], None), (8, [1.0] * 8, 2), (9, [-1.5, 0.1, 0.2, 0.3], 2)]
    check(spark, rows)
    huge = vector_codes(spark.createDataFrame([(1, [1e30, 0.0, 0.0, -1e30], 1)], "vec_id long, embedding array<double>, label int"))[0].collect()
    assert [tuple(r) for r in huge] == [(1, 1, "00000000", 0, 0)]


def test_empty(spark):
    codes, books = vector_codes(spark.createDataFrame([], SCHEMA))
    assert codes.collect() == [] and books.size == 0 and len(digest(books)) == 64
    assert vector_codes(spark.createDataFrame([(1, None, 1, "x", 1, 2)], SCHEMA))[0].collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 120), st.integers(1, 5), st.integers(1, 6))
def test_tree_keeps_ties(seed, n, width, span):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-span, span + 1, (n, width)), rng.integers(-span - 2, span + 3, (50, width))
    index, d = KdTree.of(entries).nearest(x)
    all_d = ((x[:, None] - entries) ** 2).sum(2)
    assert (index == all_d.argmin(1)).all() and (d == all_d.min(1)).all()


def test_entries_are_checked(spark):
    with pytest.raises(ValueError, match="hex"):
        vector_codes(spark.createDataFrame([], SCHEMA), entries=300)
