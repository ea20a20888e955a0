import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import docs_of, prose

from reefline.llm import jaccard_join as J
from reefline.llm.graph import components
from reefline.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, width):
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        yield frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts, width, threshold):
    sets, t = list(sets_of(texts, width)), Fraction(threshold)
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "threshold"), [(4, "0.85"), (2, "0.5")])
def test_equals_brute_force(spark, docs, texts, width, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs, width=width, threshold=threshold).collect()}
    assert got == brute(texts, width, threshold)


def test_large_group_of_near_copies(spark):
    base = prose(3, 80).split()
    texts = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in range(60)] + [prose(5, 60), prose(6, 61)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs_of(spark, texts), width=3, threshold="0.9").collect()}
    assert got == brute(texts, 3, "0.9")


def test_null_and_repeated_ids_and_empty(spark, empty):
    assert J.jaccard_join(empty).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in J.jaccard_join(df).collect()), key=str)
    assert rows == sorted([(3, 2), (3, 2), (None, None), (2, 2)], key=str)


def test_shingle_sets_are_sets(texts):
    for width in (1, 3, 4):
        for s, want in zip(shingle_sets([t or "" for t in texts], width), sets_of(texts, width), strict=True):
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(0)
    for n in (3, 70, 900):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)]))
        x, y = (np.frombuffer(J.bitmap(s), dtype=np.uint8)[None] for s in (a, b))
        assert J.differ_at_least(x, y)[0] == J.differ_at_least(y, x)[0] <= len(np.setxor1d(a, b))
        assert J.differ_at_least(x, x)[0] == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (300, 301), (301, 300)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert components(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 4, 5, 8])
def test_chunks_of_few_words(width):
    words = "a b c d e f g h i".split()
    for n in range(width + 2):
        (one,) = shingle_sets([" ".join(words[:n])], width)
        assert len(one) == (max(n - width + 1, 1) if n else 0)
        if n > 1:  # the same total in two texts
            assert [len(s) for s in shingle_sets([words[0], " ".join(words[1:n])], width)] == [1, max(n - width, 1)]


def test_repeated_ids_with_other_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (3, a + " tail"), (4, b + " tail"), (5, a), (5, a), (6, None), (6, "")]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), with_text_hash=True).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (3, 1), (4, 1), (5, 1), (5, 1), (6, 6), (6, 6)]
    rows = [(1, a), (7, a + " tail"), (1, "q"), (8, b), (2, b + " tail"), (7, "z")]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles > 1) for r in got) == [(1, 1, False), (1, 1, True), (2, 2, True), (7, 1, True), (7, 7, False), (8, 2, True)]


@pytest.mark.parametrize("threshold", ["0.6", "0.8", "0.85"])
def test_random_edits_and_shared_passages(spark, threshold):
    """Edited copies in groups of all sizes, and a passage in many texts."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    passage = list(rng.choice(words, 30))
    texts = []
    for g in range(30):
        base = list(rng.choice(words, int(rng.integers(5, 90))))
        for _ in range(int(rng.integers(1, 7))):
            t = [w if rng.random() > 0.02 else str(rng.choice(words)) for w in base]
            t = t[int(rng.integers(0, 3)) :] + list(rng.choice(words, int(rng.integers(0, 4))))
            texts.append(" ".join(passage + t if g % 3 == 0 else t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs_of(spark, texts), width=2, threshold=threshold).collect()}
    assert got == brute(texts, 2, threshold)


def test_shared_prefix_bound():
    """Two sets that reach the threshold share as many prefix tokens as the matrix asks for."""
    rng = np.random.default_rng(6)
    for t in (Fraction("0.8"), Fraction("0.85"), Fraction("0.5")):
        both = t / (1 + t)
        up = lambda share, n: -(-share.numerator * n // share.denominator)
        for _ in range(3000):
            a = set(rng.choice(200, int(rng.integers(1, 60)), replace=False).tolist())
            b = {x for x in a if rng.random() > 0.1} | set(rng.choice(200, int(rng.integers(0, 5))).tolist())
            if len(b) > len(a):
                a, b = b, a
            if not b or len(a & b) * t.denominator < t.numerator * len(a | b):
                continue
            n, m = len(a), len(b)
            p = set(sorted(a)[: n - J.least_overlap(n, t) + 1]) & set(sorted(b)[: m - up(2 * both, m) + 1])
            assert len(p) >= max(1, up(both, n + m) - max(up(t, n), up(2 * both, m)) + 1)
