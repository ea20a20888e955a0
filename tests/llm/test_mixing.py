import hashlib

import numpy as np
import pytest
from llm_fixtures import docs_of
from pyspark.sql import functions as F

from reefline.llm import mixing as M


def test_rake_meets_margins():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 100, 24).astype(float)
    members = [np.arange(24) % 3, np.arange(24) // 12]
    targets = [np.array([0.2, 0.3, 0.5]), np.array([0.4, 0.6])]
    w = M.rake(tokens, members, targets)
    for m, t in zip(members, targets, strict=True):
        assert np.allclose(np.bincount(m, weights=w) / tokens.sum(), t, atol=1e-6)


def test_scale():
    tokens, ratio = np.array([10.0, 20.0, 30.0]), np.array([3.0, 1.0, 0.5])
    for share in (0.1, 0.5, 0.9, 1.0):
        assert abs((tokens * np.minimum(1, ratio * M.scale_for(tokens, ratio, share))).sum() - share * 60) < 1e-9


@pytest.mark.parametrize("targets", [{"source": 0.5, "lang": 1.0}, {"source": {"src0": 0.6, "src1": 0.4}, "lang": {"en": 0.5, "de": 0.5}}])
def test_driver_and_distributed_agree(spark, targets):
    texts = [("word " * (i % 7 + 1)) for i in range(60)]
    df = docs_of(spark, texts, {i: "en" if i % 4 else "de" for i in range(60)})
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    one, two = (M.mix(df, margins=margins, targets=targets, share=0.5, max_cells=n).orderBy("doc_id").collect() for n in (1000, 0))
    assert len(one) == 60
    for a, b in zip(one, two, strict=True):
        assert (a.doc_id, a.source, a.n_tokens) == (b.doc_id, b.source, b.n_tokens)
        assert abs(a.weight - b.weight) < 1e-12 and abs(a.probability - b.probability) < 1e-12
        u = int(hashlib.md5(f"42:{a.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert a.kept == (u < a.probability)
    if isinstance(targets["source"], dict):
        assert {a.weight for a in one if a.source == "src2"} == {0.0}
    assert abs(sum(a.probability * a.n_tokens for a in one) - 0.5 * sum(a.n_tokens for a in one)) < 1e-3


def test_odd_rows(spark, docs, texts, empty):
    rows = M.mix(docs).collect()
    assert len(rows) == len(texts) and all(0 <= r.probability <= 1 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert M.mix(empty).count() == 0
    assert M.mix(docs_of(spark, [None, "", " "])).where("kept").count() == 0


def test_sample_meets_margins_under_the_bound():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 2000, 60).astype(float)
    members = [np.arange(60) % 3, np.arange(60) // 15]
    planted = np.array([0.3, 1.0, 2.0])[members[0]] * np.array([0.3, 0.6, 1.2, 2.0])[members[1]]
    chance = np.minimum(1.0, planted)
    share = float((tokens * chance).sum() / tokens.sum())
    targets = [np.bincount(m, weights=tokens * chance) / (tokens * chance).sum() for m in members]
    ratio = M.rake(tokens, members, targets) / tokens
    p = M.bounded(tokens, ratio, members, targets, share)
    assert (planted > 1).any() and np.allclose(p, chance, atol=1e-6)
    once = np.minimum(1, ratio * M.scale_for(tokens, ratio, share))
    sums = lambda q: np.concatenate([np.bincount(m, weights=tokens * q) / (tokens * q).sum() for m in members])
    assert np.allclose(sums(p), np.concatenate(targets), atol=1e-6)
    assert not np.allclose(sums(once), np.concatenate(targets), atol=1e-3)


@pytest.mark.parametrize("max_cells", [1000, 0])
def test_what_a_category_lacks_the_others_give(spark, max_cells):
    # 100 tokens; src0 has 10 of the 28 it should give: all stay, the others give 30 each, languages half each
    rows = [(i, "word", "en" if i < 5 or 10 <= i < 75 else "de", "src0" if i < 10 else f"src{1 + i % 2}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.4, "src1": 0.3, "src2": 0.3}, "lang": {"en": 0.6, "de": 0.4}}
    got = M.mix(df, margins={m: F.col(m) for m in targets}, targets=targets, share=0.7, max_cells=max_cells).collect()
    sums = {v: sum(r.probability for r in got if v in (r.source, r.lang)) for v in ("src0", "src1", "src2", "en", "de")}
    want = {"src0": 10, "src1": 30, "src2": 30, "en": 42, "de": 28}
    assert all(abs(sums[k] - want[k]) < 1e-4 for k in want), sums


def brute_mix(rows, targets, share, seed=42):
    """Raking in plain Python: (doc_id, probability, kept) of rows (doc_id, text, margins)."""
    cells = {}
    for _, text, own in rows:
        cells[own] = cells.get(own, 0) + len((text or "").split())
    total = sum(cells.values())
    goals = []
    for m, power in enumerate(targets):
        have = {}
        for own, n in cells.items():
            have[own[m]] = have.get(own[m], 0) + n
        raised = {k: v**power if v else 0.0 for k, v in have.items()}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    w = dict(cells)
    for _ in range(500):
        for m, goal in enumerate(goals):
            now = {}
            for own, v in w.items():
                now[own[m]] = now.get(own[m], 0) + v
            w = {own: v * goal[own[m]] * total / now[own[m]] if now[own[m]] else v for own, v in w.items()}
    p = {own: share * w[own] / n if n else 0.0 for own, n in cells.items()}
    assert max(p.values()) < 1, "the bound is tested elsewhere"
    u = lambda i, t: int(hashlib.md5(f"{seed}:{i if i is not None else f'text:{t}'}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return [(i, p[own], u(i, t) < p[own]) for i, t, own in rows]


@pytest.mark.parametrize("max_cells", [1000, 0])
def test_mix_equals_brute_force(spark, max_cells):
    rng = np.random.default_rng(4)
    rows = [(i if i % 11 else None, "word " * int(rng.integers(0, 30)), (f"s{rng.integers(0, 3)}", str(rng.choice(["en", "en", "de"])))) for i in range(150)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, *own, "x", 1.0) for i, t, own in rows], "doc_id long, text string, src string, lng string, _id string, weight double")
    margins = {"src": F.col("src"), "lng": F.col("lng")}
    kw = {"margins": margins, "targets": {"src": 0.5, "lng": 0.3}, "share": 0.3, "max_cells": max_cells}
    want = brute_mix(rows, (0.5, 0.3), 0.3)
    got = M.mix(df, **kw).collect()
    key = lambda r: (str(r[0]), r[2], round(r[1], 9))
    assert sorted(key((r.doc_id, r.probability, r.kept)) for r in got) == sorted(map(key, want))
    if max_cells:
        stay = M.sample(df, **kw)
        assert stay.columns == df.columns
        assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(i) for i, _, k in want if k)


def test_targets_that_exclude_each_other_are_told():
    tokens, members = np.array([10.0, 10.0]), [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(UserWarning, match="exclude each other"):
        M.rake(tokens, members, [np.array([0.9, 0.1]), np.array([0.2, 0.8])])


@pytest.mark.parametrize("max_cells", [1000, 0])
def test_targets_given_as_weights(spark, max_cells):
    """A category of weight 0.25 keeps a quarter of what the others keep; expected margins within 1 %."""
    rows = [(i, "word " * (1 + i % 3), f"s{i % 3}", ["prose", "noise", "code"][i // 3 % 3 if i % 2 else 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, topic string")
    targets = {"source": M.Weights(), "topic": M.Weights({"noise": 0.25}, 1.0)}
    got = M.mix(df, margins={m: F.col(m) for m in targets}, targets=targets, share=0.5, max_cells=max_cells).collect()
    have, stay = {}, {}
    for r in got:
        for v in (r.source, r.topic):
            have[v] = have.get(v, 0) + r.n_tokens
            stay[v] = stay.get(v, 0) + r.probability * r.n_tokens
    rate = {v: stay[v] / have[v] for v in have}
    assert rate["noise"] == pytest.approx(0.25 * rate["prose"], rel=0.01) and rate["code"] == pytest.approx(rate["prose"], rel=0.01)
    assert all(rate[s] == pytest.approx(0.5, rel=0.01) for s in ("s0", "s1", "s2"))


def test_tokens_of_a_vocabulary(spark, docs, texts):
    from reefline.llm.tokenizing import library

    coder = library("byte_bpe_50k.json")
    rows = M.mix(docs, tokens=M.vocabulary_tokens()).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.filterwarnings("error:raking")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_default_targets_are_met(spark, sf):
    """On the driver's documents no margin is off, noise is cut most and prose least."""
    import os

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("the driver's tables aren't here")
    got = M.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    rate = {r.topic: r.p for r in got.groupBy("topic").agg((F.sum(F.col("probability") * F.col("n_tokens")) / F.sum("n_tokens")).alias("p")).collect()}
    assert rate["prose"] > 0.7 and rate["noise"] == min(rate.values()) < 0.3
