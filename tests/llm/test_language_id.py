import numpy as np
from llm_fixtures import docs_of

from reefline.llm import language_id as L

WORDS = {
    "en": "the house with three windows stands where the old road turns towards water and people think about nothing else than weather",
    "de": "das haus mit drei fenstern steht dort wo die alte straße sich zum wasser wendet und menschen denken über nichts als wetter",
    "ru": "дом с тремя окнами стоит там где старая дорога поворачивает к воде и люди думают только о погоде",
}


def labelled(spark):
    rows = []
    for lang, text in WORDS.items():
        w = text.split()
        rows += [(" ".join(w[i:] + w[:i]), lang) for i in range(len(w))]
    return spark.createDataFrame([*rows, (None, "en"), ("no label", None)], "text string, lang string")


def test_labels_spans_and_odd_texts(spark, texts, empty):
    model = L.train(labelled(spark))
    assert model.langs == ["de", "en", "ru"]
    mixed = WORDS["en"] + " " + WORDS["de"]
    own = [*WORDS.values(), mixed, None, "", "123 !!", "ДОМ с", WORDS["en"] * 2000]
    rows = {r.doc_id: r for r in L.identify(docs_of(spark, own), model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["en", "de", "ru"]
    assert [s.lang for s in rows[3].spans] == ["en", "de"]
    assert sum(s.words for s in rows[3].spans) == rows[3].n_words
    assert 0.4 < rows[3].score < 0.6
    assert [(rows[i].lang_pred, rows[i].score, rows[i].spans) for i in (4, 5, 6)] == [("und", 0.0, [])] * 3
    assert rows[7].lang_pred == "ru" and rows[8].lang_pred == "en" and len(rows[8].spans) == 1
    assert L.identify(empty, model).count() == 0
    assert L.identify(docs_of(spark, texts), model).count() == len(texts)


def test_nothing_learned(spark):
    model = L.train(labelled(spark).where("lang is null"))
    assert {r.lang_pred for r in L.identify(docs_of(spark, ["abc", None]), model).collect()} == {"und"}


def test_viterbi_equals_plain(spark):
    rng = np.random.default_rng(5)
    words = np.array([0, 1, 63, 64, 65, 200, 3])
    emit = rng.normal(0, 3, (int(words.sum()), 3)).astype(np.float32)
    got = L.viterbi(emit, words, 4.0)
    at = 0
    for n in words:
        e = emit[at : at + n].astype(np.float64)
        if n:
            best, back = e[0].copy(), []
            for row in e[1:]:
                stay, move = best, best.max() - 4.0
                back.append(np.where(move > stay, best.argmax(), np.arange(3)))
                best = np.maximum(stay, move) + row
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            value = lambda p: sum(e[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
            assert abs(value(path[::-1]) - value(got[at : at + n].tolist())) < 1e-3
        at += n
