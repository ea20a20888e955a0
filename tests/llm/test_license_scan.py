import re

from llm_fixtures import docs_of, prose

from reefline.llm import license_scan as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hits = [(i, t.label) for t in S.PHRASES for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def test_base_equals_brute_force(spark, texts):
    filler = prose(4, 31)
    own = [
        *texts,
        "Licensed under CC BY-NC 4.0.",
        "(MIT License)mit license; MITKLicense",
        f"{filler} gnu general public license {filler} Apache-License",
        *[f"{prose(2, n)} GNU General Public License" for n in range(28, 36)],  # across the borders of blocks
        "cc by cc by cc, by",
        "general gnu public license",
        "mİt license KMIT",
        prose(1, 3000) + " apache license",
    ]
    got = {r.doc_id: r for r in S.scan(docs_of(spark, own)).collect()}
    assert len(got) == len(own)
    for i, t in enumerate(own):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_notices(spark, empty):
    own = ["This work is licensed under the GNU General Public License, version 3.", "licensed under the mozilla license", "Redistribution and use in source and binary forms, with or without changes are permitted", "free"]
    rows = {r.doc_id: r for r in S.scan(docs_of(spark, own)).collect()}
    assert rows[0].labels == "gpl,gpl-3.0" and rows[0].score == 1.0
    assert rows[1].labels == "" and rows[3].labels == ""
    assert rows[2].labels == "bsd" and rows[2].n_base == 0 and 0.8 <= rows[2].score < 1
    assert S.scan(empty).count() == 0
    df = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_words) for r in S.scan(df).collect()) == [("1", 2), ("1", 2), ("None", 2)]


def brute_notices(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    labels = {t.label for t in S.PHRASES if t.text in " ".join(words)}
    score = 1.0 if labels else 0.0
    for stride in {t.stride for t in S.NOTICES}:
        for k in range(0, max(len(words), 1), stride):
            block = set(words[k : k + 2 * stride])
            shares = {t: len(block & set(t.words)) / len(set(t.words)) for t in S.NOTICES if t.stride == stride}
            best = {}
            for t, share in shares.items():
                best[t.family or t.text] = max(best.get(t.family or t.text, 0.8), share)
            found = {t: share for t, share in shares.items() if share >= best[t.family or t.text]}
            labels |= {t.label for t in found}
            score = max([score, *found.values()])
    return ",".join(sorted(labels)), score


def test_all_notices_of_a_block(spark):
    bsd, isc = (next(t.text for t in S.NOTICES if t.label == k) for k in ("bsd", "isc"))
    apache = "Licensed under the Apache License, Version 2.0."
    own = [
        f"{apache} {bsd.replace('modification', 'changes')}",
        f"{isc.replace('hereby', 'herewith')} {apache}",
        f"{prose(3, 25)} {apache} {prose(5, 20)} {bsd.replace('source', 'text')} {prose(6, 90)} {isc}",
        "Licensed under the GNU General Public License version 3",
        f"licensed under the gnu lesser general public license; {bsd.replace('forms', 'form')}",
        *[t.text for t in S.NOTICES],
    ]
    got = {r.doc_id: (r.labels, r.score) for r in S.scan(docs_of(spark, own)).collect()}
    assert got == {i: brute_notices(t) for i, t in enumerate(own)}
    assert got[0][0] == "apache,apache-2.0,bsd" and got[1][0] == "apache,apache-2.0,isc" and got[3][0] == "gpl,gpl-3.0"


def test_whole_licenses(spark):
    """Texts of more words than the least stride, anywhere in a text, with words changed or left out."""
    long = [t for t in S.NOTICES if len(t.words) > S.STRIDE]
    assert long
    own = []
    for k, t in enumerate(long):
        words = list(t.words)
        own += [f"{prose(k, 37)} {t.text} {prose(k + 1, 300)}", " ".join(w for i, w in enumerate(words) if i % 9), " ".join(words[: len(words) // 2]), f"{prose(k, 250)} {' '.join(words[::-1])}"]
    got = {r.doc_id: (r.labels, r.score) for r in S.scan(docs_of(spark, own)).collect()}
    assert got == {i: brute_notices(t) for i, t in enumerate(own)}
    assert all(t.label in got[4 * k][0].split(",") and got[4 * k][1] == 1.0 for k, t in enumerate(long))


def test_rows_of_one_id_keep_their_words_apart(spark):
    half = S.NOTICES[0].text.split()
    df = spark.createDataFrame([(1, " ".join(half[:4])), (1, " ".join(half[4:])), (None, "mit license"), (None, "x"), (2, S.NOTICES[0].text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels) for r in S.scan(df).collect()) == [("1", ""), ("1", ""), ("2", "gpl,gpl-3.0"), ("None", ""), ("None", "mit")]
