"""The queries on the smallest tables: against their SQL where there is one, else against brute force."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_license_scan import brute as base_labels

from reefline.llm.packing import cut
from reefline.llm.queries import QUERIES, SQL
from reefline.llm.tokenizing import library

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_op1(spark, documents):
    rows = QUERIES["op1_best_fit_packing"](spark, DATA).collect()
    coder, by_doc, total = library("byte_bpe_50k.json"), defaultdict(dict), 0
    for r in rows:
        by_doc[r.doc_id][r.piece] = r
    for doc, text, _ in documents:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 2048))]
        assert [(k, r.start, r.length, r.ids_crc32) for k, r in sorted(by_doc[doc].items())] == want
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-total // 2048) * 1.02 + 1


def test_op2(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op2_token_binary"](spark, DATA).collect()}
    coder, start = library("word_bpe_49k.json"), 0
    for doc, text, _ in documents:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, DATA).collect()}
    assert len(rows) == len(documents)
    held = [(doc, lang) for doc, _, lang in documents if zlib.crc32(str(doc).encode()) % 5 == 0]
    assert {d for d, r in rows.items() if r.held_out} == {d for d, _ in held}
    assert np.mean([rows[d].lang_pred == lang for d, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_op6(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, DATA).collect()}
    for doc, text, _ in documents:
        r = rows[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_labels(text)


def test_op9(spark, documents):
    """What lies between entities stays in every text, and replacements are one to one and of one kind."""
    regex = pytest.importorskip("regex")
    from reefline.llm import pii
    from test_pii import iban_ok, luhn

    rows = {r.doc_id: r for r in QUERIES["op9_pii_surrogates"](spark, DATA).collect()}
    find, new_of, n = regex.compile(pii.pattern()), {}, 0
    bare = lambda x: re.sub("[ -]", "", x)
    for doc, text, _ in documents:
        found = [m for m in find.finditer(text or "") if not (re.fullmatch(r"[\d -]{13,19}", m[0]) and len(bare(m[0])) > 12 and not luhn(bare(m[0]))) and not (re.match(r"[A-Z]{2}\d{2}[A-Z0-9 ]{8}", m[0]) and not iban_ok(bare(m[0])))]
        if any(regex.match(pii._TITLED, m[0]) for m in found):
            continue  # names are followed through their text: see test_pii
        assert rows[doc].n_entities == len(found)
        if not found:
            assert rows[doc].text == text
            continue
        ends = [0, *[x for m in found for x in m.span()], len(text)]
        gaps = [re.escape(text[a:b]) for a, b in zip(ends[::2], ends[1::2], strict=True)]
        got = re.fullmatch("(.+?)".join(gaps), rows[doc].text, re.S)
        assert got, (text[:200], rows[doc].text[:200])
        for m, new in zip(found, got.groups(), strict=True):
            assert new != m[0] and new_of.setdefault(m[0], new) == new
            n += 1
    assert n > 20 and len(set(new_of.values())) == len(new_of)


@pytest.mark.parametrize("name", ["op9_pii_surrogates", "op10_mixing"])
def test_whole_tables(spark, documents, name):
    assert Counter(r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()) == Counter(d for d, *_ in documents)
