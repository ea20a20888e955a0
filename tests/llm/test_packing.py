import zlib
from collections import defaultdict

import numpy as np
from llm_fixtures import docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from reefline.llm import packing
from reefline.llm.tokenizing import byte_bpe, library, word_bpe


def one_by_one(lengths, capacity):
    """Best-two-fit bin by bin."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap:
            small = min(bin_)
            best, pair = small, None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    if best < left[i] + left[j] <= small + gap:
                        best, pair = left[i] + left[j], (left[i], left[j])
            if pair:
                bin_.remove(small)
                for x in pair:
                    left.remove(x)
                    bin_.append(x)
                left.append(small)
                left.sort(reverse=True)
        bins.append(sorted(bin_))
    return bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_histogram_packs_as_bin_by_bin(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    patterns = packing.best_two_fit(dict(counts), 30)
    packed = [sorted(k for k, n in items.items() for _ in range(n)) for items, bins in patterns for _ in range(bins)]
    assert sorted(x for b in packed for x in b) == sorted(lengths)
    assert all(sum(b) <= 30 for b in packed)
    want = one_by_one(lengths, 30)
    assert len(packed) == len(want)
    assert sorted(map(sum, packed)) == sorted(map(sum, want))


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_pieces_and_places(spark, docs, texts):
    rows = packing.pack_documents(docs, capacity=64, with_ids=True).collect()
    coder = library("byte_bpe_50k.json")
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == packing.cut(len(ids), 64)
        for p in pieces:
            data = ids[p.start : p.start + p.length].tobytes()
            assert bytes(p.ids) == data and p.ids_crc32 == zlib.crc32(data)
    in_sequence = defaultdict(list)
    for r in rows:
        in_sequence[r.sequence_id].append((r.offset, r.length))
    for places in in_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack_documents(docs, capacity=64, with_ids=True)).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(r.length for r in rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())


def test_repeated_rows_null_ids_and_empty(spark, empty):
    assert packing.pack_documents(empty).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_one_length_for_many(spark):
    df = docs_of(spark, ["same text"] * 300)
    rows = packing.pack_documents(df, capacity=9).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 300
    assert len({r.sequence_id for r in rows}) == 100


def test_quick_coders_equal_the_library(texts):
    odd = [*(t or "" for t in texts), "don't STOP I'll", "ÀÉß Ÿ ŉ ſ ĸ", "a\x0bb\x0cc\x1cd\x85e\xa0f\xadg", "½ ²³ ª º µ ×÷", "12 345x_y--z!!'s", "tabs\t\tand\r\nlines "]
    full = library("byte_bpe_50k.json")
    for t in odd:
        assert byte_bpe()(t).tolist() == full.encode(t, add_special_tokens=False).ids
    ids, counts = word_bpe().encode(odd)
    want = [library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids for t in odd]
    assert ids.tolist() == [i for w in want for i in w]
    assert counts.tolist() == [len(w) for w in want]
