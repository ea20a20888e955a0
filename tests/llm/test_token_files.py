import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reefline.llm import token_files
from reefline.llm.common import new_path
from reefline.llm.tokenizing import library


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    words, runs = token_files.encode(ids)
    assert np.array_equal(token_files.decode(words, runs.astype(np.int64), len(ids)), ids)


def test_dense_words():
    words, runs = token_files.encode(np.zeros(token_files.RUN * 2, dtype=np.uint64))
    assert runs.tolist() == [0, 5, 10]  # 60 values a word, runs begin at word boundaries
    words, _ = token_files.encode(np.full(8, 1 << 61, dtype=np.uint64))
    assert len(words) == 16  # escapes


def test_files(spark, docs, texts):
    path = new_path(spark, "t")
    token_files.write_token_files(docs, path, files=4)
    rows = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.doc_id)
    coder = library("word_bpe_49k.json")
    start = 0
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_null_and_repeated_ids_and_empty(spark, empty):
    path = new_path(spark, "t")
    df = spark.createDataFrame([(5, "b"), (None, "a"), (5, "b"), (-1, None)], "doc_id long, text string")
    token_files.write_token_files(df, path, files=2)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (-1, 1), (5, 2), (5, 2)]
    path = new_path(spark, "t")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0
