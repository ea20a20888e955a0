"""The quick ways to ids against the tokenizers library, on random strings of the characters they take."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reefline.llm.tokenizing import LATIN, LETTERS, byte_bpe, library, word_bpe

CHARS = [chr(c) for c in range(1, 0x250)]
PLAIN = [c for c in CHARS if LATIN.fullmatch(c)]
WORDS = [c for c in CHARS if LETTERS.fullmatch(c)]
PIECES = ["the ", "'s", "don't", "  ", "\n\n", "\r\n", "123456", "é", "ß", "...", "<|", "日本", "I'LL", "_x_", "\t", "http://", "ÀÉ"]


def texts(chars):
    return st.lists(st.one_of(st.text(st.sampled_from(chars), max_size=12), st.sampled_from(PIECES)), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts(PLAIN))
def test_byte_vocabulary(text):
    assert byte_bpe()(text).tolist() == library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(texts(WORDS), min_size=1, max_size=4))
def test_word_vocabulary(batch):
    ids, counts = word_bpe().encode(batch)
    want = [library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids for t in batch]
    assert counts.tolist() == [len(w) for w in want]
    assert np.asarray(ids).tolist() == [i for w in want for i in w]
