"""Fast ways to the ids of the public vocabularies, equal to those of the tokenizers library.

Texts of plain Latin characters go a quick way; all others go through the library itself. What is
quick about it is a faster coder that gets the same merges in the same order.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Characters on which the libraries' white space, letters, digits, NFC and lower case agree.
LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xffĀ-įı-ňŊ-ž]*")
#: Plain texts of the word vocabulary: without apostrophes, whose contractions its pattern splits.
LETTERS = re.compile("[\t\n\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
MARK, SPACE, LETTER, DIGIT, SYMBOL = b"\x01", 0, 1, 2, 3
#: What each byte of such a text is.
KIND = np.array([LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SPACE if b in b" \t\n\r" else SYMBOL for b in range(256)], dtype=np.uint8)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; REEFLINE_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("REEFLINE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(name: str):
    """The vocabulary's coder in the tokenizers library; loaded by workers that meet a text for it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@cache
def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """text -> ids of ``name``.json without special tokens added."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if LATIN.fullmatch(text) and "<|" not in text:  # "<|": a special token's name, which the library finds in the text
            return np.array(quick.encode_ordinary(text), dtype=np.uint32)
        return np.array(library(f"{name}.json").encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


class WordBpe:
    """Ids of the word vocabulary for batches of texts.

    The quick coder gets each word with an end mark; pairs of a byte and the mark have the lowest ranks, so
    they are joined first, as the vocabulary's word-end symbols are, and its merges follow in their order.
    """

    def __init__(self, name: str = "word_bpe_49k.json"):
        import tiktoken

        self.name = name
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab, end = model["vocab"], model["end_of_word_suffix"]

        def plain(token: str) -> bytes:
            return bytes(byte_of[c] for c in token.removesuffix(end)) + MARK * token.endswith(end)

        ranks, ids = {}, []
        letters = byte_letters()
        for tail, mark in (("", b""), (end, MARK)):
            for b in range(256):
                ranks[bytes([b]) + mark] = len(ids)
                ids.append(vocab[letters[b] + tail])
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if (joined := plain(left) + plain(right)) not in ranks:
                ranks[joined] = len(ids)
                ids.append(vocab[left + right])
        self.id_of = np.array(ids, dtype=np.uint32)
        self.is_end = np.array([len(r) > 1 and r[-1:] == MARK for r in ranks])
        self.quick = tiktoken.Encoding(name, pat_str="[^\\x01]+\\x01", mergeable_ranks=ranks, special_tokens={})

    def marked(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """The words of plain texts, each with its end mark, and words of each text."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        kind = KIND[data]
        after = np.append(kind[1:], 0)
        last = ((kind != after) | (kind == DIGIT)) & (kind != 0)
        kept = np.flatnonzero(kind)
        ends = last[kept]
        place = np.arange(len(kept)) + np.cumsum(ends) - ends
        out = np.full(len(kept) + int(ends.sum()), MARK[0], dtype=np.uint8)
        out[place] = data[kept]
        upto = np.cumsum([len(r) + 1 for r in raw])
        return out.tobytes(), np.diff(np.concatenate([[0], np.searchsorted(np.flatnonzero(last), upto)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        plain = [bool(LETTERS.fullmatch(t)) and "<|" not in t for t in texts]
        marked, words = self.marked([t if p else "" for t, p in zip(texts, plain, strict=True)])
        ranks = np.asarray(self.quick.encode_to_numpy(marked.decode(), disallowed_special=()), dtype=np.int64)
        ids = self.id_of[ranks]
        upto = np.concatenate([[0], np.flatnonzero(self.is_end[ranks]) + 1])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(upto)
        if all(plain):
            return ids, counts
        parts, at = [], 0
        for k, p in enumerate(plain):
            if p:
                parts.append(ids[at : at + counts[k]])
                at += counts[k]
            else:
                own = np.array(library(self.name).encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
                counts[k] = len(own)
                parts.append(own)
        return np.concatenate(parts), counts


@cache
def word_bpe(name: str = "word_bpe_49k.json") -> WordBpe:
    return WordBpe(name)
