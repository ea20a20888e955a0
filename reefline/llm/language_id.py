"""Language identification: script ranges narrow the candidates of each word, words are scored by
letter trigrams, and Viterbi decoding with a switching penalty labels the spans of a text.

Everything runs on whole batches in NumPy. A text's words are decoded in segments of 64, from each start
language side by side, and the segments are then joined, so a very long text needs no long loop.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, small_batches, workspace

#: First code points of the script ranges, and their scripts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x31A0, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_FIRSTS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS], dtype=np.uint8)
BITS = 16
SEGMENT = 64
#: Characters that are worked on at once.
CHUNK = 1 << 19


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter; combining marks belong to their words."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # trigram hash x language
    script: np.ndarray  # script x language: 0 for candidates
    switch: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' letters, one after another: trigram hashes; of their words: first letter's place
    among the letters, letters, script; and words of each text."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    x = np.where(is_letter, points, 0).astype(np.uint32)
    before = np.concatenate([[0], x[:-1]]).astype(np.uint32)
    after = np.concatenate([x[1:], [0]]).astype(np.uint32)
    mixed = x * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    hashed = (mixed >> np.uint32(32 - BITS))[is_letter]
    starts = np.flatnonzero(is_letter & (before == 0))
    rank = np.cumsum(is_letter) - 1
    first = rank[starts]
    sizes = np.diff(np.append(first, len(hashed)))
    script = _SCRIPT[np.searchsorted(_FIRSTS, points[starts], side="right") - 1]
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    return hashed, first, sizes, script, np.diff(np.concatenate([[0], upto]))


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, rows_per_lang: int = 4000, switch: float = 12.0) -> Model:
    """Learns from rows with a label. At most about ``rows_per_lang`` rows of each language are used,
    chosen by a hash of the text; the driver gets one number for each trigram hash, script and language."""
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    per_lang = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(_NAMES), 0), np.float32), switch)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, rows_per_lang / per_lang[k]))]), F.col("lang"))
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    at = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(langs), (1 << BITS) + len(_NAMES)), dtype=np.int64)
        for batch in batches:
            rows = batch.to_pydict()
            for lang in set(rows["lang"]):
                for texts in chunks(t for t, k in zip(rows["text"], rows["lang"], strict=True) if k == lang):
                    hashed, _, sizes, script, _ = features(texts)
                    seen[at[lang]] += np.bincount(hashed, minlength=seen.shape[1])
                    seen[at[lang], 1 << BITS :] += np.bincount(script, weights=sizes, minlength=len(_NAMES)).astype(np.int64)
        lang, feature = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(feature), pa.array(seen[lang, feature])], ["lang", "feature", "n"])

    counts = np.zeros((len(langs), (1 << BITS) + len(_NAMES)))
    with small_batches(labelled.sparkSession):
        for r in drawn.mapInArrow(count, "lang long, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.lang, r.feature] = r.n
    grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
    score = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * (1 << BITS)))
    score -= score.max(0, keepdims=True)  # only differences matter
    candidate = scripts >= 0.001 * np.maximum(scripts.sum(1, keepdims=True), 1)
    candidate |= ~candidate.any(0)  # a script that no language has leaves all of them
    return Model(langs, score.T.astype(np.float32).copy(), np.where(candidate, 0, -1e4).T.astype(np.float32).copy(), switch)


def viterbi(emit: np.ndarray, words: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word. emit: word x language; words: of each text."""
    n_langs = emit.shape[1]
    segs = -(-words // SEGMENT)
    total = int(segs.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    seg_text = np.repeat(np.arange(len(words)), segs)
    seg_nth = np.arange(total) - np.repeat(np.cumsum(segs) - segs, segs)
    seg_first = (np.cumsum(words) - words)[seg_text] + seg_nth * SEGMENT
    seg_words = np.minimum(words[seg_text] - seg_nth * SEGMENT, SEGMENT)
    best = np.full((total, n_langs, n_langs), -1e9, dtype=np.float32)  # segment x language before it x language
    best[:, np.arange(n_langs), np.arange(n_langs)] = 0
    came = np.zeros((SEGMENT, total, n_langs, n_langs), dtype=np.uint8)
    order = np.argsort(-seg_words, kind="stable")
    alive = np.searchsorted(-seg_words[order], -np.arange(SEGMENT), side="left")
    best, own = best[order], np.arange(n_langs, dtype=np.uint8)
    for t in range(SEGMENT):
        k = alive[t]
        if not k:
            break
        b = best[:k]
        top = b.argmax(2)
        moved = np.take_along_axis(b, top[:, :, None], 2) - np.float32(switch)
        came[t, :k] = np.where(moved > b, top[:, :, None], own)
        best[:k] = np.maximum(b, moved) + emit[seg_first[order[:k]] + t][:, None, :]
    back = np.empty_like(order)
    back[order] = np.arange(total)
    best = best[back]
    # Along each text's segments.
    first_seg = np.cumsum(segs) - segs
    upto = np.zeros((len(words), n_langs), dtype=np.float64)
    before = np.zeros((total, n_langs), dtype=np.uint8)
    texts = np.argsort(-segs, kind="stable")
    for s in range(int(segs.max())):
        live = texts[: np.searchsorted(-segs[texts], -s, side="left")]
        reach = upto[live][:, :, None] + best[first_seg[live] + s]
        before[first_seg[live] + s] = reach.argmax(1)
        upto[live] = reach.max(1)
        upto[live] -= upto[live].max(1, keepdims=True)
    state_end = np.zeros(total, dtype=np.int64)
    state_start = np.zeros(total, dtype=np.int64)
    now = upto.argmax(1)
    for s in range(int(segs.max()) - 1, -1, -1):
        live = texts[: np.searchsorted(-segs[texts], -s, side="left")]
        at = first_seg[live] + s
        state_end[at] = now[live]
        now[live] = state_start[at] = before[at, now[live]]
    out = np.zeros(int(words.sum()), dtype=np.int64)
    state, start = state_end[order].copy(), state_start[order]
    for t in range(SEGMENT - 1, -1, -1):
        k = alive[t]
        if not k:
            continue
        out[seg_first[order[:k]] + t] = state[:k]
        state[:k] = came[t, np.arange(k), start[:k], state[:k]]
    return out


RESULT = "lang_pred string, score double, n_words long, spans array<struct<lang:string,start:int,words:int>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, with_spans: bool = True, lazy: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_words, spans): the language that holds the most letters, its share of
    the letters, the number of words (runs of letters), and the labelled spans of words.

    A text that is null or has no letter is "und" with score 0 and no spans, and so is every text if the
    model learned no language. Ties go to the language that sorts first. Rows that repeat an id are
    judged each for itself. Other columns are ignored. ``with_spans``: else spans is null. ``lazy``: a plan
    for the caller to write, in Arrow batches of the session's size, else a table written in small ones.
    """

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.langs)
        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() or "" for x in batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                hashed, first, sizes, script, words = features(texts)
                share = np.zeros((len(texts), max(n, 1)))
                spans: list | None = None
                if n and len(first):
                    emit = np.add.reduceat(model.score[hashed], first, axis=0) + model.script[script]
                    path = viterbi(emit, words, model.switch)
                    text_of = np.repeat(np.arange(len(texts)), words)
                    share = np.bincount(text_of * n + path, weights=sizes, minlength=len(texts) * n).reshape(len(texts), n)
                    if with_spans:
                        cuts = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])]))
                        begin = (np.cumsum(words) - words)[text_of[cuts]]
                        size = np.diff(np.append(cuts, len(path)))
                        spans = [[] for _ in texts]
                        for t, lang, a, m in zip(text_of[cuts].tolist(), path[cuts].tolist(), (cuts - begin).tolist(), size.tolist(), strict=True):
                            spans[t].append({"lang": model.langs[lang], "start": a, "words": m})
                total = share.sum(1)
                pick = share.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([model.langs[k] if s else "und" for k, s in zip(pick.tolist(), total.tolist(), strict=True)], pa.string()),
                        pa.array(share[np.arange(len(texts)), pick] / np.maximum(total, 1)),
                        pa.array(words.astype(np.int64)),
                        pa.array(spans if spans is not None else [[] if with_spans else None for _ in texts], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))),
                    ],
                    ["_id", "lang_pred", "score", "n_words", "spans"],
                )

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    labelled = source.mapInArrow(label, f"_id {kind}, {RESULT}").withColumnRenamed("_id", id_col)
    if lazy:
        return labelled
    with workspace(docs.sparkSession, "languages"), small_batches(docs.sparkSession):
        return kept(labelled, "languages-result")
