import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SCHEMA, docs_of
from pyspark.sql import functions as F

from reefline.llm.automaton import line_automaton
from reefline.llm.fill_in_middle import SENTINELS, fill_in_middle, restored

MACHINE = line_automaton(SENTINELS)


def brute(doc_id, text, seed="7", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


HARD = [
    None, "", "\n", "\n\n\n", "a", "a\n", "\na", "one\ntwo\nthree", "no end\n\n", "<P>", "x<S>y", "<<M>", "<P", "P>", "<P\n>", "<", "<S", "<M<", "ä\nö\n\U0001f600 ß\n",
    "line\r\nnext\r\n", "<p>\n<s>\n", "a<\nS>\n", "tail <", "é" * 50 + "\n" + "\n".join("zeile %d ü" % k for k in range(300)), "\n" * 500, "x" * 5000, "\n".join(f"l{k} <" for k in range(700)) + "<M>",
]


def rows_of(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


@pytest.mark.parametrize(("chunk", "fan"), [(1 << 14, 64), (7, 2), (1, 3), (256, 4)])
def test_equals_brute_force(spark, texts, chunk, fan):
    texts = [*HARD, *texts]
    if chunk < 256:
        texts = [t for t in texts if t is None or len(t) < 2000]
    docs = docs_of(spark, texts)
    out = fill_in_middle(docs, chunk=chunk, fan=fan)
    assert rows_of(out) == sorted(((i, *brute(i, t)) for i, t in enumerate(texts)), key=lambda r: (r[0], r[-1]))
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_rates_and_ids(spark):
    rows = [(None, "a\nb\nc", None, None, 0, "", 0, "", "", 0), (5, "a\nb\nc", None, None, 0, "", 0, "", "", 0), (5, "a\nb\nc", None, None, 0, "", 0, "", "", 0), (5, "other\ntext\n", None, None, 0, "", 0, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for rate, spm in ((100, 0), (100, 100), (0, 50), (50, 50)):
        for chunk in (1 << 14, 2):
            got = rows_of(fill_in_middle(docs, rate=rate, spm=spm, chunk=chunk, seed="s"))
            assert got == sorted(((r[0], *brute(r[0], r[1], "s", rate, spm)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


def test_empty(spark, empty):
    assert fill_in_middle(empty).collect() == []


def test_sentinels_are_checked(docs):
    with pytest.raises(ValueError, match="sentinels"):
        fill_in_middle(docs, sentinels=("<P>", "<P>", "<M>"))


@settings(max_examples=150, deadline=None)
@given(st.text("ab<PSM>\nü", max_size=60), st.integers(1, 9))
def test_functions_compose(text, size):
    """Stretches' functions, composed one after another, give what a reader finds; so do places of events."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = [k for k in range(len(data)) if k == 0 or data[k - 1] == 10]
    state, events = 0, 0
    for k in range(0, len(data), size):
        part = data[k : k + size]
        levels = MACHINE.levels(part)
        after, count = levels[-1]
        for rank in range(int(count[0, state])):
            assert k + MACHINE.place(part, levels, state, rank) == starts[events + rank]
        state, events = int(after[0, state]), events + int(count[0, state])
    assert events == len(starts) == len(re.findall(r"[^\n]*\n|[^\n]+", text))
    assert bool(MACHINE.accepts[state]) == any(s in text for s in SENTINELS)


def test_machine_of_other_marks():
    machine = line_automaton(("abab", "abc", "ß"))
    for text in ("aabab", "ababc", "abc", "xß", "aba", "ab", "abaabac", "é"):
        after, _ = machine.levels(np.frombuffer(text.encode(), np.uint8))[-1]
        assert bool(machine.accepts[after[0, 0]]) == any(m in text for m in ("abab", "abc", "ß"))
