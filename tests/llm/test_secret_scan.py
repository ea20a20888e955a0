import re

from llm_fixtures import docs_of
from pyspark.sql import functions as F

from reefline.llm.secret_scan import KINDS, REACH, secret_spans, shown

AWS = "AKIA" + "Q7" * 8
BASE = [
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(spans)


def brute(text):
    """All spans: base ones, and weak ones whose complements are in reach in their scope, over all pairs."""
    text = text or ""
    own = base(text)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    weak = []
    for k, kind in enumerate(KINDS):
        if kind.needs:
            weak += [(m.start(), k, m.end()) for m in re.finditer(kind.pattern, low) if len(m[kind.group]) >= kind.least]
    weak = [w for w in weak if not any(b[0] < w[2] and b[2] > w[0] for b in own)]
    ends = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda s: sum(e <= s[0] for e in ends)
    out = list(own)
    for w in weak:
        near = [p for p in own + weak if scope(p) == scope(w) and max(p[0], w[0]) - min(p[2], w[2]) <= REACH]
        roles = 0
        for p in near:
            roles |= KINDS[p[1]].role
        if roles & KINDS[w[1]].needs == KINDS[w[1]].needs:
            out.append(w)
    return sorted(out)


HARD = [
    "password = hunter22", "user: bob\npassword = hunter22", "user: bob\n\npassword = hunter22", "user: bob\n \t\r\npassword: hunter22", "host = db.example.org\nuser = admin\npwd = s3cret!",
    "https://example.org/login is a page. Ask the user: bob", f"key {AWS} here", f"{AWS} token: abcdefghijkl\nregion = eu-west-1", "API_KEY='abcdefghijklmnop'", "api_key = short", "apikey:AbCdEfGhIjKl+/=",
    "toKen=abcdefghijklmnop", "token=secret= abcdefghijklmnop", "0123456789abcdef" * 3, "0123456789ABCDEF" * 2, "deadbeefdeadbee", "AKIAAKIA1234567890", "AKIA1234", "xAKIA" + "A" * 14,
    "user=bob" + " " * 195 + "pwd=abcdef", "user=bob" + " " * 201 + "pwd=abcdef", "ü\U0001f600 user=bob\npass: geheim1", "token token token=", "user = x", "token" + " " * 3000 + "= abcdefghijkl",
    "pwd=abcdef\n" * 200 + "user=someone", "a" * 3000 + "://host", "user=bob " + "f" * 2000 + " pwd=abcdef", "endpoint: api.example.org secret: tinysec account: 12345", "\n\n\nuser=bob\n\n\npwd=abcdef\nuser=eve",
]


def test_equals_brute_force(spark, texts):
    texts = [*HARD, *HARD[:3], *texts, "\n".join(HARD), "\n\n".join(HARD) * 3]
    for stretch in (512, 16):
        rows = {r.doc_id: r for r in secret_spans(docs_of(spark, texts), stretch=stretch).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            assert [tuple(s) for s in rows[i].base] == base(t), t
            assert [tuple(s) for s in rows[i].spans] == brute(t), t


def test_weak_ones_need_complements(spark):
    out = secret_spans(docs_of(spark, HARD[:5])).select("doc_id", shown(F.col("spans")).alias("s"))
    got = {r.doc_id: r.s for r in out.collect()}
    assert got == {0: "", 1: "identifier:0:9,secret:10:29", 2: "", 3: "", 4: "endpoint:0:21,identifier:22:34,secret:35:48"}


def test_rows_without_or_with_equal_ids(spark):
    rows = [(None, "user=bob"), (None, "pwd=abcdef"), (7, "user=bob"), (7, "pwd=abcdef"), (7, "user=bob pwd=abcdef")]
    got = sorted(len(r.spans) for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, 0, 0, 0, 2]


def test_empty(spark, empty):
    assert secret_spans(empty).collect() == []
