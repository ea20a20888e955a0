from collections import Counter

from pyspark.sql import functions as F

from reefline.llm import line_dedup as D


def test_html_lines_and_hosts(spark):
    html = '<html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body><!-- no --><p>One <b>two</b><br>three</p><div> </div>&lt;q&gt;</body>'
    df = spark.createDataFrame([(html, "HTTP://User@WWW.Ex.org:80/a?b"), (None, None), ("", "nohost")], "html string, url string")
    rows = df.select(D.html_lines(F.col("html")).alias("l"), D.host_of(F.col("url")).alias("h")).collect()
    assert rows[0].l == ["T & x", "One two", "three", "<q>"] and rows[0].h == "www.ex.org"
    assert rows[1].l == [] and rows[1].h == "" and rows[2].h == ""


def test_equals_brute_force(spark):
    pages = []
    for i in range(90):
        host = "big.org" if i % 3 else f"h{i % 6}.org"
        lines = ["menu", f"only {i}", "menu" if i % 2 else f"part {i % 4}", "footer " + host]
        pages.append((i, f"https://{host}/{i}", "\n".join(lines), "x", "y"))
    pages += [(90, None, None, "x", "y"), (91, "https://solo.org", "menu\n\nmenu", "x", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, body string, _key string, host string")
    got = {r.page_id: (r.host, r.n_lines, r.n_kept, r.text) for r in D.drop_boilerplate(df, "page_id", D.host_of(F.col("url")), D.text_lines(F.col("body")), ratio=0.3, min_pages=3).collect()}
    host = lambda u: u.split("/")[2] if u else ""
    split = lambda b: [x for x in (y.strip() for y in (b or "").split("\n")) if x]
    per_site = Counter(host(p[1]) for p in pages)
    per_line = Counter((host(p[1]), x) for p in pages for x in set(split(p[2])))
    for p in pages:
        h, lines = host(p[1]), split(p[2])
        kept = [x for x in lines if not (per_line[h, x] >= 3 and per_line[h, x] > 0.3 * per_site[h])]
        assert got[p[0]] == (h, len(lines), len(kept), "\n".join(kept))
    assert D.drop_boilerplate(df.limit(0), "page_id", D.host_of(F.col("url")), D.text_lines(F.col("body"))).count() == 0
