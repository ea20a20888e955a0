"""The thin queries of the operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import embedding_dedup, exact_dedup, fill_in_middle, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, pii, secret_scan, token_files, vector_codes
from reefline.llm.common import new_path, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return line_dedup.drop_boilerplate(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), width=4, threshold="0.85")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language_id.train(docs.where(remainder != 0))
    span = lambda x: F.concat_ws("", x["lang"], F.lit(":"), x["start"], F.lit("+"), x["words"])
    return language_id.identify(docs, model).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", F.array_join(F.transform("spans", span), ",").alias("spans")
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="reefline")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), tokens=mixing.vocabulary_tokens())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    counts = [secret_scan.number(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return spans.select("doc_id", *counts, F.sha2(secret_scan.shown(F.col("base")), 256).alias("base_sha256"), secret_scan.shown(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed="7", rate=100, spm=50)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NOTICES = ", ".join(
    f"({k}, '{t.label}', '{t.family or k}', {t.stride}, {license_scan.needed(t, 0.8)}, {_list(tuple(sorted(set(t.words))))})" for k, t in enumerate(license_scan.NOTICES)
)
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{t.label}' AS label, unnest([CAST(i - 1 AS BIGINT) FOR i IN range(1, len(w) + 1) IF w[i:i + {len(t.words) - 1}] = {_list(t.words)}]) AS pos FROM d" for t in license_scan.PHRASES
)
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(k, label, family, stride, need, words) AS (VALUES {_NOTICES}),
b AS (SELECT doc_id, stride, block, list_distinct(w[block * stride + 1:(block + 2) * stride]) AS s
      FROM (SELECT doc_id, w, stride, unnest(range(0, CAST(ceil(len(w) / stride) AS BIGINT))) AS block FROM d, (SELECT DISTINCT stride FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(s, words)) / CAST(len(words) AS DOUBLE) AS share, stride, block, family, need, len(words) AS n FROM b JOIN t USING (stride)),
q AS (SELECT doc_id, label, NULL AS pos, share FROM m WHERE share * n >= need - 0.5 QUALIFY share = max(share) OVER (PARTITION BY doc_id, stride, block, family)),
f AS (SELECT doc_id, label, pos, 1.0 AS share FROM ({_PLACES}) UNION ALL SELECT * FROM q),
a AS (SELECT doc_id, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, max(share) AS score,
             coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (pos IS NOT NULL)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM f GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_binary,
        op3_line_dedup,
        op4_jaccard_join,
        op5_language_id,
        op6_license_scan,
        op7_embedding_dedup,
        op8_exact_dedup,
        op9_pii_surrogates,
        op10_mixing,
        op11_vector_codes,
        op12_secret_scan,
        op13_fill_in_middle,
    )
}
_BLANKS = "' ' || chr(9) || chr(13) || chr(12) || chr(160)"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.UNSEEN}', '', 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in line_dedup.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_entity}', {"chr(39)" if _char == "'" else repr(_char)})"
OP3_SQL = f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         [trim(x, {_BLANKS}) FOR x IN string_split({_TEXT}, chr(10)) IF trim(x, {_BLANKS}) <> ''] AS lines FROM pages),
site AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) JOIN site USING (host)
        GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.1 * pages),
l AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM p),
k AS (SELECT l.page_id, count(*) AS n, string_agg(l.line, chr(10) ORDER BY l.k) AS text FROM l LEFT JOIN bad USING (host, line) WHERE bad.line IS NULL GROUP BY 1)
SELECT p.page_id, p.host, CAST(len(lines) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS n_kept, coalesce(k.text, '') AS text FROM p LEFT JOIN k USING (page_id)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.reach = e2.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0
         AND len([y FOR y IN embedding IF y <> 0]) > 0 AS ok FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

OP11_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM q, range(4) AS g(part)),
c0 AS MATERIALIZED (
  SELECT part, k, x AS y FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM q QUALIFY k < 256) USING (r)),
"""
for _round in range(5):
    OP11_SQL += f"""
a{_round} AS MATERIALIZED (
  SELECT r, part, x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS BIGINT) * 256 + k) AS best
  FROM (SELECT r, part, CAST(x AS DOUBLE[]) AS x FROM p) JOIN (SELECT part, k, CAST(y AS DOUBLE[]) AS y FROM c{_round}) USING (part) GROUP BY r, part, x),
"""
    OP11_SQL += f"""
c{_round + 1} AS MATERIALIZED (
  SELECT part, k, coalesce(n.y, c{_round}.y) AS y FROM c{_round} LEFT JOIN (
    SELECT part, k, list((s - ((s % c) + c) % c) // c ORDER BY pos) AS y FROM (
      SELECT part, best % 256 AS k, pos, CAST(sum(CAST(x[pos] AS BIGINT)) AS BIGINT) AS s, count(*) AS c FROM a{_round}, range(1, 1000) AS g(pos) WHERE pos <= len(x) GROUP BY 1, 2, 3)
    GROUP BY part, k) n USING (part, k)),
""" * (_round < 4)
OP11_SQL += """
e AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, k)) FROM c4) AS codebooks_sha256 FROM q JOIN e USING (r)
"""

_STARTS = "list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0)"
_FOUND = " UNION ALL ".join(
    f"SELECT r, {k} AS kind, m[i] AS m, CAST({_STARTS} AS BIGINT) AS s FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM "
    f"(SELECT r, regexp_extract_all(t, {_quoted(kind.pattern)}) AS m, regexp_split_to_array(t, {_quoted(kind.pattern)}) AS g FROM (SELECT r, {'t' if kind.as_is else 'low AS t'} FROM d))) "
    f"WHERE length(regexp_extract(m[i], {_quoted(kind.pattern)}, {kind.group})) >= {kind.least}"
    for k, kind in enumerate(secret_scan.KINDS)
)
_KINDS = ", ".join(f"({k}, '{kind.name}', {kind.role}, {kind.needs})" for k, kind in enumerate(secret_scan.KINDS))
OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
k(kind, name, role, needs) AS (VALUES {_KINDS}),
f AS MATERIALIZED (SELECT r, kind, name, role, needs, s, s + length(m) AS e FROM ({_FOUND}) JOIN k USING (kind)),
c AS MATERIALIZED (
  SELECT f.*, len(regexp_extract_all(substr(t, 1, s), {_quoted(secret_scan.SCOPE_END)})) AS scope FROM f JOIN d USING (r)
  WHERE needs = 0 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.needs = 0 AND b.s < f.e AND b.e > f.s)),
l AS (SELECT a.r, a.kind, a.s FROM c a JOIN c b ON a.r = b.r AND a.scope = b.scope AND a.needs & b.role <> 0 AND greatest(a.s, b.s) - least(a.e, b.e) <= {secret_scan.REACH}
      GROUP BY a.r, a.kind, a.s, a.needs HAVING bit_or(a.needs & b.role) = a.needs),
n AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (needs = 0), '') AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
      FROM c LEFT JOIN l USING (r, kind, s) WHERE needs = 0 OR l.r IS NOT NULL GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^
]*
|[^
]+') AS u, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x
"""

SQL: dict[str, str] = {"op11_vector_codes": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_fill_in_middle": OP13_SQL, "op3_line_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op6_license_scan": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL}
