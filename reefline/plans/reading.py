"""The read API: filters, sorting, pages, nested reads, aggregated statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.operators import read_api as R
from reefline.plans.catalog import query, r6, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


@query("""
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_12') AND (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT (c_acctbal <= 0) AND c_mktsegment <> 'MACHINERY'
""")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested filter dict over a populated relation."""
    c = R.populate_one(_customers(spark, sf_dir), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", ["n_name"], "nation")
    spec = {
        "nation": {"n_name": {"$in": ["NATION_3", "NATION_12"]}},
        "$or": [{"c_acctbal": {"$gt": 5000}}, {"c_mktsegment": {"$eq": "BUILDING"}}],
        "$not": {"c_acctbal": {"$lte": 0}},
        "c_mktsegment": {"$ne": "MACHINERY"},
        "c_name": {"$null": False},
    }
    return c.where(R.condition(spec)).select("c_custkey")


_SORTED = "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM customer"


@query(f"""SELECT * FROM ({_SORTED}) ORDER BY seg DESC NULLS LAST, c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 20""")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20, nulls last both ways."""
    c = _customers(spark, sf_dir).select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_acctbal")
    return R.page(R.sorted_rows(c, "seg:desc,c_acctbal:asc,c_custkey"), page=2, page_size=20)


@query(f"""SELECT * FROM ({_SORTED}) ORDER BY c_custkey, c_acctbal, seg NULLS LAST LIMIT 7 OFFSET 3""")
def sorted_last_dominates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by one key after another, so that the last one leads."""
    c = _customers(spark, sf_dir).select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_acctbal")
    return R.page(R.sorted_rows(c, [{"seg": "asc"}, {"c_acctbal": "asc"}, "c_custkey"], last_dominates=True), start=3, limit=7)


@query("""SELECT CAST(1 AS INTEGER) AS page, CAST(25 AS INTEGER) AS "pageSize", CAST(CEIL(COUNT(*) / 25.0) AS BIGINT) AS "pageCount", COUNT(*) AS total FROM customer""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paging(_customers(spark, sf_dir))


@query("""
SELECT n_name, CAST(COUNT(s_suppkey) AS INTEGER) AS n, COALESCE(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS suppliers
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY n_name
""")
def populated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A to-many relation with a filter inside; empty where there is none."""
    n = R.populate_many(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", ["s_suppkey", "s_name"], "suppliers", F.col("s_acctbal") > 0)
    return n.select("n_name", F.size("suppliers").alias("n"), F.array_join(F.transform("suppliers", lambda s: s["s_suppkey"].cast("string")), ",").alias("suppliers"))


@query("""
SELECT r_name, n.n_name AS first_nation FROM region LEFT JOIN (SELECT n_regionkey, MIN(n_name) AS n_name FROM nation GROUP BY 1) n ON r_regionkey = n_regionkey
""")
def populated_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: regions with their nations."""
    r = R.populate_many(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", ["n_name"], "nations")
    return r.select("r_name", F.get("nations", F.lit(0))["n_name"].alias("first_nation"))


@query("""
SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)
""")
def with_matching_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match themselves or through a related row."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return R.having(o, l, F.col("o_orderkey") == F.col("l_orderkey"), F.col("o_totalprice") > 300000).select("o_orderkey")


@query("""
SELECT event_id FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 = 0 OR ts <= (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 4 FROM events))
""")
def flags_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that are not archived and active at a date."""
    e = table(spark, sf_dir, "events")
    flags = e.select("event_id", (F.col("event_id") % 3 == 0).alias("archived"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("active_on"))
    at = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 4).alias("at"))  # one row
    return R.active_flags(flags.crossJoin(F.broadcast(at)), F.col("at")).select("event_id")


_STATS = """SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderstatus = 'F' THEN 'terrestrial' ELSE 'marine' END AS environment, o_orderpriority AS level, n_name AS location,
 SUM(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END) AS total_area, ROUND(SUM(o_totalprice / 2), 4) AS protected_area, MAX(o_orderdate) AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4"""


@query(f"""
WITH s AS ({_STATS}), l AS (SELECT n_name AS code, 1000.0 * (n_nationkey + 1) AS m, 500.0 * (n_nationkey + 1) AS t, n_nationkey % 2 = 0 AS shared FROM nation)
SELECT year, environment, level, ROUND(SUM(CASE WHEN total_area = 0 THEN CASE WHEN environment = 'terrestrial' THEN t ELSE m END ELSE total_area END), 2)::DOUBLE AS total_area, ROUND(SUM(protected_area), 3) AS protected_area,
 ROUND(100 * SUM(protected_area) / SUM(CASE WHEN total_area = 0 THEN CASE WHEN environment = 'terrestrial' THEN t ELSE m END ELSE total_area END), 6) AS coverage,
 string_agg(location, ',' ORDER BY location) AS locations, BOOL_OR(shared) AS shared, MAX(updated_at) AS updated_at
FROM s JOIN l ON code = location WHERE location IN ('NATION_3', 'NATION_7', 'NATION_12') GROUP BY 1, 2, 3
""")
def aggregated_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a set of locations by year, environment and level; missing totals from the locations."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    env = F.when(F.col("o_orderstatus") == "F", "terrestrial").otherwise("marine")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    stats = rows.groupBy(F.year("o_orderdate").alias("year"), env.alias("environment"), F.col("o_orderpriority").alias("level"), F.col("n_name").alias("location")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "O", 0.0).otherwise(F.col("o_totalprice"))).alias("total_area"), F.round(F.sum(F.col("o_totalprice") / 2), 4).alias("protected_area"), F.max("o_orderdate").alias("updated_at")
    )
    k = F.col("n_nationkey") + 1
    loc = n.select(F.col("n_name").alias("code"), (k * 1000.0).alias("total_marine_area"), (k * 500.0).alias("total_terrestrial_area"), (F.col("n_nationkey") % 2 == 0).alias("has_shared_marine_area"))
    out = R.aggregated_stats(stats, loc, ["nation_3", " NATION_7", "Nation_12"], sub="level")
    return out.select("year", "environment", "level", F.round("total_area", 2).alias("total_area"), F.round("protected_area", 3).alias("protected_area"), r6("coverage").alias("coverage"), F.array_join("locations", ",").alias("locations"), F.col("has_shared_marine_area").alias("shared"), "updated_at")


@query("""
SELECT batch, array_to_string(list_sort([x FOR x IN ['NATION_3', 'NATION_12', 'NOWHERE'] IF NOT list_contains(found, x)]), ',') AS missing FROM (SELECT c_custkey // 20 AS batch, list(DISTINCT n_name) AS found FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
""")
def missing_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested codes that each batch of twenty customers lacks."""
    c = _customers(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = c.groupBy(F.expr("c_custkey div 20").alias("batch")).agg(F.collect_set("n_name").alias("found"))
    asked = F.array(F.lit("NATION_3"), F.lit("NATION_12"), F.lit("NOWHERE"))
    return found.select("batch", F.array_join(R.missing(asked, F.col("found")), ",").alias("missing"))


@query("""
SELECT n_name AS location, ROUND(100.0 * p / t, 6) AS existing_percent, ROUND(100 * LEAST(d, t - p) / t, 6) AS drawn_percent, ROUND(100 * (p + LEAST(d, t - p)) / t, 6) AS combined_percent
FROM (SELECT n_name, 100.0::DOUBLE AS t, CAST(n_nationkey * 4 AS DOUBLE) AS p, 20.0::DOUBLE AS d FROM nation)
""")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawn area would add, up to what is still unprotected."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), F.lit(100.0).alias("total_area"), (F.col("n_nationkey") * 4.0).alias("protected_area"))
    out = R.what_if(n, n.select("location", F.lit(20.0).alias("area")))
    return out.select("location", *[r6(c).alias(c) for c in ("existing_percent", "drawn_percent", "combined_percent")])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    en = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("code"), F.lit("en").alias("locale"), F.lower("n_name").alias("name"))
    return en.unionByName(n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("code"), F.lit("fr").alias("locale"), F.concat(F.lit("le "), F.lower("n_name")).alias("name")))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'le ' || lower(n_name) WHEN n_nationkey % 5 <> 0 THEN lower(n_name) ELSE n_name END AS name FROM nation
""")
def localized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.localized(table(spark, sf_dir, "nation"), _names(spark, sf_dir), "n_name", "fr").select("n_nationkey", "name")


@query("""
SELECT n_name || '*' AS code, CASE WHEN n_name = 'NATION_12' THEN 'Override' WHEN n_nationkey % 5 <> 0 THEN lower(n_name) || '*' ELSE n_name || '*' END AS display_name FROM nation
""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("*")).alias("code"))
    return R.display_name(n, _names(spark, sf_dir).where("locale = 'en'"), {"NATION_12*": "Override"})


@query("""
SELECT n_name AS code, 'pt' AS locale, lower(n_name) AS name FROM nation WHERE n_nationkey % 5 <> 0
""")
def locale_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies for a locale that has no rows yet."""
    return R.backfill_locale(_names(spark, sf_dir), "pt", key="code")


@query("""
SELECT r_name, CAST(COUNT(*) AS INTEGER) AS n FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 GROUP BY r_name
""")
def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists filtered inside; rows left with none go."""
    r = R.populate_many(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", ["n_nationkey"], "nations")
    return R.nested_filter(r, "nations", lambda x: x["n_nationkey"] % 2 == 0).select("r_name", F.size("nations").alias("n"))


@query("""
SELECT n_regionkey, CAST(MIN(n_nationkey) AS DOUBLE) AS x0, CAST(-MAX(n_nationkey) AS DOUBLE) AS y0, CAST(MAX(n_nationkey) + 1 AS DOUBLE) AS x1, CAST(1 - MIN(n_nationkey) AS DOUBLE) AS y1 FROM nation GROUP BY 1
""")
def united_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.array(k, -k, k + 1, 1 - k).alias("bounds"))
    return R.bounds_union(n, keys=["n_regionkey"]).select("n_regionkey", *[F.get("bounds", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("""
SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS positive FROM customer GROUP BY 1
""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)), 2).alias("positive"))


@query("""
SELECT n_name, position FROM (SELECT n_name, CAST(CASE n_name WHEN 'NATION_12' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 0 END AS BIGINT) AS position FROM nation) WHERE position > 0
""")
def ordered_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["NATION_12", "NATION_3"]
    n = R.ordered_like(table(spark, sf_dir, "nation"), "n_name", order)
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("n_name"))
    return n.select("n_name", place.cast("long").alias("position")).where("position > 0")


_ACCENTED = """CASE n_nationkey % 8 WHEN 0 THEN 'Zürich' WHEN 1 THEN 'zebra' WHEN 2 THEN 'Äpfel' WHEN 3 THEN 'apfel' WHEN 4 THEN 'Élan' WHEN 5 THEN 'eland' WHEN 6 THEN 'Ozean' ELSE 'öl' END || ' ' || s_suppkey % 7"""


@query(f"""
SELECT code, name, locale, CAST(ROW_NUMBER() OVER (PARTITION BY locale, grp ORDER BY code <> 'S3', k, code) AS INTEGER) AS place FROM (
 SELECT 'de' AS locale, code, name, grp, RANK() OVER (PARTITION BY grp ORDER BY name COLLATE de) AS k FROM (SELECT 'S' || s_suppkey AS code, {_ACCENTED} AS name, n_regionkey AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 UNION ALL SELECT 'sv', code, name, grp, RANK() OVER (PARTITION BY grp ORDER BY name COLLATE sv) FROM (SELECT 'S' || s_suppkey AS code, {_ACCENTED} AS name, n_regionkey AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey))
""")
def names_in_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as two locales sort them, one code first."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    words = ["Zürich", "zebra", "Äpfel", "apfel", "Élan", "eland", "Ozean", "öl"]
    name = F.concat_ws(" ", F.get(F.array(*[F.lit(w) for w in words]), F.col("n_nationkey").cast("int") % 8), F.col("s_suppkey") % 7)
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("code"), name.alias("name"), F.col("n_regionkey").alias("grp"))
    out = None
    for locale in ("de", "sv"):
        own = R.by_name(rows, locale=locale, first=["S3"], keys=["grp"]).withColumn("locale", F.lit(locale))
        out = own if out is None else out.unionByName(own)
    return out.select("code", "name", "locale", "place")


@query("""
SELECT chunk, COUNT(*) AS n_ids, MIN(o) AS first, MAX(o) AS last, CAST(SUM(n) AS BIGINT) AS n_rows FROM (
 SELECT l_orderkey AS o, COUNT(*) AS n, (DENSE_RANK() OVER (ORDER BY l_orderkey) - 1) // 1000 AS chunk FROM lineitem GROUP BY l_orderkey) GROUP BY chunk
""")
def chunked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids in chunks of a thousand, in order, with the rows they have."""
    from reefline.operators import chunks

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.count("*").alias("n"))
    placed = chunks.numbered(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o")), "o", 1000)
    return placed.join(rows, "o").groupBy("chunk").agg(F.count("*").alias("n_ids"), F.min("o").alias("first"), F.max("o").alias("last"), F.sum("n").alias("n_rows"))
