"""Cleaning and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions import numbers as N
from reefline.functions import text as T
from reefline.operators import clean
from reefline.plans.catalog import query, r6, table


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'terrestrial' WHEN 1 THEN 'marine' WHEN 2 THEN 'marine' END AS environment, CASE p_size % 2 WHEN 0 THEN 'oecm' ELSE 'pa' END AS protection_status FROM part
""")
def environment_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p(spark, sf_dir).select("p_partkey", (F.col("p_size") % 4).cast("string").alias("MARINE"), (F.col("p_size") % 2).alias("PA_DEF"))
    return clean.add_status(clean.add_environment(p)).select("p_partkey", "environment", "protection_status")


@query("""
SELECT p_partkey AS "WDPAID", p_name AS "NAME", p_brand AS "ORIG_NAME", CAST(CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INTEGER) AS "PA_DEF", CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS "MARINE" FROM part
""")
def earlier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("OECM"), F.lit("PA"), F.lit("?")), F.col("p_size") % 3 + 1)
    realm = F.element_at(F.array(F.lit("Terrestrial"), F.lit("Marine"), F.lit("Coastal"), F.lit("?")), F.col("p_size") % 4 + 1)
    p = _p(spark, sf_dir).select(F.col("p_partkey").alias("SITE_ID"), F.col("p_name").alias("NAME_ENG"), F.col("p_brand").alias("NAME"), kind.alias("SITE_TYPE"), realm.alias("REALM"))
    return clean.old_names(p)


@query("""
WITH n AS (SELECT n_nationkey, n_name AS location, n_nationkey * 10.0 AS area FROM nation), s AS (SELECT s_suppkey, n.location, CASE WHEN s_suppkey % 3 = 0 THEN 'marine' WHEN s_suppkey % 3 = 1 THEN 'terrestrial' ELSE 'other' END AS environment, ABS(s_acctbal) / 100 AS a, n.area FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT s_suppkey, ROUND(LEAST(100, 100 * a / CASE WHEN environment = 'marine' THEN area ELSE area * 2 END), 9) AS coverage FROM s WHERE environment <> 'other' AND area > 0
""")
def percent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of the location's area of the row's environment, 100 at most; rows without one are rejected."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("location"), (F.col("n_nationkey") * 10.0).alias("AREA_KM2"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "marine").when(F.col("s_suppkey") % 3 == 1, "terrestrial").otherwise("other")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "location", kind.alias("environment"), (F.abs("s_acctbal") / 100).alias("area"))
    marine = n.select("location", F.col("AREA_KM2").cast("string").alias("AREA_KM2"))
    rows, _ = clean.add_coverage(s, marine, n.select("location", (F.col("AREA_KM2") * 2).alias("AREA_KM2")))
    return rows.select("s_suppkey", F.round("coverage", 9).alias("coverage"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1990 + p_size END::INTEGER AS year FROM part
""")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of date text; blank and unreadable text has none."""
    text = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 5 == 0, "soon").otherwise(F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-05-01")))
    return clean.add_year(_p(spark, sf_dir).select("p_partkey", text.alias("designated_date"))).select("p_partkey", "year")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 AND s_acctbal > 0 THEN s_acctbal WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS DOUBLE) ELSE 0 END AS calculated_area_km2 FROM supplier
""")
def chosen_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped area if positive, else reported area, else 0."""
    gis = F.when(F.col("s_suppkey") % 4 == 0, "unknown").otherwise(F.col("s_acctbal").cast("string"))
    rep = F.when(F.col("s_suppkey") % 7 == 0, "-1").otherwise(F.col("s_suppkey").cast("string"))
    return clean.choose_area(table(spark, sf_dir, "supplier").select("s_suppkey", gis.alias("GIS_AREA"), rep.alias("REP_AREA"))).select("s_suppkey", "calculated_area_km2")


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'actively-managed' WHEN 1 THEN 'designated' WHEN 2 THEN 'implemented' WHEN 3 THEN 'unknown' WHEN 4 THEN 'proposed-committed' END AS mpaa_establishment_stage FROM orders
""")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in clean.STAGE], F.lit(None).cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("mpaa_establishment_stage"))
    return clean.stage_slugs(o)


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'unknown' END AS protection_mpaguide_level FROM orders
""")
def masked_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "F", "implemented").when(F.col("o_orderstatus") == "O", "designated")
    o = table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("establishment_stage"), F.col("o_orderpriority").alias("protection_mpaguide_level"))
    return clean.mask_level(o).select("o_orderkey", "protection_mpaguide_level")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dict text (here JSON, written as a Python literal) to columns."""
    e = table(spark, sf_dir, "events").select("event_id", F.translate("props", '"', "'").alias("props"))
    return clean.expand_dict(e, "props", {"k": "k"}, "bigint").select("event_id", "k")


@query("""
SELECT n_nationkey, r AS bounds FROM (SELECT n_nationkey, '[' || CAST(n_nationkey AS VARCHAR) || '.5,' || CAST(n_nationkey + 1 AS VARCHAR) || '.0]' AS r FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1)
""")
def float_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuple text to an array of numbers; null if it isn't one."""
    k = F.col("n_nationkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("("), k.cast("string"), F.lit(".5, "), (k + 1).cast("string"), F.lit(")"))).otherwise("(1, x)")
    n = clean.convert(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("b")), {"b": "list_of_floats"})
    return n.select("n_nationkey", F.to_json("b").alias("bounds"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS BIGINT) AS i, CASE WHEN p_size % 3 = 1 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS f FROM part
""")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    f = F.when(F.col("p_size") % 3 == 1, "-").otherwise((F.col("p_size") + 0.5).cast("string"))
    return clean.convert(_p(spark, sf_dir).select("p_partkey", i.alias("i"), f.alias("f")), {"i": "int", "f": "float"})


@query("""
SELECT DISTINCT CASE WHEN n_name = 'NATION_3' THEN 'NATION_7' ELSE n_name END AS location FROM nation
""")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.relabel(table(spark, sf_dir, "nation").select(F.col("n_name").alias("location")), {"NATION_3": "NATION_7"})


@query("""
WITH d AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'NAT' ELSE 'T' || CAST(s_suppkey % 5 AS VARCHAR) END AS ter, COUNT(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_suppkey, CASE WHEN ter IN ('', 'NAT') THEN CAST(s_nationkey AS VARCHAR) ELSE ter END AS location FROM d WHERE ter <> '' OR n = 1
""")
def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ter = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "NAT").otherwise(F.concat(F.lit("T"), (k % 5).cast("string")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("iso_sov"), ter.alias("iso_ter"))
    return clean.resolve_territories(s).select("s_suppkey", "location")


@query("""
SELECT CASE WHEN n_name IN ('NATION_3', 'NATION_7') THEN 'EUR' ELSE n_name END AS location, CAST(SUM(n_nationkey) AS BIGINT) AS v FROM nation GROUP BY 1
""")
def merged_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), F.col("n_nationkey").cast("long").alias("v"))
    return clean.merge_codes(n, {"EUR": ["NATION_3", "NATION_7"]})


@query("""
SELECT n_name AS location, CASE WHEN n_nationkey % 2 = 0 THEN 1000.0 + n_nationkey ELSE n_nationkey END::DOUBLE AS protected_area FROM nation
""")
def starred_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starred rows replace the protected area of their plain code."""
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("k"))
    plain = n.select(F.col("n_name").alias("location"), F.col("k").alias("protected_area"))
    stars = n.where(F.col("k") % 2 == 0).select(F.concat("n_name", F.lit("*")).alias("location"), (F.col("k") + 1000).alias("protected_area"))
    return clean.starred(plain.unionByName(stars), apply=True)


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'forest' WHEN 1 THEN 'wetlands-open-waters' WHEN 2 THEN 'cold-water corals' END AS habitat FROM part WHERE p_size % 4 < 3
""")
def habitat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.element_at(F.array(*[F.lit(x) for x in ("Forest", "Wetlands/open water", "coldwatercorals", "tundra")]), F.col("p_size") % 4 + 1)
    return clean.known_habitats(_p(spark, sf_dir).select("p_partkey", h.alias("habitat")))


@query("""
SELECT p_partkey, ROUND(100 * COALESCE(a, 0), 6)::DOUBLE AS x_pct, COALESCE(a, 0) * t AS x_protected_area FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.5 END AS a, CAST(p_size AS DOUBLE) AS t FROM part)
""")
def level_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise sums with missing values as 0, and their percentages."""
    p = _p(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("total_area"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 0.5).alias("a"), F.lit(None).cast("double").alias("b"))
    return clean.add_level_percents(clean.add_level_areas(p, {"x": ["a", "b"]}), ["x"]).select("p_partkey", r6("x_pct").alias("x_pct"), "x_protected_area")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END::BIGINT AS parent_id FROM supplier
""")
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    parents = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("code"), F.lit(0).cast("long").alias("parent_id"))
    return clean.add_parent(s, parents, "s_suppkey")


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 7.0 ELSE ROUND(10.0 / (p_size % 5), 6) END AS total_area, ROUND(p_retailprice / p_size, 6) AS percentage FROM part
""")
def implied_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals implied by percentages, the reported one where that is 0; and a plain ratio."""
    p = _p(spark, sf_dir).select("p_partkey", F.lit(0.1).alias("protected_area"), (F.col("p_size") % 5).cast("double").alias("percentage"), F.lit(7.0).alias("wdpa_marine_km2"), "p_retailprice", "p_size")
    t = clean.add_total_from_percent(p).select("p_partkey", r6("total_area").alias("total_area"), F.col("p_retailprice").alias("protected_area"), F.col("p_size").cast("double").alias("area"))
    return clean.add_ratio(t).select("p_partkey", "total_area", r6("percentage").alias("percentage"))


@query("""
SELECT n_nationkey, array_to_string(list_sort(list_distinct([x FOR x IN [CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'S' END, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'T2' END, CASE WHEN n_nationkey % 2 = 1 THEN 'S*' END] IF x IS NOT NULL])), ',') AS parents FROM nation
""")
def zone_claimants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of a zone: territories, else sovereigns, and roll-ups that exist."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(k % 2 == 0, F.col("n_name")).alias("t1"), F.when(k % 2 == 1, "S").otherwise("X").alias("s1"), F.when(k % 3 != 0, "T2").otherwise("").alias("t2"), F.lit(None).cast("string").alias("s2")
    )
    return n.select("n_nationkey", F.array_join(clean.claimants(["t1", "t2"], ["s1", "s2"], ["S*"]), ",").alias("parents"))


@query("""
SELECT word, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT UNNEST(string_split(p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word
""")
def exploded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separated list to a row for each code."""
    lists = _p(spark, sf_dir).select(F.explode(T.split_codes(F.regexp_replace("p_type", " ", " ; "), ";")).alias("word"))
    return lists.groupBy("word").agg(F.count("*").alias("n"))


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_acctbal / 100 < 0.1 THEN '<0.1' ELSE printf('%.1f', round_even(LEAST(s_acctbal / 100, 100), 1)) END AS shown FROM supplier
""")
def shown_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.display_percent(F.col("s_acctbal") / 100).alias("shown"))


@query("""
SELECT x, CAST(round_even(x, 0) AS BIGINT) AS w FROM (SELECT l_linenumber + 0.5 AS x FROM (SELECT DISTINCT l_linenumber FROM lineitem))
""")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()  # noqa: E741
    return l.select((F.col("l_linenumber") + F.lit(0.5).cast("decimal(11,1)")).alias("x")).select("x", N.whole("x").alias("w"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice < 1000 THEN 'price,size' WHEN p_size > 40 THEN 'size' ELSE 'price' END AS errors FROM part WHERE p_size > 40 OR p_retailprice < 1000
""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = clean.violations(_p(spark, sf_dir), {"price": F.col("p_retailprice") >= 1000, "size": F.col("p_size") <= 40})
    return bad.select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("""
SELECT o_orderkey, o_orderkey % 4 = 1 AS unordered, o_orderkey % 4 <> 0 AS ordered FROM orders
""")
def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    a = F.array(F.lit("x"), F.lit("y"))
    b = F.when(k == 0, a).when(k == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x"), F.lit(None).cast("string")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return o.select("o_orderkey", T.lists_differ("a", "b", ordered=False).alias("unordered"), T.lists_differ("a", "b", ordered=True).alias("ordered"))


@query("""
SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_size % 2 = 0
""")
def designated_without_reserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designated sites; biosphere reserves only if they are other measures (brand stands for the kind)."""
    desig = F.when(F.col("p_size") % 2 == 1, "UNESCO-MAB Biosphere Reserve").otherwise("National Park")
    p = _p(spark, sf_dir).select("p_partkey", desig.alias("DESIG_ENG"), F.when(F.col("p_brand") == "Brand#11", 0).otherwise(1).alias("PA_DEF"), F.lit("Designated").alias("STATUS"))
    return clean.without_reserves(clean.designated(p)).select("p_partkey")


@query("""
SELECT realm, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'land' ELSE 'sea' END AS realm FROM part) GROUP BY realm
""")
def realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    land, sea = clean.split_realms(_p(spark, sf_dir).select((F.col("p_size") % 3).cast("string").alias("MARINE")))
    both = land.select(F.lit("land").alias("realm")).unionByName(sea.select(F.lit("sea").alias("realm")))
    return both.groupBy("realm").agg(F.count("*").alias("n"))
