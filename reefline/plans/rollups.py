"""Roll-ups: coverage, levels, habitats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.numbers import percent, safe_sum
from reefline.operators import coverage, habitats, history, levels
from reefline.operators.groups import bridge, bridge_of, members, membership, rollup, total
from reefline.plans.catalog import COUNTRY_SQL, country_areas, query, r6, region_bridge, table

def _sums() -> list[Column]:
    return [safe_sum("total_area").alias("total_area"), safe_sum("protected_area").alias("protected_area")]


@query(f"""
WITH c AS ({COUNTRY_SQL}), g AS (
  SELECT grp AS location, SUM(total_area) AS total_area, SUM(protected_area) AS protected_area FROM c GROUP BY grp
  UNION ALL SELECT 'GLOB', SUM(total_area), SUM(protected_area) FROM c)
SELECT location, total_area, protected_area, ROUND(100 * protected_area / total_area, 6) AS coverage FROM g
""")
def coverage_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each region, and the globe's row."""
    countries = country_areas(spark, sf_dir)
    rows = rollup(countries, region_bridge(spark, sf_dir), "location", _sums()).unionByName(total(countries, "GLOB", _sums()))
    return rows.withColumn("coverage", r6(percent("protected_area", "total_area")))


#: Overlapping groups, one of them with a member that has no row, one empty.
GROUPS = {"A": ["NATION_3", "NATION_7"], "B": ["NATION_7", "NATION_12", "ATLANTIS"], "EMPTY": [], "ALL*": ["NATION_3", "NATION_7", "NATION_12"]}
_BRIDGE = "(VALUES " + ", ".join(f"('{g}', {repr(m) if m else 'NULL'})" for g, ms in GROUPS.items() for m in (ms or [None])) + ") b(grp, member)"


@query(f"""
WITH c AS ({COUNTRY_SQL})
SELECT b.grp AS location, SUM(c.total_area) AS total_area, SUM(protected_area) AS protected_area, CAST(COUNT(*) AS BIGINT) AS n_members
FROM c JOIN {_BRIDGE} ON c.location = b.member GROUP BY b.grp
""")
def coverage_overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that share members; a group without a row is absent."""
    return rollup(country_areas(spark, sf_dir), bridge(spark, GROUPS), "location", [*_sums(), F.count("*").alias("n_members")])


@query(f"""
WITH c AS ({COUNTRY_SQL})
SELECT b.grp AS location, COALESCE(SUM(c.total_area), 0) AS total_area, COALESCE(SUM(protected_area), 0) AS protected_area
FROM {_BRIDGE} LEFT JOIN c ON c.location = b.member GROUP BY b.grp
""")
def coverage_with_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(country_areas(spark, sf_dir), bridge(spark, GROUPS), "location", _sums(), keep_empty=True)


_PAIRS = "SELECT DISTINCT 'P' || p_partkey AS grp, 'S' || l_suppkey AS member FROM part LEFT JOIN lineitem ON l_partkey = p_partkey"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as groups of the suppliers that deliver them, some without any, from a column of lists."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")  # noqa: E741
    lists = l.groupBy("l_partkey").agg(F.collect_list(F.concat(F.lit("S"), "l_suppkey")).alias("m"))
    known = p.join(lists, F.col("p_partkey") == F.col("l_partkey"), "left")
    return bridge_of(known.select(F.create_map(F.concat(F.lit("P"), "p_partkey"), F.coalesce("m", F.array().cast("array<string>"))).alias("groups")), "groups")


@query(f"""
SELECT member, string_agg(grp, ',' ORDER BY grp) AS grps FROM ({_PAIRS}) WHERE member IS NOT NULL GROUP BY member
""")
def group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(_pairs(spark, sf_dir)).select("member", F.array_join("groups", ",").alias("grps"))


@query(f"""
SELECT grp, COALESCE(string_agg(member, ',' ORDER BY member), '') AS list FROM ({_PAIRS}) GROUP BY grp
""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(_pairs(spark, sf_dir)).select("grp", F.array_join("members", ",").alias("list"))


def _statistics(countries: DataFrame) -> DataFrame:
    """Country rows as the published file has them: a dict literal of statistics."""
    text = lambda c: F.col(c).cast("long").cast("string")
    half = (F.col("protected_area") / 2).cast("long").cast("string")
    share = F.round(100 * F.col("protected_area") / F.col("total_area"), 4).cast("string")
    part = F.round(50 * F.col("protected_area") / F.col("total_area"), 4).cast("string")
    items = [("marine_area", text("total_area")), ("oecms_pa_marine_area", text("protected_area")), ("percentage_oecms_pa_marine_cover", share), ("pa_marine_area", half), ("percentage_pa_marine_cover", part)]
    items += [("protected_area_polygon_count", text("n")), ("protected_area_point_count", F.lit("1")), ("oecm_polygon_count", F.lit("2")), ("oecm_point_count", F.lit("None"))]
    body = F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), v) for k, v in items])
    return countries.select(F.col("location").alias("id"), F.col("n").alias("pas_count"), F.concat(F.lit("{"), body, F.lit("}")).alias("statistics"))


@query(f"""
WITH c AS ({COUNTRY_SQL}), k AS (
  SELECT grp AS location, SUM(total_area) AS total_area, SUM(protected_area) AS protected_area, SUM(n) AS n,
         SUM(ROUND(100 * protected_area / total_area, 4)) AS cover, SUM(ROUND(50 * protected_area / total_area, 4)) AS pa_cover FROM c GROUP BY grp)
SELECT location, 'marine' AS environment, protected_area, CAST(n AS BIGINT) AS protected_areas_count,
       ROUND(100 * protected_area / total_area, 6) AS coverage, ROUND(100 * pa_cover / cover, 6) AS pas, ROUND(100 - 100 * pa_cover / cover, 6) AS oecms, total_area
FROM k WHERE protected_area > 0
""")
def coverage_from_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage table's group rows from dict literals, shares by area."""
    rows = coverage.country_rows(_statistics(country_areas(spark, sf_dir)), "marine")
    out = coverage.group_rows(rows, region_bridge(spark, sf_dir), None, "marine")
    return out.select("location", "environment", "protected_area", "protected_areas_count", *[r6(c).alias(c) for c in ("coverage", "pas", "oecms")], "total_area")


@query(f"""
WITH c AS ({COUNTRY_SQL})
SELECT location, ROUND(50 * protected_area / total_area, 4) AS pa_coverage, ROUND(100 * ROUND(50 * protected_area / total_area, 4) / ROUND(100 * protected_area / total_area, 4), 6) AS pas_percent_area,
       CAST(n + 1 AS BIGINT) AS pas_count, CAST(NULL AS BIGINT) AS oecm_count FROM c
""")
def country_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dict literal to columns, shares and counts; a missing count stays missing."""
    rows = coverage.country_rows(_statistics(country_areas(spark, sf_dir)), "marine")
    return rows.select("location", "pa_coverage", r6("pas_percent_area").alias("pas_percent_area"), F.col("pas_count").cast("long").alias("pas_count"), F.col("oecm_count").cast("long").alias("oecm_count"))


WORLD = (("total_ocean_area_oecms_pas", "100"), ("total_ocean_area_oecms", "20"), ("total_ocean_oecms_pas_coverage_percentage", "8"), ("total_marine_oecms_pas", "7"),
         ("total_land_area_oecms_pas", "50"), ("total_land_area_oecms", "5"), ("total_land_oecms_pas_coverage_percentage", "16"), ("total_terrestrial_oecms_pas", "9"),
         ("high_seas_pa_coverage_area", "10"), ("high_seas_pa_coverage_percentage", "1.5"), ("national_waters_oecms_coverage_area", "15"),
         ("national_waters_oecms_pas_coverage_area", "60"), ("global_ocean_percentage", "61"), ("unknown", ""))
_WORLD = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in WORLD) + ") w(type, value)"


#: The world's statistics by their keys: (in Spark, in DuckDB) over line items.
_HELD, _OTHER = "l_returnflag <> 'N'", "l_returnflag = 'A'"
_WORLD_VALUES = {
    "total_ocean_area_oecms_pas": f"SUM(CASE WHEN {_HELD} THEN l_quantity END)",
    "total_ocean_area_oecms": f"SUM(CASE WHEN {_OTHER} THEN l_quantity END)",
    "total_ocean_oecms_pas_coverage_percentage": f"100 * SUM(CASE WHEN {_HELD} THEN l_quantity END) / SUM(l_quantity)",
    "total_marine_oecms_pas": f"COUNT(CASE WHEN {_HELD} THEN 1 END)",
    "high_seas_pa_coverage_area": "SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_quantity END)",
    "high_seas_pa_coverage_percentage": "100 * SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_quantity END) / SUM(l_quantity)",
    "national_waters_oecms_coverage_area": f"SUM(CASE WHEN {_OTHER} AND l_linenumber <> 1 THEN l_quantity END)",
    "national_waters_oecms_pas_coverage_area": f"SUM(CASE WHEN {_HELD} AND l_linenumber <> 1 THEN l_quantity END)",
    "global_ocean_percentage": "100 * SUM(CASE WHEN l_linenumber = 1 THEN l_quantity END) / SUM(l_quantity)",
}
_AS_WRITTEN = {k: f"CAST(ROUND(CAST({v} AS DOUBLE), 2) AS DECIMAL(20, 2))" for k, v in _WORLD_VALUES.items()}
_SHORT = dict(zip(_WORLD_VALUES, ("both_", "other", "pct", "n", "hs", "hspct", "nw_other", "nw_both", "ocean"), strict=True))


@query(f"""
WITH k AS (SELECT {', '.join(f'CAST({v} AS DOUBLE) AS {_SHORT[k]}' for k, v in _AS_WRITTEN.items())} FROM lineitem)
SELECT 'GLOB' AS location, both_ AS protected_area, CAST(n AS BIGINT) AS protected_areas_count, pct AS coverage, ROUND(100 * (both_ - other) / both_, 6) AS pas, ROUND(100 * other / both_, 6) AS oecms,
       ROUND(pct, 6) AS global_contribution, ROUND(both_ / (pct / 100), 6) AS total_area FROM k
UNION ALL
SELECT 'ABNJ', hs, CAST(-9999 AS BIGINT), hspct, ROUND(100 * ((both_ - nw_both) - (other - nw_other)) / (both_ - nw_both), 6), ROUND(100 * (other - nw_other) / (both_ - nw_both), 6),
       ROUND(100 * hs / (both_ / (pct / 100)), 6), ROUND(both_ / (pct / 100) * ocean / 100, 6) FROM k
""")
def coverage_world_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global and high-seas rows from key/value statistics, which are sums over line items as text."""
    sums = table(spark, sf_dir, "lineitem").agg(*[F.expr(v).cast("string").alias(k) for k, v in _AS_WRITTEN.items()])
    lines = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("value")) for k in _AS_WRITTEN])).alias("l")).select("l.*")
    rows = coverage.world_rows(coverage.key_values(lines, coverage.WORLD_KEYS), "marine")
    return rows.select("location", "protected_area", "protected_areas_count", "coverage", *[r6(c).alias(c) for c in ("pas", "oecms", "global_contribution", "total_area")])


_FLAGS = "CASE l_returnflag WHEN 'R' THEN 'highly' WHEN 'A' THEN 'moderately' ELSE 'less' END"


def _fishing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as territories of their regions, in the shape of the published table."""
    l, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    rows = l.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total_area"), flag("R").alias("lfp5_area"), flag("A").alias("lfp3_area"), flag("N").alias("lfp1_area"))
    rows = rows.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(*[F.sum(c).alias(c) for c in ("total_area", "lfp5_area", "lfp3_area", "lfp1_area")])
    rows = rows.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("iso_sov"), F.col("n_name").alias("iso_ter"), "total_area", "lfp5_area", F.lit(0.0).alias("lfp4_area"), "lfp3_area", F.lit(None).cast("double").alias("lfp2_area"), "lfp1_area")


@query(f"""
WITH d AS (SELECT r_name AS location, {_FLAGS} AS level, SUM(l_quantity) AS area FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
t AS (SELECT location, SUM(area) AS total_area FROM d GROUP BY 1)
SELECT location, level AS fishing_protection_level, area, ROUND(LEAST(100, 100 * area / total_area), 6) AS pct, CAST(total_area AS BIGINT) AS total_area FROM d JOIN t USING (location)
""")
def fishing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and share at each fishing protection level by group."""
    out = levels.fishing_table(_fishing_rows(spark, sf_dir), region_bridge(spark, sf_dir))
    return out.select("location", "fishing_protection_level", "area", r6("pct").alias("pct"), "total_area")


@query(f"""
WITH c AS ({COUNTRY_SQL}), p AS (SELECT grp, protected_area, ROUND(100 * protected_area / total_area, 2) AS percentage FROM c),
g AS (SELECT grp AS location, SUM(protected_area / (percentage / 100)) AS total_area, SUM(protected_area) AS area FROM p GROUP BY grp
  UNION ALL SELECT 'GLOB', 1000.0, 30.0)
SELECT location, CAST(ROUND(total_area) AS BIGINT) AS total_area, area, 'fully-highly-protected' AS mpaa_protection_level, ROUND(100 * area / total_area, 6) AS percentage FROM g
""")
def marine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals implied by percentages, summed by group; the globe from its own record; starred codes dropped."""
    share = F.round(100 * F.col("protected_area") / F.col("total_area"), 2)
    c = country_areas(spark, sf_dir).select(F.col("location").alias("id"), F.col("protected_area").cast("string").alias("highly_protected_km2"), share.alias("highly_protected_percent"), F.lit("").alias("wdpa_marine_km2"))
    c = c.unionByName(c.withColumn("id", F.concat("id", F.lit("*"))))
    world = spark.createDataFrame([(1000.0, 10.0, 20.0)], "total_km2 double, mpaguide_total_if_km2 double, mpaguide_total_ih_km2 double")
    groups = region_bridge(spark, sf_dir).unionByName(bridge(spark, {"GLOB": []}))
    out = levels.level_table(c, world, groups)
    return out.select("location", "total_area", "area", "mpaa_protection_level", r6("percentage").alias("percentage"))


@query("""
WITH l AS (SELECT l_returnflag AS f, SUM(l_quantity) AS q FROM lineitem GROUP BY 1), t AS (SELECT SUM(q) AS total FROM l)
SELECT total AS total_km2, MAX(CASE WHEN f = 'A' THEN q END) AS a_km2, ROUND(MAX(CASE WHEN f = 'A' THEN 100 * q / total END), 4) AS a_percent, MAX(CASE WHEN f = 'R' THEN q END) AS r_km2, CAST(NULL AS DOUBLE) AS r_percent FROM l, t GROUP BY total
""")
def world_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record to columns; the record is made of the line items by flag, one of which has no percentage."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.lower("l_returnflag").alias("key")).agg(F.sum("l_quantity").alias("km2"))  # noqa: E741
    total = l.agg(F.sum("km2").alias("total_km2"))
    entries = l.crossJoin(F.broadcast(total)).withColumn("percent", F.when(F.col("key") != "r", F.round(100 * F.col("km2") / F.col("total_km2"), 4)))  # one row
    record = entries.groupBy("total_km2").agg(F.struct(F.collect_list(F.struct("key", "km2", "percent")).alias("total")).alias("mpaguide_status"))
    schema = "total_km2 double, mpaguide_status struct<total: array<struct<key: string, km2: double, percent: double>>>"
    read = record.select(F.from_json(F.to_json(F.struct("total_km2", "mpaguide_status")), schema).alias("r")).select("r.*")
    return levels.world_levels(read).select("total_km2", *[F.col(f"mpaguide_total_{c}").alias(c) for c in ("a_km2", "a_percent", "r_km2", "r_percent")])


_PEAKS = "SELECT DISTINCT l_partkey AS peak, CAST(p_size AS DOUBLE) AS area, r_name AS grp, l_returnflag = 'R' AS pa FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""
WITH d AS ({_PEAKS}), z AS (SELECT grp, SUM(area) AS total_area FROM (SELECT DISTINCT peak, area, grp FROM d) GROUP BY grp),
p AS (SELECT grp, SUM(area) AS protected_area FROM (SELECT DISTINCT peak, area, grp FROM d WHERE pa) GROUP BY grp)
SELECT z.grp AS location, 'seamounts' AS habitat, 'marine' AS environment, LEAST(COALESCE(protected_area, 0), total_area) AS protected_area, total_area FROM z LEFT JOIN p ON z.grp = p.grp
UNION ALL SELECT 'GLOB', 'seamounts', 'marine', LEAST((SELECT SUM(area) FROM (SELECT DISTINCT peak, area FROM d WHERE pa)), (SELECT CAST(SUM(p_size) AS DOUBLE) FROM part)), (SELECT CAST(SUM(p_size) AS DOUBLE) FROM part)
""")
def habitat_seamounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each peak once a group: parts as peaks, their size as area, nations as zones."""
    l, p, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    seen = l.select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("pa")).distinct()
    rows = seen.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("l_partkey", "n_name", "pa").distinct().join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_partkey").alias("PEAKID"), F.col("p_size").cast("double").alias("AREA2D"), F.col("n_name").alias("location"), "pa")
    peaks = p.select(F.col("p_partkey").alias("PEAKID"), F.col("p_size").cast("double").alias("AREA2D"))
    groups = region_bridge(spark, sf_dir).unionByName(bridge(spark, {"GLOB": []}))
    return habitats.seamounts(rows.drop("pa"), rows.where("pa").drop("pa"), peaks, groups)


@query(f"""
WITH c AS ({COUNTRY_SQL})
SELECT grp AS location, 'mangroves' AS habitat, 'marine' AS environment, SUM(protected_area) AS protected_area, SUM(total_area) AS total_area FROM c GROUP BY grp
UNION ALL SELECT 'GLOB', 'mangroves', 'marine', SUM(protected_area), 123456.0 FROM c
""")
def habitat_mangroves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habitats.by_location(country_areas(spark, sf_dir), region_bridge(spark, sf_dir), "mangroves", "total_area", "protected_area", world_total=123456.0)


@query(f"""
WITH c AS ({COUNTRY_SQL}), k(habitat, f) AS (VALUES ('seagrasses', 1.0), ('saltmarshes', 2.0)),
d AS (SELECT location, grp, habitat, total_area * f AS t, CASE WHEN habitat = 'saltmarshes' THEN NULL ELSE protected_area END AS p FROM c, k)
SELECT grp AS location, habitat, 'marine' AS environment, COALESCE(SUM(p), 0)::DOUBLE AS protected_area, SUM(t)::DOUBLE AS total_area FROM d GROUP BY grp, habitat
UNION ALL SELECT 'EMPTY', habitat, 'marine', 0.0, 0.0 FROM k
UNION ALL SELECT 'GLOB', habitat, 'marine', COALESCE(SUM(p), 0), SUM(t) FROM d GROUP BY habitat
""")
def habitat_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habitat files with "-" for missing numbers; every group has every habitat."""
    c = country_areas(spark, sf_dir)
    kinds = spark.createDataFrame([("seagrasses", 1.0), ("saltmarshes", 2.0)], "habitat string, f double")
    rows = c.crossJoin(F.broadcast(kinds)).select(  # two literal rows
        F.col("location").alias("ISO3"), "habitat", (F.col("total_area") * F.col("f")).cast("string").alias("total_area"),
        F.when(F.col("habitat") == "saltmarshes", "-").otherwise(F.col("protected_area").cast("string")).alias("protected_area"),
    )
    return habitats.listed(rows, region_bridge(spark, sf_dir).unionByName(bridge(spark, {"EMPTY": []})))


_COVER = """SELECT n_name AS location, r_name AS grp, SUM(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS "Forest", SUM(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS "Desert", SUM(l_quantity) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fishing_rows(spark, sf_dir)
    return f.select(F.col("iso_ter").alias("location"), F.col("lfp3_area").alias("Forest"), F.col("lfp1_area").alias("Desert"), "total_area").withColumnRenamed("total_area", "total")


@query(f"""
WITH c AS ({_COVER}), u AS (SELECT grp AS location, 'Forest' AS habitat, SUM("Forest") AS v FROM c GROUP BY grp UNION ALL SELECT grp, 'Desert', SUM("Desert") FROM c GROUP BY grp UNION ALL SELECT grp, 'total_land_area', SUM(total) FROM c GROUP BY grp
  UNION ALL SELECT 'GLOB', 'Forest', SUM("Forest") FROM c UNION ALL SELECT 'GLOB', 'Desert', SUM("Desert") FROM c UNION ALL SELECT 'GLOB', 'total_land_area', SUM(total) FROM c)
SELECT location, habitat, CASE WHEN habitat <> 'Desert' THEN 'terrestrial' END AS environment, CASE WHEN habitat <> 'Desert' THEN ROUND(v / 2, 6) END AS protected_area, v AS total_area FROM u
""")
def habitat_land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class columns summed and turned into rows; a class the protected table lacks stays null."""
    c = _cover(spark, sf_dir)
    half = c.select("location", (F.col("Forest") / 2).alias("Forest"), (F.col("total") / 2).alias("total"))
    return habitats.land_cover(c, half, region_bridge(spark, sf_dir)).withColumn("protected_area", r6("protected_area"))


@query(f"""
WITH c AS ({_COVER})
SELECT grp AS location, 'climate-resilient-corals' AS habitat, 'marine' AS environment, SUM("Forest") AS protected_area, SUM(total) AS total_area FROM c GROUP BY grp
UNION ALL SELECT grp, 'other-corals', 'marine', 0.0, SUM("Desert") FROM c GROUP BY grp
UNION ALL SELECT 'GLOB', 'climate-resilient-corals', 'marine', 5.0, 50.0 UNION ALL SELECT 'GLOB', 'other-corals', 'marine', 0.0, 0.0
""")
def habitat_corals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class areas by group; the globe from areas computed without double counting."""
    c = _cover(spark, sf_dir)
    whole = c.select("location", F.col("total").alias("climate-resilient-corals"), F.col("Desert").alias("other-corals"))
    part = c.select("location", F.col("Forest").alias("climate-resilient-corals"))
    groups = region_bridge(spark, sf_dir).unionByName(bridge(spark, {"GLOB": []}))
    classes = ["climate-resilient-corals", "other-corals"]
    return habitats.corals(whole, part, groups, classes, {classes[0]: 50.0}, {classes[0]: 5.0})


@query("""
WITH f AS (SELECT l_suppkey AS k, l_partkey AS item, MIN(YEAR(l_shipdate)) AS y FROM lineitem GROUP BY 1, 2),
ys AS (SELECT DISTINCT YEAR(l_shipdate) AS year FROM lineitem), ks AS (SELECT DISTINCT l_suppkey AS k FROM lineitem),
n AS (SELECT k, y, COUNT(*) AS c FROM f GROUP BY 1, 2)
SELECT ks.k AS l_suppkey, CAST(ys.year AS INTEGER) AS year, CAST(COALESCE(SUM(n.c), 0) AS BIGINT) AS n FROM ks CROSS JOIN ys LEFT JOIN n ON n.k = ks.k AND n.y <= ys.year GROUP BY 1, 2
""")
def running_union_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of each key up to each year."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"))  # noqa: E741
    return history.running_union(l, ["l_suppkey"], "l_partkey", "year", l.select("year").distinct())


@query("""
WITH y AS (SELECT CAST(YEAR(l_shipdate) AS INTEGER) AS year, ROUND(100 * SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity), 6) AS percentage FROM lineitem GROUP BY 1),
e AS (SELECT MIN(year) AS lo, MAX(year) AS hi FROM y),
s AS (SELECT x AS year, percentage FROM (SELECT UNNEST(range(CAST(lo AS BIGINT), GREATEST(CAST(hi AS BIGINT), 2030) + 1)) AS x FROM e) r LEFT JOIN y ON y.year = r.x WHERE y.year IS NOT NULL OR r.x > (SELECT hi FROM e) ORDER BY x DESC LIMIT 20),
m AS (SELECT MIN(year) AS y0, ARG_MIN(percentage, year) AS p0, MAX(year) AS y1, ARG_MAX(percentage, year) AS p1 FROM s WHERE percentage IS NOT NULL)
SELECT CAST(year AS INTEGER) AS year, percentage, CASE WHEN year <= y1 THEN ROUND(p0 + (p1 - p0) / NULLIF(y1 - y0, 0) * (year - y0), 6) END AS historical,
       CASE WHEN year >= y1 THEN ROUND(LEAST(100, p1 + (p1 - p0) / NULLIF(y1 - y0, 0) * (year - y1)), 6) END AS projected, year = y1 AS active FROM s, m
""")
def projection_to_2030(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly shares, their straight line, and its continuation to 2030."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    yearly = l.groupBy(F.year("l_shipdate").alias("year")).agg((100 * F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("percentage"))
    out = history.projection(yearly.withColumn("percentage", r6("percentage")))
    return out.select("year", "percentage", r6("historical").alias("historical"), r6("projected").alias("projected"), "active")


@query("""
SELECT o_custkey, o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS year, YEAR(o_orderdate) = MAX(YEAR(o_orderdate)) OVER (PARTITION BY o_custkey) AS is_last_year FROM orders
""")
def last_year_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    return history.mark_last_year(o, ["o_custkey"])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1
""")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return history.latest_per(o, ["o_custkey"], "o_orderdate", ["o_orderkey"]).drop("o_orderdate")


@query("""
WITH y AS (SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS year, COUNT(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
SELECT year, CAST(n AS INTEGER) AS n FROM y WHERE n = (SELECT MAX(n) FROM y)
""")
def fullest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.collect_set("o_orderpriority").alias("locations"))
    return history.fullest_years(y).select("year", F.size("locations").alias("n"))


@query("""
SELECT o_custkey, o_orderkey, CAST(LEAD(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS next_price FROM orders
""")
def next_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", history.next_or_zero(o, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"]).alias("next_price"))


@query("""
SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER w > 1 AS is_child, CAST(CASE WHEN ROW_NUMBER() OVER w = 1 THEN COUNT(*) OVER (PARTITION BY o_custkey) - 1 ELSE 0 END AS INTEGER) AS n_children
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
""")
def child_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return history.mark_children(o, "o_custkey", ["o_orderkey"])
