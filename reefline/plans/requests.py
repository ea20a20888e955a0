"""The public collections over driver tables, and requests to them.

Regions and nations are locations, suppliers are protected areas, customers and their orders give the
statistics: by year, by segment (habitats), by priority and by status (levels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.operators.requests import Catalogue, Collection, Link
from reefline.plans.catalog import query, table

_LOCATIONS = """
SELECT 'N' || n_nationkey AS code, n_name AS name, 'country' AS type, n_nationkey * 100.0::DOUBLE AS total_area FROM nation
UNION ALL SELECT 'R' || r_regionkey, r_name, 'region', NULL FROM region"""
_COVERAGE = """
SELECT 'N' || c_nationkey || '-' || year(o_orderdate) AS id, 'N' || c_nationkey AS location_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(COUNT(*) AS BIGINT) AS protected_areas_count, ROUND(SUM(o_totalprice), 2) AS protected_area,
 year(o_orderdate) = MAX(year(o_orderdate)) OVER (PARTITION BY c_nationkey) AS is_last_year FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)"""


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    n, r, s, c, o = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer", "orders"))
    code = lambda letter, key: F.concat(F.lit(letter), key)
    none = F.lit(None).cast("double")
    countries = n.select(code("N", "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit("country").alias("type"), (F.col("n_nationkey") * 100.0).alias("total_area"))
    regions = r.select(code("R", "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("region").alias("type"), none.alias("total_area"))
    members = n.select(code("R", "n_regionkey").alias("region"), code("N", "n_nationkey").alias("member"))
    areas = s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("area"), code("N", "s_nationkey").alias("location_code"), F.concat(F.lit("source-"), F.col("s_suppkey") % 3).alias("source_slug")
    )
    sources = areas.select(F.col("source_slug").alias("slug")).distinct().withColumns({"title": F.concat(F.lit("Source "), F.right("slug", F.lit(1))), "url": F.lit(None).cast("string")})
    title = sources.select(F.col("slug").alias("document"), F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("locale"), F.right("slug", F.lit(1)).alias("k"))
    titles = title.where("not (locale = 'fr' and k = '2')").select("document", "locale", F.concat(F.when(F.col("locale") == "fr", "Source de données ").otherwise("Data source "), "k").alias("title"))
    ordered = o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def stats(kind, by: str | None) -> DataFrame:
        keys = [F.col("c_nationkey"), *([F.col(by).alias("slug")] if by else []), *([F.year("o_orderdate").alias("year")] if not by else [])]
        out = ordered.groupBy(*keys).agg(F.count("*").alias("protected_areas_count"), F.round(F.sum("o_totalprice"), 2).alias("protected_area"))
        parts = [code("N", "c_nationkey"), F.col("slug") if by else F.col("year")]
        return out.select(F.concat_ws("-", *parts).alias("id"), code("N", "c_nationkey").alias("location_code"), *([F.col("slug").alias(f"{kind}_slug")] if by else ["year"]), "protected_areas_count", "protected_area")

    coverage = stats(None, None)
    last = coverage.groupBy(F.col("location_code").alias("_l")).agg(F.max("year").alias("_y"))
    coverage = coverage.join(last, F.col("location_code") == F.col("_l")).withColumn("is_last_year", F.col("year") == F.col("_y")).drop("_l", "_y")
    lookup = lambda column, df: df.select(F.col(column).alias("slug")).distinct().withColumn("name", F.initcap(F.lower("slug")))
    shown = ["id", "protected_areas_count", "protected_area"]
    to_location = Link("locations", "location_code", "code")

    def by(kind: str, column: str) -> Collection:
        return Collection(stats(kind, column), "id", shown, {"location": to_location, kind: Link(f"{kind}s", f"{kind}_slug", "slug")})

    return Catalogue(
        {
            "locations": Collection(
                countries.unionByName(regions), "code", ["code", "name", "type", "total_area"],
                {"members": Link("locations", "code", "code", True, (members, "region", "member")), "groups": Link("locations", "code", "code", True, (members, "member", "region")), "pas": Link("pas", "code", "location_code", True)},
            ),
            "pas": Collection(areas, "id", ["id", "name", "area"], {"location": to_location, "data_source": Link("data-sources", "source_slug", "slug")}),
            "data-sources": Collection(sources, "slug", ["slug", "title", "url"], names=titles),
            "protection-coverage-stats": Collection(coverage, "id", [*shown, "year", "is_last_year"], {"location": to_location}),
            "habitat-stats": by("habitat", "c_mktsegment"),
            "fishing-protection-level-stats": by("fishing_protection_level", "o_orderpriority"),
            "mpaa-protection-level-stats": by("mpaa_protection_level", "o_orderstatus"),
            "habitats": Collection(lookup("c_mktsegment", c), "slug", ["slug", "name"]),
            "fishing_protection_levels": Collection(lookup("o_orderpriority", o), "slug", ["slug", "name"]),
            "mpaa_protection_levels": Collection(lookup("o_orderstatus", o), "slug", ["slug", "name"]),
        }
    )


PUBLIC = ["locations", "pas", "protection-coverage-stats", "habitat-stats", "fishing-protection-level-stats", "mpaa-protection-level-stats"]


@query(f"""
WITH s AS ({_COVERAGE}), l AS ({_LOCATIONS})
SELECT s.id, protected_area, code, name FROM s JOIN l ON code = location_code WHERE type = 'country' AND is_last_year AND protected_areas_count >= 2 ORDER BY name DESC, s.id LIMIT 10 OFFSET 10
""")
def requested_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter and a sort through a relation, a page, and fields of the relation."""
    text = (
        "fields[0]=protected_area&filters[location][type][$eq]=country&filters[is_last_year][$eq]=true&filters[protected_areas_count][$gte]=2"
        "&populate[location][fields][0]=code&populate[location][fields][1]=name&sort=location.name:desc&pagination[page]=2&pagination[pageSize]=10"
    )
    data, _ = catalogue(spark, sf_dir).read("protection-coverage-stats", text)
    return data.select("id", "protected_area", "location.code", "location.name")


@query("""
WITH p AS (SELECT s_suppkey, s_name, s_acctbal, s_nationkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier WHERE s_acctbal > 1000)
SELECT r_name AS region, n_name AS member, s_name AS pa, CAST(k - 1 AS INTEGER) AS place, CASE s_suppkey % 3 WHEN 2 THEN 'Data source 2' ELSE 'Source de données ' || (s_suppkey % 3) END AS title
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN p ON s_nationkey = n_nationkey
""")
def requested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their members, those with their filtered and sorted areas, those with their source in a
    locale that lacks one title."""
    request = {
        "filters": {"type": {"$eq": "region"}},
        "populate": {"members": {"fields": ["name"], "populate": {"pas": {"fields": ["name"], "filters": {"area": {"$gt": 1000}}, "sort": "area:desc", "populate": {"data_source": {"fields": ["title"]}}}}}},
        "locale": "fr",
    }
    data, _ = catalogue(spark, sf_dir).read("locations", request)
    members = data.select(F.col("name").alias("region"), F.explode("members").alias("m"))
    return members.select("region", F.col("m.name").alias("member"), F.posexplode("m.pas").alias("place", "p")).select("region", "member", F.col("p.name").alias("pa"), "place", F.col("p.data_source.title").alias("title"))


@query(f"""
WITH l AS ({_LOCATIONS}), hit AS (SELECT DISTINCT 'N' || s_nationkey AS code FROM supplier WHERE s_suppkey % 3 = 1 AND s_acctbal > 3000)
SELECT code, name, CAST((SELECT COUNT(*) FROM supplier WHERE 'N' || s_nationkey = code) AS INTEGER) AS n_pas FROM l WHERE (code IN (FROM hit) OR name LIKE '%7') AND NOT code IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 0) AND type = 'country' ORDER BY total_area DESC, code LIMIT 6 OFFSET 2
""")
def requested_through_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters through to-many relations and a table of pairs, with or and not, before the page is cut; in
    the older mode with comma lists."""
    request = {
        "filters": {
            "$or": [{"pas": {"data_source": {"slug": {"$eq": "source-1"}}, "area": {"$gt": 3000}}}, {"name": {"$endsWith": "7"}}],
            "$not": {"groups": {"code": "R0"}},
            "type": {"$eq": "country"},
        },
        "fields": "code,name",
        "populate": "pas,groups",
        "sort": "total_area:desc,code:asc",
        "pagination": {"start": "2", "limit": "6"},
    }
    data, _ = catalogue(spark, sf_dir).read("locations", request, v4=True)
    return data.select("code", "name", F.size("pas").alias("n_pas"))


_BY = "SELECT COUNT(*) AS n, MIN(id) AS first FROM (SELECT 'N' || c_nationkey || '-' || {0} AS id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_LISTS = " UNION ALL ".join(
    f"SELECT '{name}' AS collection, * FROM ({sql})"
    for name, sql in (
        ("locations", f"SELECT COUNT(*) AS n, MIN(code) AS first FROM ({_LOCATIONS})"), ("pas", "SELECT COUNT(*) AS n, CAST(MIN(s_suppkey) AS VARCHAR) AS first FROM supplier"),
        ("protection-coverage-stats", _BY.format("year(o_orderdate)")), ("habitat-stats", _BY.format("c_mktsegment")),
        ("fishing-protection-level-stats", _BY.format("o_orderpriority")), ("mpaa-protection-level-stats", _BY.format("o_orderstatus")),
    )
)


@query(f"""SELECT collection, n AS total, CAST(CEIL(n / 7.0) AS BIGINT) AS pages, LEAST(n, 7) AS on_page, first AS id, 1::BIGINT AS found FROM ({_LISTS})""")
def public_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each public collection as a list and by id: the total, the pages, the first page, its first record."""
    known, out = catalogue(spark, sf_dir), None
    for name in PUBLIC:
        key = known.collections[name].id
        data, meta = known.read(name, {"pagination": {"page": 1, "pageSize": 7}, "populate": "*"})
        first = data.agg(F.count("*").alias("on_page"), F.min(key).cast("string").alias("id"))
        sample = known.rows(name).agg(F.min(key)).first()[0]
        found = known.find(name, sample, {"populate": "*"}).agg(F.count("*").alias("found"))
        row = meta.crossJoin(first).crossJoin(found).select(F.lit(name).alias("collection"), "total", F.col("pageCount").alias("pages"), "on_page", "id", "found")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
