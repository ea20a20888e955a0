"""Line deduplication by site-relative frequency.

Pages are grouped by host; a line's frequency on a site is the number of the host's pages that hold it,
divided by the host's pages. Lines above a boilerplate ratio are dropped from all pages of the host.

A host that holds a third of all pages is no single group: counts are by (host, line) and combined before
their shuffle, and so are the pages of a host. Only the places of candidate lines meet the boilerplate
lines; their join has written tables on both sides, so adaptive execution can split a line that very many
pages hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import id_filter, maybe_in, written

#: Elements without visible text, and comments.
UNSEEN = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
#: Tags that begin or end a line.
BREAKS = "(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|nav|tr|td|th|table|article|section|header|footer|title|head|body|html|blockquote|pre)\\b[^>]*>|[\\r\\n]+"
#: What is trimmed off a line: spaces, tabs, carriage returns, form feeds, no-break spaces.
BLANKS = " \t\r\f\u00a0"
#: Entities that are written out; &amp; comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """The visible lines of a page, without markup, trimmed and not empty."""
    whole = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    marked = F.regexp_replace(F.regexp_replace(whole, BREAKS, "\n"), "<[^>]*>", "")
    for entity, char in ENTITIES:
        marked = F.replace(marked, F.lit(entity), F.lit(char))
    return text_lines(marked)


def text_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The host in lower case, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def drop_boilerplate(pages: DataFrame, page_col: str, host: Column, lines: Column, *, ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(page id, host, n_lines int, n_kept int, text): each page without its site's boilerplate lines.

    A line counts once for a page. It is boilerplate where it is on at least ``min_pages`` pages of the
    host and on more than ``ratio`` of them; all its occurrences go, the other lines keep their order. A
    page without a line keeps an empty text; a null or unreadable address belongs to the host "". Rows that
    repeat an id count as pages of their own. Other columns are ignored; an empty table gives no rows.
    """
    read = written(pages.select(F.col(page_col).alias("_page"), host.alias("_host"), lines.alias("_lines")).withColumn("_row", F.monotonically_increasing_id()), "page-lines")
    key = F.unhex(F.md5(F.concat_ws("\n", "_host", "_line")))
    spoken = read.select("_host", F.explode(F.array_distinct("_lines")).alias("_line")).select("_host", key.alias("_key"))
    sites = written(read.groupBy("_host").agg(F.count("*").alias("_pages")), "sites")
    counts = written(spoken.groupBy("_host", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages), "line-counts")
    boilerplate = written(counts.join(sites, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages")).select("_key"), "boilerplate")
    places = maybe_in(read.select("_row", F.posexplode("_lines").alias("_at", "_line"), "_host").select("_row", "_at", key.alias("_key")), id_filter(boilerplate, "_key"), "_key")
    dropped = written(places.join(boilerplate, "_key").groupBy("_row").agg(F.collect_set("_at").alias("_drop")), "dropped-lines")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~F.array_contains("_drop", i)))
    return read.join(dropped, "_row", "left").withColumn("_kept", kept).select(
        F.col("_page").alias(page_col), F.col("_host").alias("host"), F.size("_lines").alias("n_lines"), F.size("_kept").alias("n_kept"), F.array_join("_kept", "\n").alias("text")
    )
