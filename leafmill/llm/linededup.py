"""Lines that a site repeats: a line goes where the share of the site's pages that have it exceeds a ratio.

Lines are compared without the spaces around them (spaces alone: a carriage return or a tab counts), by a 64-bit hash within one site. A page counts a line once. The
list of a site's boilerplate lines is short by itself: lines in more than `ratio` of the pages number at most the mean
distinct lines of a page divided by the ratio.

Nulls and odd input: rows with a null site are one site; a null text stays null and counts as a page; empty lines are
never counted or dropped; a line in fewer than `least` pages is never boilerplate, so small sites keep their text. Equal
rows are pages of their own. A page that loses every line keeps its row, with an empty text. Columns of the input stay and
may have any names; the columns of a report replace those of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_names, table

RATIO = 0.1
LEAST = 3
LARGE, SALTS = 256, 64
REPORT = ("host_pages", "n_lines", "n_dropped")

_BLOCKS = "p|div|li|ul|ol|nav|h[1-6]|article|aside|section|header|footer|main|title|table|tr|td|th|br|hr|pre|blockquote|body|head|html"
# The expressions hold in Java's and RE2's syntax alike.
HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
BLOCK = rf"(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?/?>"
TAG = r"</?[A-Za-z][^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_text(html: Column) -> Column:
    """The text of a page, a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """__host, __pages and __lines, the hashes of its boilerplate lines, for each site."""
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.coalesce(F.col(text), F.lit(""))), lambda x: F.trim(x) != ""), _key))
    p = pages.select(F.col(host).alias("__host"), keys.alias("__keys"))
    totals = p.groupBy("__host").agg(F.count("*").alias("__pages"))
    # explode() would have Spark test the keys' number first, for which it makes them again
    each = p.select("__host", F.explode_outer("__keys").alias("__line")).filter(F.col("__line").isNotNull())
    counts = each.groupBy("__host", "__line").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    t = totals.select(F.col("__host").alias("__h"), "__pages")
    common = counts.join(t, F.col("__host").eqNullSafe(F.col("__h"))).filter(F.col("__n") > F.lit(ratio) * F.col("__pages"))
    lists = common.groupBy("__host").agg(F.collect_list("__line").alias("__lines"))
    return totals.join(lists.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h")), "left").drop("__h")


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least: int = LEAST, report: bool = False) -> DataFrame:
    """pages with the boilerplate lines gone from text; report adds host_pages, n_lines and n_dropped."""
    cols = pages.columns
    pages, (text, host) = plain_names(pages, text, host)
    sites = materialize(boilerplate(pages, text, host, ratio, least), "sites")
    every = sites.agg(F.sum("__pages")).first()[0] or 0
    # sites with more than a LARGE-th of all pages, which are less than LARGE, are dealt over SALTS tasks each
    large = F.broadcast(sites.filter(F.col("__pages") * LARGE > every).select(F.col("__host").alias("__large"), F.lit(SALTS).alias("__salts")))
    lists = (sites if report else sites.filter(F.col("__lines").isNotNull())).join(large, F.col("__host").eqNullSafe(F.col("__large")), "left")
    lists = lists.select("__host", "__pages", "__lines", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt"))
    plain = [c for c, kind in pages.dtypes if "map<" not in kind]
    dealt = pages.join(large, F.col(host).eqNullSafe(F.col("__large")), "left").withColumn("__own", F.pmod(F.xxhash64(*plain), F.coalesce("__salts", F.lit(1))).cast("int"))
    joined = dealt.join(lists, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left")
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains("__lines", _key(x)) | (F.trim(x) == ""))
    new = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    if not report:
        return joined.withColumn(text, new).select(pages.columns).toDF(*cols)
    full = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    was = full(F.coalesce(lines, F.array().cast("array<string>")))
    told = joined.withColumns({"host_pages": F.col("__pages"), "n_lines": was, "__new": new})
    told = told.withColumn("n_dropped", F.col("n_lines") - full(F.coalesce(lines_of(F.col("__new")), F.array().cast("array<string>")))).withColumn(text, F.col("__new"))
    stay = {c: name for c, name in zip(pages.columns, cols) if name not in REPORT}
    return told.select(*(F.col(c).alias(name) for c, name in stay.items()), *REPORT)


def op4(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    pages = materialize(pages, "page-texts")  # for the counts and for the cut: markup is taken away once
    return drop_boilerplate(pages, "text", "host", report=True)


#: The same in DuckDB's SQL.
SQL = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS text FROM pages),
t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
l AS (SELECT DISTINCT page_id, host, trim(x) AS line FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS x FROM p) WHERE trim(x) <> ''),
b AS (SELECT l.host, list(line) AS lines FROM (SELECT host, line, count(*) AS n FROM l GROUP BY ALL) l JOIN t ON l.host IS NOT DISTINCT FROM t.host WHERE n >= {LEAST} AND n > {RATIO}::DOUBLE * host_pages GROUP BY l.host),
r AS (SELECT p.*, host_pages, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(b.lines, []), trim(x))) AS k
  FROM p JOIN t ON p.host IS NOT DISTINCT FROM t.host LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, array_to_string(k, chr(10)) AS text, host_pages, coalesce(len(list_filter(a, lambda x: trim(x) <> '')), 0)::BIGINT AS n_lines,
  coalesce(len(list_filter(a, lambda x: trim(x) <> '')) - len(list_filter(k, lambda x: trim(x) <> '')), 0)::BIGINT AS n_dropped FROM r
"""
