"""Removal of boilerplate lines by their frequency within a site (operator 1).

For every host, the pages that contain a line are divided by the host's pages; lines over ``ratio`` and
on ``min_pages`` pages or more are dropped from all its pages. Everything is a DataFrame operation:

* (host, line hash) is counted with map-side aggregation, so neither a large host nor a common line is
  gathered anywhere;
* a host's boilerplate is one array: on average a page has no more lines than ratio times its length,
  so the array is at most the host's mean number of lines per page divided by ``ratio``;
* pages join their host's array; adaptive execution splits a host with very many pages.

A line counts once per page. Null text has no lines, and a page without a host (null or malformed url)
belongs to no site and keeps all its lines. Very long pages take time in proportion to their length, whatever is left unclosed in
them. Repeated rows are pages of their own. No column of the input
is lost or replaced: results get a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import free_name, table, written

RATIO = 0.3
MIN_PAGES = 3

# Applied in this order to turn HTML into text with one line per block. A script, style or comment that is not closed ends with
# the page, and a tag ends before the next "<": no pattern reads a stretch again, so a page takes time in proportion to its length.
HTML_STEPS = (
    (r"(?is)<script\b.*?(?:</script[^>]*(?:>|\z)|\z)", " "),
    (r"(?is)<style\b.*?(?:</style[^>]*(?:>|\z)|\z)", " "),
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"[ \t\n\r\x0B\f]+", " "),
    (
        r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|"
        r"ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^<>]*>",
        "\n",
    ),
    (r"<[^<>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r" +", " "),
    (r" ?\n ?", "\n"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def html_lines(html: Column) -> Column:
    for pattern, to in HTML_STEPS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(to))
    return lines_of(html)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def drop_boilerplate(pages: DataFrame, lines: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, str]:
    """The pages with the lines that stay, in order, and the name of that column.

    ``lines``: column of line arrays; ``host``: column that names the site. ``pages`` is read three times:
    pass written rows if they are costly to make.
    """
    hashed = F.array_distinct(F.transform(F.col(lines), lambda x: F.xxhash64(x)))
    on_site = pages.where(F.col(host).isNotNull())
    counts = on_site.select(F.col(host).alias("site"), F.explode(hashed).alias("line")).groupBy("site", "line")
    counts = counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = on_site.groupBy(F.col(host).alias("site")).agg(F.count(F.lit(1)).alias("total"))
    common = counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("total"))
    site, drop, kept = free_name(pages, "site"), free_name(pages, "boilerplate"), free_name(pages, "kept_lines")
    common = common.groupBy("site").agg(F.collect_set("line").alias("line")).toDF(site, drop)
    joined = pages.join(common, F.col(host) == F.col(site), "left")
    # Most pages hold few of their host's boilerplate lines, so look those up, not the whole array.
    here = F.array_intersect(F.transform(F.col(lines), lambda x: F.xxhash64(x)), F.col(drop))
    stay = F.filter(F.col(lines), lambda x: ~F.array_contains(F.col(drop), F.xxhash64(x)))
    out = joined.withColumn(drop, here)
    out = out.withColumn(kept, F.when(F.coalesce(F.size(drop), F.lit(0)) > 0, stay).otherwise(F.col(lines)))
    return out.select(*pages.columns, kept), kept


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = F.coalesce(html_lines(F.col("html")), F.array().cast("array<string>"))
    pages = written(pages.select("page_id", host_of(F.col("url")).alias("host"), lines.alias("lines")))
    out, kept = drop_boilerplate(pages, "lines", "host")
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )


def _sql_lines() -> str:
    out = "html"
    for pattern, to in HTML_STEPS:
        p, t = pattern.replace("'", "''"), to.replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{p}', '{t}', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


OP1_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
    coalesce({_sql_lines()}, []) AS lines FROM pages),
l AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM p),
n AS (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE host IS NOT NULL GROUP BY host, line),
t AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT host, line FROM n JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * total),
k AS (SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY k) AS s FROM l
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.host = l.host AND b.line = l.line) GROUP BY r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
  sha256(coalesce(s, '')) AS kept_sha256
FROM p LEFT JOIN k USING (r)
"""
