"""Line dedup: lines that too large a share of a site's pages carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import register, table
from linkloom.session import cut_lineage

#: A line on more than this share of a site's pages is boilerplate, if at least
#: so many pages have it (small sites say little).
MAX_SHARE_PERCENT = 10
MIN_PAGES = 5
BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """Lines are equal without regard to white space at their ends; blank lines have no key."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """``(_site, _line)``: 64-bit keys of lines over the ratio, for each site.

    Copies of a page count as one page, so a page that is stored many times is
    not taken for boilerplate. What travels is keys, never text; counting is
    combined before each shuffle, so neither a hot site nor a line on every page
    is gathered anywhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pages = docs.select(F.coalesce(F.xxhash64(site), F.lit(0)).alias("_site"), F.xxhash64(text).alias("_page"), text.alias("_text"))
    keys = F.array_compact(F.array_distinct(F.transform(_lines(F.col("_text")), _key)))
    # The null key stands for the page itself: one pass gives pages and lines.
    marked = F.concat(keys, F.array(F.lit(None).cast("bigint")))
    held = pages.select("_site", "_page", F.explode(marked).alias("_line")).distinct()
    counts = held.groupBy("_site", "_line").agg(F.count("*").alias("_n"))
    counts = cut_lineage(counts.where((F.col("_n") >= MIN_PAGES) | F.col("_line").isNull()), "line-counts")
    totals = counts.where("_line IS NULL").select("_site", F.col("_n").alias("_all"))
    often = counts.where("_line IS NOT NULL").join(totals, "_site")
    return often.where(F.col("_n") * 100 > F.col("_all") * MAX_SHARE_PERCENT).select("_site", "_line")


def cleaned(docs: DataFrame, site: str = "source") -> DataFrame:
    """``row`` (all columns), ``text`` without boilerplate lines, ``n_dropped``.

    A null site is a site of its own. A null text stays null; an empty one has no
    lines. Blank lines stay. Only the keys of lines found on the boilerplate list
    come back to a page, joined by site and page key: repeated rows and null ids
    are no matter.
    """
    listed = cut_lineage(boilerplate_lines(docs, site), "boilerplate")
    text = F.coalesce(F.col("text"), F.lit(""))
    site_key, page_key = F.coalesce(F.xxhash64(F.col(site)), F.lit(0)), F.xxhash64(text)
    keys = F.array_compact(F.array_distinct(F.transform(_lines(text), _key)))
    found = (
        docs.select(site_key.alias("_site"), page_key.alias("_page"), F.explode(keys).alias("_line"))
        .join(listed, ["_site", "_line"])
        .groupBy("_site", "_page")
        .agg(F.collect_set("_line").alias("_drop"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, site_key.alias("_site"), page_key.alias("_page")).join(found, ["_site", "_page"], "left")
    rest = F.filter(_lines(F.col("row.text")), lambda x: ~F.coalesce(F.array_contains("_drop", _key(x)), F.lit(False)))
    joined = joined.select("row", F.when(F.col("_drop").isNotNull(), rest).alias("_rest"))
    return joined.select(
        "row",
        F.when(F.col("_rest").isNull(), F.col("row.text")).otherwise(F.array_join("_rest", "\n")).alias("text"),
        F.coalesce(F.size(_lines(F.col("row.text"))) - F.size("_rest"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """``docs`` with cleaned texts; all columns stay, and ``n_chars`` (where there
    is one) is the new length of the rows that lost a line."""
    rows = cleaned(docs, site)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


_BARE = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
DEDUP_CTES = f"""
d AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{docs}}),
l AS (SELECT source, text, line, {_BARE} AS bare FROM (SELECT source, coalesce(text, '') AS text, unnest(lines) AS line FROM d)),
totals AS (SELECT source, count(DISTINCT coalesce(text, '')) AS pages FROM d GROUP BY source),
often AS (
  SELECT source, bare, count(DISTINCT text) AS n FROM l WHERE bare <> '' GROUP BY source, bare HAVING n >= {MIN_PAGES}),
listed AS (
  SELECT often.source, list(bare) AS bares FROM often JOIN totals ON often.source IS NOT DISTINCT FROM totals.source
  WHERE n * 100 > pages * {MAX_SHARE_PERCENT} GROUP BY often.source),
kept AS (
  SELECT d.*, list_filter(lines, lambda line: bares IS NULL OR NOT list_contains(bares, {_BARE})) AS rest
  FROM d LEFT JOIN listed ON d.source IS NOT DISTINCT FROM listed.source)
"""

ORACLE = f"""
WITH {DEDUP_CTES.format(docs="documents")}
SELECT doc_id, CASE WHEN len(rest) = len(lines) THEN text ELSE array_to_string(rest, chr(10)) END AS text,
  (len(lines) - len(rest))::BIGINT AS n_dropped
FROM kept
"""


@register("op3_line_dedup", ORACLE)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its site's boilerplate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cleaned(docs).select("row.doc_id", "text", "n_dropped")
