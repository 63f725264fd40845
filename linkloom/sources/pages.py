"""Pages to articles: parse, normalise, hash, scope."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import text as tx
from linkloom.functions import urls
from linkloom.functions.let import let
from linkloom.schemas import LINK, METADATA
from linkloom.sources.html import extract, extract_markdown

EXTRACTED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("h1", T.StringType()),
        T.StructField("h2s", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("canonical", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("robots", T.StringType()),
    ]
)

_ARROW_LINK = pa.struct([("href", pa.string()), ("anchor_text", pa.string())])
_ARROW_EXTRACTED = pa.struct(
    [
        ("title", pa.string()),
        ("h1", pa.string()),
        ("h2s", pa.list_(pa.string())),
        ("body", pa.string()),
        ("links", pa.list_(_ARROW_LINK)),
        ("canonical", pa.string()),
        ("description", pa.string()),
        ("robots", pa.string()),
    ]
)


@F.arrow_udf(EXTRACTED)
def _extract(content: pa.Array, format: pa.Array, bare: pa.Array) -> pa.Array:
    rows = []
    bare_references = len(bare) > 0 and bare[0].as_py()
    for doc, kind in zip(content.to_pylist(), format.to_pylist()):
        if doc is None:
            rows.append(None)
        elif kind == "markdown":
            rows.append(extract_markdown(doc))
        elif kind == "text":
            rows.append({"body": doc, "links": [], "h2s": []})
        else:
            rows.append(extract(doc, bare_references))
    return pa.array(rows, type=_ARROW_EXTRACTED)


def scan_pages(df: DataFrame, **columns: Column) -> DataFrame:
    """A crawl log as parser input.

    ``columns`` maps log columns onto url, html, http_status,
    response_time_ms, error and failure_type; absent ones become null.
    """
    shape = {
        "url": "string",
        "html": "string",
        "http_status": "int",
        "response_time_ms": "int",
        "error": "string",
        "failure_type": "string",
    }
    pick = {
        name: columns.get(name, F.col(name) if name in df.columns else F.lit(None))
        for name in shape
    }
    keep = [c for c in df.columns if c not in shape]
    return df.select(*keep, *[c.cast(shape[n]).alias(n) for n, c in pick.items()])


def _nullable(c: Column) -> Column:
    return F.when(c != "", c)


def internal_links(links: Column, url: Column) -> Column:
    """Links with text whose host is the page's own."""
    trimmed = F.filter(
        F.transform(
            links,
            lambda x: F.struct(
                x["href"].alias("href"), tx.trim_blank(x["anchor_text"]).alias("anchor_text")
            ),
        ),
        lambda x: x["anchor_text"] != "",
    )

    def kept(named: Column) -> Column:
        hrefs = F.transform(named, lambda x: x["href"])
        relative = F.transform(hrefs, lambda h: ~h.rlike(r"(?i)\A\s*([a-z][a-z0-9+.\-]*:|//)"))
        stays = F.when(url.rlike("(?i)^https?:"), urls.own_host(hrefs, url)).otherwise(relative)
        return let(stays, lambda own: F.filter(named, lambda x, i: F.get(own, i)))

    return let(trimmed, kept)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has too few splits for CPU-heavy work.

    For file scans only (counting the partitions of a shuffled plan would run
    it). A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parse_pages(pages: DataFrame, bare_references: bool = True) -> DataFrame:
    """HTML, Markdown or text pages to title, body, links and metadata.

    Input columns: url, html and optionally format, http_status,
    response_time_ms; every other column is carried through. One Arrow UDF
    call per page, no shuffle. Without ``bare_references`` only character references
    that end in a semicolon are decoded.
    """
    have = set(pages.columns)
    kind = F.col("format") if "format" in have else F.lit("html")
    status = (F.col("http_status") if "http_status" in have else F.lit(None)).cast("int")
    elapsed = (F.col("response_time_ms") if "response_time_ms" in have else F.lit(None)).cast("int")
    carried = [
        c for c in pages.columns if c not in ("html", "format", "http_status", "response_time_ms")
    ]
    # The page text itself is dropped right after extraction.
    extracted = pages.select(
        *carried,
        status.alias("http_status"),
        elapsed.alias("_elapsed"),
        _extract(F.col("html"), kind, F.lit(bare_references)).alias("_x"),
    )
    meta_title = tx.trim_blank(F.coalesce(F.col("_x.title"), F.lit("")))
    h1 = tx.trim_blank(F.coalesce(F.col("_x.h1"), F.lit("")))
    robots = F.lower(F.coalesce(F.col("_x.robots"), F.lit("")))
    shaped = extracted.select(
        *carried,
        F.when(meta_title != "", meta_title).otherwise(h1).alias("title"),
        F.col("_x.body").alias("body"),
        internal_links(F.col("_x.links"), F.col("url")).alias("existing_links"),
        F.struct(
            _nullable(F.col("_x.canonical")).alias("canonical"),
            _nullable(meta_title).alias("meta_title"),
            _nullable(F.col("_x.description")).alias("meta_description"),
            _nullable(h1).alias("h1"),
            F.transform(F.col("_x.h2s"), tx.trim_blank).alias("h2s"),
            F.contains(robots, F.lit("noindex")).alias("noindex"),
            F.contains(robots, F.lit("nofollow")).alias("nofollow"),
            F.col("http_status").alias("http_status"),
            F.col("_elapsed").alias("response_time_ms"),
        )
        .cast(METADATA)
        .alias("metadata"),
        "http_status",
    )
    counted = shaped.withColumn("word_count", tx.word_count(F.col("body")))
    return counted.withColumn(
        "parse_warning", tx.near_empty_warning(F.col("word_count"), F.col("http_status"))
    )


def link_edges(parsed: DataFrame, key: str = "url") -> DataFrame:
    """Existing links as an edge table."""
    return parsed.select(key, F.explode("existing_links").alias("link")).select(
        F.col(key),
        F.col("link.href").alias("href"),
        F.col("link.anchor_text").alias("anchor_text"),
    )


def normalize_articles(parsed: DataFrame, project: Column, source_type: str) -> DataFrame:
    """Add tenant, deterministic id, content hashes and the source type."""
    return parsed.withColumns(
        {
            "project_id": project,
            "article_id": F.sha2(F.concat_ws("\n", project, F.col("url")), 256),
            "body_hash": tx.content_hash(F.col("body")),
            "title_hash": tx.content_hash(F.col("title")),
            "source_type": F.lit(source_type),
        }
    )


def scoped(df: DataFrame, project_id) -> DataFrame:
    """Rows of one tenant; prunes partitions where the table is laid out by it."""
    return df.filter(F.col("project_id") == project_id)


def scoped_write(df: DataFrame, project_id) -> DataFrame:
    """Force the tenant on rows about to be written."""
    return df.withColumn("project_id", F.lit(project_id))


def article_summaries(articles: DataFrame) -> DataFrame:
    """Articles without the wide columns, JSON flags lifted."""
    return articles.select(
        "project_id",
        "article_id",
        "url",
        "title",
        "body_hash",
        "title_hash",
        "word_count",
        "existing_links",
        "http_status",
        "parse_warning",
        "embedding_model",
        F.col("embedding").isNotNull().alias("has_embedding"),
        F.coalesce(F.col("metadata.noindex"), F.lit(False)).alias("noindex"),
        F.coalesce(F.col("metadata.nofollow"), F.lit(False)).alias("nofollow"),
        F.col("metadata.canonical").alias("canonical_url"),
    )


def article_bodies(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Bodies of the given ids within their tenant, the body column read late."""
    return articles.select("project_id", "article_id", "body").join(
        ids.select("project_id", "article_id").distinct(), ["project_id", "article_id"], "left_semi"
    )
