"""Sitemaps and URL lists, read from a table of fetched documents.

``docs``: doc_url, status, content_type, text, error and optionally safe,
reason (see :func:`linkloom.sources.network.url_safety`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls
from linkloom.operators.matching import limit_per_key

# --- fixed values -----------------------------------------------------------
MAX_DEPTH = 2
MAX_URLS = 10_000
MAX_CHARS = 50 * 1024 * 1024
# ----------------------------------------------------------------------------

_XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def looks_like_xml(text: Column, content_type: Column) -> Column:
    return F.coalesce(
        F.startswith(F.ltrim(tx.trim_blank(text)), F.lit("<"))
        | F.contains(F.coalesce(content_type, F.lit("")), F.lit("xml")),
        F.lit(False),
    )


def _leading_entries(text: Column) -> Column:
    """The first ``MAX_CHARS`` characters; of a longer XML document only whole
    entries, with its root closed again, so that it still parses."""
    root = F.regexp_extract(text, r"<((?:\w+:)?(?:urlset|sitemapindex))[\s>/]", 1)
    whole = F.regexp_extract(
        F.substring(text, 1, MAX_CHARS), r"(?s)\A(.*</(?:\w+:)?(?:url|sitemap)\s*>)", 1
    )
    return F.when(F.length(text) <= MAX_CHARS, text).otherwise(
        F.concat(whole, F.lit("</"), root, F.lit(">"))
    )


def _classified(docs: DataFrame) -> DataFrame:
    """Adds kind (index, urlset, list, other, none) and the links found."""
    have = set(docs.columns)
    safe = F.col("safe") if "safe" in have else F.lit(True)
    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    kind_col = F.col("content_type") if "content_type" in have else F.lit(None).cast("string")
    text = F.substring("text", 1, MAX_CHARS)
    usable = safe & error.isNull() & F.col("status").between(200, 299)
    xml = looks_like_xml(F.col("text"), kind_col)
    body = _leading_entries(F.regexp_replace("text", r"\A\x{FEFF}", ""))
    lines = F.filter(
        F.transform(F.split(text, "\n"), tx.trim_blank), lambda u: u.rlike(r"\Ahttps?://")
    )
    doc = F.from_xml(
        F.when(usable & xml, body),
        "url array<struct<loc string>>, sitemap array<struct<loc string>>",
        _XML_OPTIONS,
    )

    def locs(entries: Column) -> Column:
        return F.filter(
            F.transform(entries, lambda e: tx.trim_blank(F.coalesce(e["loc"], F.lit("")))),
            lambda loc: loc != "",
        )

    return docs.withColumn("_doc", doc).select(
        *docs.columns,
        F.when(~usable, "none")
        .when(~xml, "list")
        .when(F.col("text").rlike(r"<(\w+:)?sitemapindex[\s>/]"), "index")
        .when(F.col("text").rlike(r"<(\w+:)?urlset[\s>/]"), "urlset")
        .otherwise("other")
        .alias("kind"),
        F.when(~xml, lines)
        .otherwise(locs(F.coalesce("_doc.url", F.array().cast("array<struct<loc:string>>"))))
        .alias("locs"),
        locs(F.coalesce("_doc.sitemap", F.array().cast("array<struct<loc:string>>"))).alias(
            "children"
        ),
    )


def sitemap_index_expand(docs: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Documents reached from each root, at most ``max_depth`` levels down.

    Returns root, depth, path (child positions, the visiting order) and the
    document's columns with kind and locs. Documents never fetched have kind
    null. One join per level.
    """
    table = _classified(docs)
    frontier = roots.select(
        F.col("url").alias("root"),
        F.col("url").alias("doc_url"),
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("path"),
    )
    visited = None
    for depth in range(max_depth + 1):
        level = frontier.join(table, "doc_url", "left")
        visited = level if visited is None else visited.unionByName(level)
        if depth < max_depth:
            frontier = (
                level.filter(F.col("kind") == "index")
                .select("root", "path", F.posexplode("children").alias("_pos", "doc_url"))
                .select(
                    "root",
                    "doc_url",
                    F.lit(depth + 1).alias("depth"),
                    F.concat("path", F.array("_pos")).alias("path"),
                )
            )
    return visited.drop("children")


def sitemap_urls(visited: DataFrame, cap: int = MAX_URLS) -> DataFrame:
    """URLs per root: first spelling of each normalised URL in visiting order,
    the first ``cap`` of them. Returns root, url, pos and total (before the cap)."""
    found = (
        visited.filter(F.col("kind").isin("urlset", "list"))
        .select("root", F.posexplode("locs").alias("_at", "url"), "path")
        .withColumn("_order", F.concat("path", F.array("_at")))
        .withColumn("_key", urls.normalize_crawl_url(F.col("url")))
    )
    unique = found.groupBy("root", "_key").agg(
        F.min(F.struct("_order", "url")).alias("_first")
    )
    totals = unique.groupBy("root").agg(F.count("*").alias("total"))
    kept = limit_per_key(unique, ["root"], [F.col("_first._order")], cap)
    lists = kept.groupBy("root").agg(F.array_sort(F.collect_list("_first")).alias("_urls"))
    return (
        lists.join(totals, "root")
        .select("root", "total", F.posexplode("_urls").alias("pos", "_u"))
        .select("root", F.col("_u.url").alias("url"), "pos", "total")
    )


def url_list_text(docs: DataFrame) -> DataFrame:
    """One row per http(s) line of plain-text documents."""
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        F.posexplode(F.split("text", "\n")).alias("line", "_raw"),
    ).select(
        *[c for c in docs.columns if c != "text"],
        "line",
        tx.trim_blank(F.col("_raw")).alias("url"),
    ).filter(F.col("url").rlike(r"\Ahttps?://"))


def url_list_rows(df: DataFrame) -> DataFrame:
    """A caller-supplied list: at least one row, every row a URL."""
    if df.filter(~urls.is_url(F.col("url"))).limit(1).count():
        raise ValueError("the list holds a text that is no URL")
    if df.isEmpty():
        raise ValueError("the list is empty")
    return df.select("url")


def fetch_warnings(visited: DataFrame) -> DataFrame:
    """Warnings per visited document: root, doc_url, warnings (array)."""
    have = set(visited.columns)
    url = F.col("doc_url")
    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    depth = F.col("depth") if "depth" in have else F.lit(0)
    unsafe = ~F.coalesce(F.col("safe"), F.lit(True)) if "safe" in have else F.lit(False)
    reason = F.col("reason") if "reason" in have else F.lit(None).cast("string")
    fetched = ~unsafe & error.isNull() & F.col("status").between(200, 299)

    def line(condition: Column, *parts) -> Column:
        return F.when(condition, F.concat(*parts))

    all_lines = F.array(
        line(
            unsafe,
            F.lit("SSRF guard blocked URL (skipped): "),
            url,
            F.lit(" — "),
            F.coalesce(reason, F.lit("unsafe")),
        ),
        line(~unsafe & error.isNotNull(), F.lit("Failed to fetch "), url, F.lit(": "), error),
        line(
            ~unsafe & error.isNull() & ~F.col("status").between(200, 299),
            F.lit("Non-200 HTTP status "),
            F.col("status").cast("string"),
            F.lit(" fetching "),
            url,
        ),
        line(
            fetched & (F.length("text") > MAX_CHARS),
            F.lit("Response from "),
            url,
            F.lit(" exceeds 50MB decompressed size limit; truncating"),
        ),
        line(
            fetched & (F.col("kind") == "list") & (F.size("locs") == 0),
            F.lit("No URLs found in response from "),
            url,
            F.lit("; content does not look like XML or a valid URL list"),
        ),
        line(
            fetched & (F.col("kind") == "other"),
            F.lit("Unrecognized sitemap format at "),
            url,
            F.lit("; no <sitemapindex> or <urlset> found"),
        ),
        line(
            fetched & (F.col("kind") == "index") & (depth >= MAX_DEPTH),
            F.lit("Sitemap index at depth "),
            depth.cast("string"),
            F.lit(f" exceeds maximum recursion depth of {MAX_DEPTH}; child sitemaps skipped"),
        ),
    )
    keep = [c for c in ("root", "doc_url", "depth") if c in have]
    return visited.select(*keep, F.array_compact(all_lines).alias("warnings"))


def cap_warnings(found: DataFrame, cap: int = MAX_URLS) -> DataFrame:
    """Roots whose URL list was cut."""
    return (
        found.filter(F.col("total") > cap)
        .select(
            "root",
            F.concat(
                F.lit(f"URL count cap of {cap:,} reached while parsing "),
                F.col("root"),
                F.lit("; additional URLs were truncated"),
            ).alias("warning"),
        )
        .distinct()
    )
