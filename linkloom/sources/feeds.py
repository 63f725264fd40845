"""Uploaded files, JSON manifests and pushed articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import text as tx
from linkloom.functions import urls
from linkloom.schemas import LINK, METADATA
from linkloom.sources.pages import parse_pages

# --- fixed values -----------------------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 50 * 1024 * 1024
EXTENSIONS = (".html", ".htm", ".md", ".markdown", ".json")
PUSH_FORMATS = ("html", "text", "markdown")
# ----------------------------------------------------------------------------

_ENTRIES = "array<struct<url:string,title:string,body:string,metadata:string>>"


def upload_problems(files: DataFrame) -> DataFrame:
    """Files (name, length) that make an upload invalid, with the reason."""
    name = F.concat(F.lit('File "'), F.col("name"), F.lit('" '))
    extension = tx.file_extension(F.col("name"))
    problem = (
        F.when(F.col("length") == 0, F.concat(name, F.lit("is empty")))
        .when(
            F.col("length") > MAX_FILE_BYTES,
            F.concat(name, F.lit("exceeds the 10MB per-file limit")),
        )
        .when(
            ~extension.isin(*EXTENSIONS),
            F.concat(name, F.lit('has unsupported extension "'), extension, F.lit('"')),
        )
    )
    return files.select("name", "length", problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )


def scan_upload_dir(
    spark: SparkSession, path: str, max_total: int | None = MAX_TOTAL_BYTES
) -> DataFrame:
    """Files of a folder as name, extension, content (text) and synthetic url.

    The whole upload is refused if one file is invalid (an empty one too) or the
    total is too large; ``max_total=None`` lifts the total for bulk loads. Names
    come from the file index that the scan itself is planned with.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    sizes = named.select("name", "length")
    # A file scan leaves empty files out; the listing still has them.
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string")
    names = listed.select(
        F.url_decode(F.regexp_extract("file", "([^/]+)$", 1)).alias("name"),
        F.lit(0).cast("bigint").alias("length"),
    )
    sizes = sizes.unionByName(names.join(sizes, "name", "left_anti"))
    bad = upload_problems(sizes).orderBy("name").first()
    if bad is not None:
        raise ValueError(bad.problem)
    if max_total is not None:
        total = sizes.agg(F.sum("length").alias("n")).first().n or 0
        if total > max_total:
            raise ValueError("Total upload size exceeds the 50MB limit")
    return named.select(
        "name",
        tx.file_extension(F.col("name")).alias("extension"),
        F.decode("content", "UTF-8").alias("content"),
        F.concat(F.lit("upload://"), F.col("name")).alias("url"),
    )


def upload_pages(files: DataFrame, bare_references: bool = True) -> DataFrame:
    """HTML and Markdown files parsed."""
    docs = files.filter(F.col("extension") != ".json").select(
        "name",
        "url",
        F.col("content").alias("html"),
        F.when(F.col("extension").isin(".md", ".markdown"), "markdown")
        .otherwise("html")
        .alias("format"),
    )
    return parse_pages(docs, bare_references)


def _no_metadata(meta_title: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        null.alias("canonical"),
        meta_title.alias("meta_title"),
        null.alias("meta_description"),
        null.alias("h1"),
        F.array().cast("array<string>").alias("h2s"),
        F.lit(False).alias("noindex"),
        F.lit(False).alias("nofollow"),
        null.alias("http_status"),
        null.alias("response_time_ms"),
    ).cast(METADATA)


def manifest_files(files: DataFrame) -> DataFrame:
    """Manifest files (name, content) with their entries and validity.

    One bad entry rejects its whole file; the check stays inside the row.
    """
    entries = F.when(F.col("content").rlike(r"\A\s*\["), F.from_json("content", _ENTRIES))
    valid = F.forall(
        "entries",
        lambda e: F.coalesce(
            urls.is_url(e["url"]) & (F.length(e["title"]) >= 1) & (F.length(e["body"]) >= 1),
            F.lit(False),
        ),
    )
    return files.withColumn("entries", entries).select(
        "name",
        "entries",
        F.when(F.col("entries").isNull(), F.concat(F.lit('File "'), "name", F.lit('" is not valid JSON — skipped')))
        .when(~valid, F.concat(F.lit('File "'), "name", F.lit('" failed schema validation — skipped')))
        .alias("warning"),
    )


def scan_json_manifest(files: DataFrame) -> DataFrame:
    """Articles of the valid manifests; links are not extracted."""
    good = manifest_files(files).filter(F.col("warning").isNull())
    return good.select("name", F.posexplode("entries").alias("seq", "e")).select(
        "name",
        "seq",
        F.col("e.url").alias("url"),
        F.col("e.title").alias("title"),
        F.col("e.body").alias("body"),
        F.array().cast(T.ArrayType(LINK)).alias("existing_links"),
        _no_metadata(F.col("e.title")).alias("metadata"),
        F.lit(None).cast("int").alias("http_status"),
        tx.word_count_untrimmed(F.col("e.body")).alias("word_count"),
        F.lit(None).cast("string").alias("parse_warning"),
    )


def push_errors(feed: DataFrame) -> DataFrame:
    """Adds ``errors`` to pushed rows (url, title, body, format)."""
    checks = {
        "url": urls.is_url(F.col("url")),
        "title": F.length("title") >= 1,
        "body": F.length("body") >= 1,
        "format": F.col("format").isin(*PUSH_FORMATS),
    }
    none = F.lit(None).cast("string")
    return feed.withColumn(
        "errors",
        F.array_compact(
            F.array(
                *[
                    F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(none)
                    for name, ok in checks.items()
                ]
            )
        ),
    )


def scan_push_feed(feed: DataFrame, bare_references: bool = True) -> DataFrame:
    """Valid pushed articles parsed by their format; the caller's title wins."""
    good = push_errors(feed).filter(F.size("errors") == 0).drop("errors")
    named = good.withColumnRenamed("title", "_title").withColumnRenamed("body", "html")
    parsed = parse_pages(named, bare_references)
    return parsed.withColumn("title", F.col("_title")).drop("_title")
