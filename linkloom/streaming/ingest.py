"""Pages arriving as a stream, kept as an append-only article log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.articles import last_by_seq
from linkloom.operators.matching import limit_per_key
from linkloom.sources.pages import normalize_articles, parse_pages

KEY = ["project_id", "url"]


def current_articles(spark: SparkSession, path: str) -> DataFrame:
    """The article table: the latest version of every (project, url)."""
    return limit_per_key(spark.read.parquet(path), KEY, [F.desc("batch")], 1).drop("batch")


def append_batch(batch: DataFrame, batch_id: int, path: str, policy: str) -> None:
    """Append what changed in one micro-batch.

    Only keys and hashes of earlier batches are read, and only changed rows
    written. The folder is named by the batch, so a replay replaces it.
    """
    spark = batch.sparkSession
    incoming = last_by_seq(batch, KEY)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if exists and policy != "crawl":
        earlier = (
            spark.read.parquet(path)
            .filter(F.col("batch") < batch_id)
            .groupBy(*KEY)
            .agg(F.max_by(F.struct("body_hash", "title_hash"), "batch").alias("_old"))
        )
        same = F.col("_old.body_hash") == F.col("body_hash")
        if policy == "push":
            same = same & (F.col("_old.title_hash") == F.col("title_hash"))
        incoming = (
            incoming.join(earlier, KEY, "left")
            .filter(~F.coalesce(same, F.lit(False)))
            .drop("_old")
        )
    incoming.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def incremental_ingest(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    project: Column,
    policy: str = "crawl",
    source_type: str = "crawl",
    trigger: dict | None = None,
    bare_references: bool = True,
) -> StreamingQuery:
    """Parse a stream of pages into the article log at ``path``."""
    parsed = normalize_articles(parse_pages(pages, bare_references), project, source_type)
    return (
        parsed.writeStream.foreachBatch(
            lambda df, batch_id: append_batch(df, batch_id, path, policy)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
