"""Canonical schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

LINK = T.StructType(
    [T.StructField("href", T.StringType()), T.StructField("anchor_text", T.StringType())]
)

METADATA = T.StructType(
    [
        T.StructField("canonical", T.StringType()),
        T.StructField("meta_title", T.StringType()),
        T.StructField("meta_description", T.StringType()),
        T.StructField("h1", T.StringType()),
        T.StructField("h2s", T.ArrayType(T.StringType())),
        T.StructField("noindex", T.BooleanType()),
        T.StructField("nofollow", T.BooleanType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("response_time_ms", T.IntegerType()),
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("article_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_hash", T.StringType()),
        T.StructField("title_hash", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("source_type", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("existing_links", T.ArrayType(LINK)),
        T.StructField("parse_warning", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SUGGESTION = T.StructType(
    [T.StructField("anchor_text", T.StringType()), T.StructField("target_url", T.StringType())]
)

# What a strategy returns: one row per proposed link.
PROPOSALS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("strategy_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("anchor_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("matching_approach", T.StringType()),
        T.StructField("source_context", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("suggestion", SUGGESTION),
        T.StructField("ord", T.LongType()),
    ]
)

# A stored recommendation: a proposal plus its run and its review state.
RECS = T.StructType(
    [T.StructField("rec_id", T.StringType()), T.StructField("run_id", T.StringType())]
    + PROPOSALS.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("dismiss_reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("strategies_used", T.ArrayType(T.StringType())),
        T.StructField("configuration", T.StringType()),
        T.StructField("article_count", T.LongType()),
        T.StructField("recommendation_count", T.LongType()),
        T.StructField("embeddings_cached", T.LongType()),
        T.StructField("embeddings_generated", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("last_heartbeat_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("response_time_ms", T.IntegerType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("retry_after", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_urls", T.LongType()),
        T.StructField("completed_urls", T.LongType()),
        T.StructField("failed_urls", T.LongType()),
        T.StructField("preset", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)


def conform(df, schema: T.StructType):
    """Select the columns of ``schema`` in order, casting; absent ones are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
