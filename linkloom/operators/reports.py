"""Counts, quotas and look-ups over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import review

# --- fixed values -----------------------------------------------------------
UNLIMITED_PLANS = ("pro", "enterprise")
# ----------------------------------------------------------------------------


def recs_with_articles(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Titles and URLs of both ends; an absent article reads as empty text."""
    about = articles.select("article_id", "title", "url")

    def side(name: str) -> DataFrame:
        return about.select(
            F.col("article_id").alias(f"{name}_id"),
            F.col("title").alias(f"{name}_title"),
            F.col("url").alias(f"{name}_url"),
        )

    filled = [f"{n}_{c}" for n in ("source", "target") for c in ("title", "url")]
    return (
        recs.join(side("source"), "source_id", "left")
        .join(side("target"), "target_id", "left")
        .select(*recs.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in filled])
    )


def run_summary(recs: DataFrame) -> DataFrame:
    """Per run the total and the counts by severity and by status."""

    def n(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value).alias(value)

    return recs.groupBy("run_id").agg(
        F.count("*").alias("total"),
        *[n("severity", s) for s in ("critical", "warning", "info")],
        *[n("status", s) for s in ("pending", "accepted", "dismissed", "superseded")],
    )


def run_counters(runs: DataFrame, articles: DataFrame, recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Runs with their article, recommendation and embedding counts filled in.

    ``vectors``: project_id, cached. Completion counts only for a running run.
    """
    per_project = articles.groupBy("project_id").agg(F.count("*").alias("_articles"))
    per_run = recs.groupBy("run_id").agg(F.count("*").alias("_recs"))
    cache = vectors.groupBy("project_id").agg(
        F.count_if("cached").alias("_cached"), F.count_if(~F.col("cached")).alias("_generated")
    )
    running = F.col("status") == "running"
    joined = (
        runs.join(per_project, "project_id", "left")
        .join(per_run, "run_id", "left")
        .join(cache, "project_id", "left")
    )

    def fill(count: str, column: str) -> Column:
        return F.when(running, F.coalesce(F.col(count), F.lit(0))).otherwise(F.col(column))

    return joined.withColumns(
        {
            "article_count": fill("_articles", "article_count"),
            "recommendation_count": fill("_recs", "recommendation_count"),
            "embeddings_cached": fill("_cached", "embeddings_cached"),
            "embeddings_generated": fill("_generated", "embeddings_generated"),
        }
    ).select(runs.columns)


def owner_plan(runs: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Runs with the plan of their project's owner."""
    owners = projects.select("project_id", "user_id").join(
        users.select("user_id", "plan", "run_limit"), "user_id"
    )
    return runs.join(owners, "project_id")


def monthly_run_quota(
    runs: DataFrame, projects: DataFrame, users: DataFrame, now: Column
) -> DataFrame:
    """Per project: runs this calendar month, limit, and what the plan allows."""
    used = (
        runs.filter(F.col("created_at") >= F.date_trunc("month", now))
        .groupBy("project_id")
        .agg(F.count("*").alias("used"))
    )
    unlimited = F.coalesce(F.col("plan").isin(*UNLIMITED_PLANS), F.lit(False))
    known = F.col("plan").isNotNull()
    return (
        projects.join(users, "user_id", "left")
        .join(used, "project_id", "left")
        .select(
            "project_id",
            F.coalesce("used", F.lit(0)).alias("used"),
            F.when(~unlimited, F.col("run_limit")).alias("run_limit"),
            (unlimited | (known & (F.coalesce("used", F.lit(0)) < F.col("run_limit")))).alias(
                "analyze_allowed"
            ),
            unlimited.alias("semantic_allowed"),
            unlimited.alias("api_allowed"),
        )
    )


def embedding_estimate(split: DataFrame) -> DataFrame:
    """Per project: vectors at hand, vectors to compute, and their cost in USD."""
    return (
        split.groupBy("project_id")
        .agg(
            F.count_if("cached").alias("cached"),
            F.count_if(~F.col("cached")).alias("needs_generation"),
        )
        .withColumn("estimated_cost", scoring.embedding_cost(F.col("needs_generation")))
    )


def article_count(articles: DataFrame) -> DataFrame:
    return articles.groupBy("project_id").agg(F.count("*").alias("articles"))


def export_count(recs: DataFrame, **filters) -> DataFrame:
    """How many rows an export with these filters (see ``rec_filter``) has: one row."""
    return review.rec_filter(recs, **filters).agg(F.count("*").alias("rows"))
