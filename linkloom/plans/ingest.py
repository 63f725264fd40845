"""From a crawl log to the next article and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import articles as art
from linkloom.operators import ledger
from linkloom.sources import network
from linkloom.sources.pages import normalize_articles, parse_pages


def screen(
    pages: DataFrame,
    dns: DataFrame | None = None,
    rules: DataFrame | None = None,
    agent: str = "*",
) -> DataFrame:
    """Adds ``refused``: why a page must not be taken (unsafe, robots), or null."""
    refused = F.lit(None).cast("string")
    if dns is not None:
        pages = network.url_safety(pages, dns)
        refused = F.when(~F.col("safe"), F.concat(F.lit("ssrf: "), F.col("reason")))
    if rules is not None:
        pages = network.robots_allowed(pages, rules, agent)
        refused = F.coalesce(refused, F.when(~F.col("allowed"), F.lit("robots: disallowed")))
    return pages.withColumn("refused", refused).drop(
        "safe", "reason", "resolved_ip", "allowed", "crawl_delay"
    )


def articles_from(
    pages: DataFrame, project: Column, source_type: str = "crawl", bare_references: bool = True
) -> DataFrame:
    return normalize_articles(parse_pages(pages, bare_references), project, source_type)


def ingest(
    log: DataFrame,
    tasks: DataFrame,
    jobs: DataFrame,
    current: DataFrame,
    project: Column,
    now: Column,
    dns: DataFrame | None = None,
    rules: DataFrame | None = None,
    agent: str = "*",
    bare_references: bool = True,
) -> dict[str, DataFrame]:
    """Crawl results (task_id, url, html, http_status, response_time_ms, error)
    applied to tasks, jobs and articles.

    A page with an error and no content fails its task, with a retry when the
    error is transient. Any HTTP answer with content is stored, whatever its
    status.
    """
    seen = screen(log, dns, rules, agent)
    no_page = F.coalesce(F.col("error").isNotNull() & (F.coalesce("html", F.lit("")) == ""), F.lit(False))
    failed = seen.filter(no_page | F.col("refused").isNotNull()).select(
        "task_id",
        F.coalesce("refused", "error").alias("error_message"),
        (
            F.col("refused").isNull()
            & (scoring.http_failure_class(F.col("http_status"), F.col("error")) == "transient")
        ).alias("is_transient"),
    )
    good = seen.filter(~no_page & F.col("refused").isNull())
    fresh = articles_from(
        good.select("url", "html", "http_status", "response_time_ms"), project,
        bare_references=bare_references,
    )
    done = good.select(
        "task_id", F.struct("http_status", "response_time_ms").alias("_done")
    )
    hit = F.col("_done").isNotNull()
    completed = (
        tasks.join(done, "task_id", "left")
        .withColumns(
            {
                "status": F.when(hit, "completed").otherwise(F.col("status")),
                "http_status": F.coalesce("_done.http_status", "http_status"),
                "response_time_ms": F.coalesce("_done.response_time_ms", "response_time_ms"),
                "processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
            }
        )
        .select(*tasks.columns, hit.alias("_newly_done"))
    )
    after = ledger.fail_transition(completed, failed, now)
    finished = after.filter("_newly_done").groupBy("job_id").agg(F.count("*").alias("_n"))
    counted = (
        ledger.failed_increment(jobs, after)
        .join(finished, "job_id", "left")
        .withColumn("completed_urls", F.col("completed_urls") + F.coalesce("_n", F.lit(0)))
        .select(jobs.columns)
    )
    return {
        "articles": art.upsert_articles(current, fresh, "crawl", now),
        "tasks": after.select(tasks.columns),
        "jobs": ledger.job_rollup(counted, after, now),
    }
