"""The work ledger: task, job and run state as conditional projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.functions import urls
from linkloom.schemas import JOBS, TASKS, conform

# --- fixed values -----------------------------------------------------------
ZOMBIE_MESSAGE = "Zombie recovery: processing timeout exceeded"
TIMEOUT_MESSAGE = "Analysis timed out. Please try again."
# ----------------------------------------------------------------------------


def _ago(now: Column, minutes: int) -> Column:
    return now - F.expr(f"INTERVAL {minutes} MINUTES")


def distinct_urls(found: DataFrame) -> DataFrame:
    """URLs of a job, normalised and de-duplicated: its tasks."""
    keys = [c for c in ("project_id", "job_id") if c in found.columns]
    return found.select(*keys, urls.normalize_crawl_url(F.col("url")).alias("url")).distinct()


def create_jobs(
    found: DataFrame, batch: str, preset: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """One pending job for each project of ``found`` (project_id, url), and one
    pending task for each of its normalised URLs. Ids follow from project,
    ``batch`` and URL, so building them again gives the same rows."""
    tasks = distinct_urls(found.select("project_id", "url").filter(F.col("url").isNotNull()))
    job_id = F.sha2(F.concat_ws("\n", "project_id", F.lit(batch)), 256)
    tasks = tasks.withColumn("job_id", job_id)
    jobs = tasks.groupBy("project_id", "job_id").agg(F.count("*").alias("total_urls"))
    jobs = jobs.withColumns(
        {
            "status": F.lit("pending"),
            "completed_urls": F.lit(0),
            "failed_urls": F.lit(0),
            "preset": F.lit(preset),
            "created_at": now,
        }
    )
    tasks = tasks.withColumns(
        {
            "task_id": F.sha2(F.concat_ws("\n", "job_id", "url"), 256),
            "status": F.lit("pending"),
            "retry_count": F.lit(0),
        }
    )
    return conform(jobs, JOBS), conform(tasks, TASKS)


def fail_transition(tasks: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Tasks after failures (task_id, error_message, is_transient).

    A transient failure with retries left goes back to pending with a growing
    delay; anything else is final. ``newly_failed`` marks rows to add to the
    job's failed count.
    """
    hits = failures.select(
        "task_id", F.struct("error_message", "is_transient").alias("_f")
    )
    failed = F.col("_f").isNotNull()
    retry = failed & F.col("_f.is_transient") & (F.col("retry_count") < scoring.MAX_RETRIES)
    final = failed & ~F.coalesce(retry, F.lit(False))
    again = F.col("retry_count") + 1

    def pick(name: str, on_retry: Column, on_final: Column) -> Column:
        kind = tasks.schema[name].dataType
        return F.when(retry, on_retry.cast(kind)).when(final, on_final.cast(kind)).otherwise(
            F.col(name)
        )

    none = F.lit(None)
    return (
        tasks.join(hits, "task_id", "left")
        .withColumns(
            {
                "status": pick("status", F.lit("pending"), F.lit("failed")),
                "retry_after": pick(
                    "retry_after", scoring.backoff(now, again), F.col("retry_after")
                ),
                "error_message": F.when(failed, F.col("_f.error_message")).otherwise(
                    F.col("error_message")
                ),
                "started_at": pick("started_at", none, F.col("started_at")),
                "processed_at": pick("processed_at", F.col("processed_at"), now),
                "retry_count": pick("retry_count", again, F.col("retry_count")),
                "newly_failed": final,
            }
        )
        .select(*tasks.columns, "newly_failed")
    )


def stale_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks processing for over ten minutes are retried or given up."""
    stale = (F.col("status") == "processing") & (
        F.col("started_at") < _ago(now, scoring.STALE_MINUTES)
    )
    marked = tasks.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    again = F.col("_stale") & (F.col("retry_count") < scoring.MAX_RETRIES)
    final = F.col("_stale") & (F.col("retry_count") >= scoring.MAX_RETRIES)
    return marked.withColumns(
        {
            "status": F.when(again, "pending").when(final, "failed").otherwise(F.col("status")),
            "started_at": F.when(~again, F.col("started_at")),
            "retry_after": F.when(~again, F.col("retry_after")),
            "processed_at": F.when(final, now).otherwise(F.col("processed_at")),
            "error_message": F.when(final, ZOMBIE_MESSAGE).otherwise(F.col("error_message")),
            "newly_failed": final,
        }
    ).drop("_stale")


def failed_increment(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add tasks with ``newly_failed`` to their job's failed count."""
    more = tasks.filter("newly_failed").groupBy("job_id").agg(F.count("*").alias("_more"))
    return (
        jobs.join(more, "job_id", "left")
        .withColumn("failed_urls", F.col("failed_urls") + F.coalesce("_more", F.lit(0)))
        .select(jobs.columns)
    )


def job_rollup(jobs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Finish the jobs that have no pending or processing task left."""
    open_tasks = tasks.filter(F.col("status").isin("pending", "processing"))
    active = open_tasks.groupBy("job_id").agg(F.count("*").alias("_open"))
    done = F.col("_open").isNull()
    result = F.when((F.col("completed_urls") == 0) & (F.col("failed_urls") > 0), "failed").otherwise(
        "completed"
    )
    return (
        jobs.join(active, "job_id", "left")
        .withColumns(
            {
                "status": F.when(done, result).otherwise(F.col("status")),
                "completed_at": F.when(done, now).otherwise(F.col("completed_at")),
            }
        )
        .select(jobs.columns)
    )


def stale_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Running runs without a sign of life for ten minutes time out."""
    limit = _ago(now, scoring.STALE_MINUTES)
    dead = (F.col("status") == "running") & (
        (F.col("last_heartbeat_at") < limit)
        | (F.col("last_heartbeat_at").isNull() & (F.col("started_at") < limit))
    )
    dead = F.coalesce(dead, F.lit(False))
    return runs.withColumns(
        {
            "error": F.when(dead, TIMEOUT_MESSAGE).otherwise(F.col("error")),
            "completed_at": F.when(dead, now).otherwise(F.col("completed_at")),
            "status": F.when(dead, "failed").otherwise(F.col("status")),
        }
    )


def stuck_jobs(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Jobs and runs in state running for over fifteen minutes."""
    limit = _ago(now, scoring.STUCK_MINUTES)
    stuck_ingest = jobs.filter((F.col("status") == "running") & (F.col("created_at") < limit))
    stuck_runs = runs.filter((F.col("status") == "running") & (F.col("started_at") < limit))
    return stuck_ingest.select(
        F.col("job_id").alias("id"),
        F.lit("ingestion_job").alias("type"),
        F.col("created_at").alias("started_at"),
    ).unionByName(
        stuck_runs.select(
            F.col("run_id").alias("id"), F.lit("analysis_run").alias("type"), "started_at"
        )
    )


def health_status(stuck: DataFrame) -> DataFrame:
    return stuck.agg(
        F.when(F.count("*") > 0, "warning").otherwise("ok").alias("status"),
        F.count("*").alias("stuck"),
    )


def expire_rows(df: DataFrame, ts_col: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of the rows dropped)."""
    gone = F.coalesce(F.col(ts_col) < now, F.lit(False))
    return df.filter(~gone), df.agg(F.count_if(gone).alias("deleted"))


def ledger_fold(log: DataFrame) -> DataFrame:
    """Current state per task: its latest transition (ts, then seq).

    ``max_by`` pre-aggregates in each task, so a task with very many
    transitions costs one row per input partition.
    """
    return log.groupBy("task_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("ts"),
        F.count("*").alias("transitions"),
    )


def late_update_rule(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Completions (task_id, status, ts) count only while the task is processing."""
    new = updates.groupBy("task_id").agg(F.min(F.struct("ts", "status")).alias("_u"))
    hit = (F.col("status") == "processing") & F.col("_u").isNotNull()
    return (
        tasks.join(new, "task_id", "left")
        .withColumns(
            {
                "processed_at": F.when(hit, F.col("_u.ts")).otherwise(F.col("processed_at")),
                "status": F.when(hit, F.col("_u.status")).otherwise(F.col("status")),
            }
        )
        .select(tasks.columns)
    )
