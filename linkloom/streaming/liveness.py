"""Silence detection and running counts over event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators import ledger

# --- fixed values -----------------------------------------------------------
SILENCE_MS = 10 * 60 * 1000
STATE_GROUPS = 1024
# ----------------------------------------------------------------------------


def liveness_stream(
    heartbeats: DataFrame, lateness: str = "10 minutes", groups: int = STATE_GROUPS
) -> DataFrame:
    """Runs (run_id, ts) silent for ten minutes of event time: run_id,
    last_seen, status ``timed_out``. A later heartbeat starts a new watch.

    Silence is known only once the watermark has passed it: heartbeats more than
    ``lateness`` behind the newest one don't count. A state holds the runs of one of
    ``groups`` hash groups, so Python is called once a group; the number is fixed
    for a checkpoint.
    """
    kind = heartbeats.schema["run_id"].dataType.simpleString()

    def watch(key, frames, state):
        seen = dict(zip(*state.get)) if state.exists else {}
        beating = set()
        if not state.hasTimedOut:
            for frame in frames:
                newest = frame.groupby("run_id", dropna=False)["ts"].max()
                at = newest.astype("datetime64[ns]").astype("int64") // 1_000_000
                for run, last in zip(newest.index, at.tolist()):
                    run = None if pd.isna(run) else run
                    seen[run] = max(seen.get(run, 0), last)
                    beating.add(run)
        now = state.getCurrentWatermarkMs()
        silent = [r for r, last in seen.items() if r not in beating and last + SILENCE_MS < now]
        if silent:
            yield pd.DataFrame(
                {
                    "run_id": silent,
                    "last_seen_ms": [seen.pop(r) for r in silent],
                    "status": "timed_out",
                }
            )
        if seen:
            state.update((list(seen), list(seen.values())))
            state.setTimeoutTimestamp(max(min(seen.values()) + SILENCE_MS, now + 1))
        elif state.exists:
            state.remove()

    # Runs as text: a column of numbers with a null would be read as doubles.
    timed = heartbeats.select(
        F.col("run_id").cast("string").alias("run_id"),
        "ts",
        F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("_group"),
    ).withWatermark("ts", lateness)
    found = timed.groupBy("_group").applyInPandasWithState(
        watch,
        "run_id string, last_seen_ms bigint, status string",
        "runs array<string>, last array<bigint>",
        "append",
        "EventTimeTimeout",
    )
    return found.withColumn("run_id", F.col("run_id").cast(kind))


def quota_stream(runs: DataFrame, lateness: str | None = None) -> DataFrame:
    """Runs per project and calendar month, updated as they arrive.

    Every run counts, however late. With ``lateness`` months leave the state
    once the watermark has passed them by that delay, and later runs are dropped.
    """
    timed = runs if lateness is None else runs.withWatermark("created_at", lateness)
    return (
        timed.groupBy("project_id", F.date_trunc("month", "created_at").alias("month"))
        .agg(F.count("*").alias("used"))
    )


def fold_stream(log: DataFrame) -> DataFrame:
    """Current state per task from a stream of transitions (update mode)."""
    return ledger.ledger_fold(log)


def fresh_updates(updates: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Updates without the replays seen within the watermark delay ``lateness``."""
    return updates.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(
        ["task_id", "status"]
    )


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Each micro-batch in a folder of its own, so that replays replace it."""

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
