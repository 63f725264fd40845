"""Token buckets over request events: batch and streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# endpoint -> (capacity, tokens per second)
LIMITS = {
    "POST:/api/articles": (10.0, 10 / 60),
    "POST:/api/analyze": (20.0, 20 / 3600),
    "default": (60.0, 1.0),
}
IDLE_MS = 10 * 60 * 1000
STATE_GROUPS = 1024
# ----------------------------------------------------------------------------

_OUT = "allowed boolean, remaining int, retry_after int"


def _limit(limits: Mapping, endpoint: Column, part: int) -> Column:
    value = F.lit(float(limits["default"][part]))
    for name, pair in limits.items():
        if name != "default":
            value = F.when(endpoint == name, F.lit(float(pair[part]))).otherwise(value)
    return value


def _with_limit(answers: DataFrame, limits: Mapping) -> DataFrame:
    return answers.withColumn("limit", _limit(limits, F.col("endpoint"), 0).cast("int"))


def consume(tokens: float, elapsed: float, capacity: float, rate: float) -> tuple:
    """One request: (tokens left, allowed, remaining, retry_after)."""
    tokens = min(capacity, tokens + elapsed * rate)
    if tokens >= 1:
        tokens -= 1
        return tokens, True, math.floor(tokens), 0
    return tokens, False, 0, math.ceil((1 - tokens) / rate)


def _sessions(requests: DataFrame, limits: Mapping) -> DataFrame:
    """Adds ``_session``: a bucket idle long enough to fill up starts afresh,
    so a user's history falls into independent pieces.

    Gaps are found per (user, endpoint, hour) and joined up through an hourly
    summary, so that no window holds the whole history of a busy user.
    """
    key = ["user_id", "endpoint"]
    fill = _limit(limits, F.col("endpoint"), 0) / _limit(limits, F.col("endpoint"), 1)
    rows = requests.withColumns(
        {
            "_us": F.unix_micros("ts"),
            "_sec": F.unix_micros("ts") / F.lit(1e6),
            "_hour": F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)),
        }
    )
    inside = Window.partitionBy(*key, "_hour").orderBy("ts", "request_id")
    across = Window.partitionBy(*key).orderBy("_hour")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        rows.groupBy(*key, "_hour")
        .agg(F.max("_sec").alias("_last"))
        .withColumn("_previous", F.lag("_last").over(across))
        .select(*key, "_hour", "_previous")
    )
    flagged = rows.join(hours, [*key, "_hour"]).withColumn(
        "_gap", F.col("_sec") - F.coalesce(F.lag("_sec").over(inside), F.col("_previous"))
    )
    started = flagged.withColumn(
        "_start", F.when(F.col("_gap").isNull() | (F.col("_gap") >= fill), F.col("_sec"))
    )
    opened = (
        started.groupBy(*key, "_hour")
        .agg(F.max("_start").alias("_opened"))
        .withColumn("_carried", F.max("_opened").over(before))
        .select(*key, "_hour", "_carried")
    )
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        started.join(opened, [*key, "_hour"])
        .withColumn("_session", F.coalesce(F.max("_start").over(running), F.col("_carried")))
        .drop("_hour", "_previous", "_gap", "_start", "_carried")
    )


def rate_limit_batch(requests: DataFrame, limits: Mapping = LIMITS) -> DataFrame:
    """Requests (request_id, user_id, endpoint, ts) with allowed, remaining,
    retry_after (seconds) and limit (the endpoint's capacity).

    Rows are shuffled by independent session, sorted on disk and streamed
    through one bucket at a time: memory does not grow with a user's traffic.
    """
    ready = _sessions(requests, limits).withColumns(
        {
            "_capacity": _limit(limits, F.col("endpoint"), 0),
            "_rate": _limit(limits, F.col("endpoint"), 1),
        }
    )
    order = ["user_id", "endpoint", "_session", "ts", "request_id"]
    ordered = ready.repartition("user_id", "endpoint", "_session").sortWithinPartitions(*order)
    keep = requests.columns
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields] + [_OUT]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tokens, last = None, 0.0, 0
        for batch in batches:
            table = {n: batch.column(n).to_pylist() for n in (
                "user_id", "endpoint", "_session", "_us", "_capacity", "_rate"
            )}
            allowed, remaining, retry = [], [], []
            for user, endpoint, session, us, capacity, rate in zip(*table.values()):
                if bucket != (user, endpoint, session):
                    bucket, tokens, last = (user, endpoint, session), capacity, us
                tokens, ok, left, wait = consume(tokens, (us - last) / 1e6, capacity, rate)
                last = us
                allowed.append(ok)
                remaining.append(left)
                retry.append(wait)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep]
                + [pa.array(allowed), pa.array(remaining, pa.int32()), pa.array(retry, pa.int32())],
                names=[*keep, "allowed", "remaining", "retry_after"],
            )

    return _with_limit(ordered.mapInArrow(run, schema), limits)


def rate_limit_stream(
    requests: DataFrame,
    limits: Mapping = LIMITS,
    lateness: str | None = None,
    groups: int = STATE_GROUPS,
) -> DataFrame:
    """The same over a stream, with the buckets as keyed state.

    A state holds the buckets of the keys (user, endpoint) of one of ``groups`` hash
    groups, so Python is called once a group, not once a key. More groups rewrite less
    state for a small micro-batch; the number is fixed for a checkpoint.

    All requests of a group in one micro-batch are taken in time order (the
    source's rate limits bound that list); one that is late for an earlier
    micro-batch finds the clock where it is. Every request is answered, and
    buckets stay. With ``lateness`` (a watermark delay) idle buckets leave the
    state, and requests later than that are dropped unanswered.
    """
    if not requests.isStreaming:
        return rate_limit_batch(requests, limits)
    table = {k: (float(v[0]), float(v[1])) for k, v in limits.items()}
    idle = {k: max(IDLE_MS, int(1000 * c / r)) for k, (c, r) in table.items()}

    def due(key, last):
        return int(last / 1000) + idle.get(key[1], idle["default"])

    def update(key, frames, state):
        buckets, asked = {}, set()
        if state.exists:
            users, endpoints, tokens, last = state.get
            buckets = dict(zip(zip(users, endpoints), zip(tokens, last)))
        if not state.hasTimedOut:
            # A group's rows come in several Arrow batches; order holds over all of them.
            frame = pd.concat([f[["request_id", "user_id", "endpoint", "ts"]] for f in frames])
            frame = frame.sort_values(["ts", "request_id"], kind="stable").reset_index(drop=True)
            # Microseconds: exact in the state's doubles, as their differences are.
            clock = frame["ts"].astype("datetime64[us]").astype(np.int64).astype(float)
            out = []
            for user, endpoint, us in zip(frame["user_id"], frame["endpoint"], clock):
                bucket = (user, endpoint)
                capacity, rate = table.get(endpoint, table["default"])
                tokens, last = buckets.get(bucket, (capacity, us))
                tokens, ok, left, wait = consume(
                    tokens, max(us - last, 0.0) / 1e6, capacity, rate
                )
                buckets[bucket] = (tokens, max(last, us))
                asked.add(bucket)
                out.append((ok, left, wait))
            frame[["allowed", "remaining", "retry_after"]] = pd.DataFrame(out)
            yield frame
        if lateness is not None:
            now = state.getCurrentWatermarkMs()
            buckets = {k: v for k, v in buckets.items() if k in asked or due(k, v[1]) >= now}
            if not buckets:
                if state.exists:
                    state.remove()
                return
        users, endpoints = zip(*buckets)
        tokens, last = zip(*buckets.values())
        state.update((list(users), list(endpoints), list(tokens), list(last)))
        if lateness is not None:
            first = min(due(k, v[1]) for k, v in buckets.items())
            state.setTimeoutTimestamp(max(first, now + 1))

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    names = ("request_id", "user_id", "endpoint", "ts")
    timed = requests if lateness is None else requests.withWatermark("ts", lateness)
    # Users as text: a column of numbers with a null would be read as doubles.
    keyed = timed.select(
        "request_id",
        F.col("user_id").cast("string").alias("user_id"),
        "endpoint",
        "ts",
        F.pmod(F.xxhash64("user_id", "endpoint"), F.lit(groups)).alias("_group"),
    )
    schema = ", ".join(f"{n} {'string' if n == 'user_id' else kinds[n]}" for n in names)
    answers = keyed.groupBy("_group").applyInPandasWithState(
        update,
        f"{schema}, {_OUT}",
        "users array<string>, endpoints array<string>, tokens array<double>, last array<double>",
        "append",
        "NoTimeout" if lateness is None else "EventTimeTimeout",
    )
    typed = answers.withColumn("user_id", F.col("user_id").cast(kinds["user_id"]))
    return _with_limit(typed, limits)
