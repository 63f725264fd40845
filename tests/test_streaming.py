import datetime as dt
import random

from pyspark.sql import functions as F

from linkloom.session import work_path
from linkloom.streaming import ingest, liveness, rate_limit

T0 = dt.datetime(2024, 1, 1, 0, 59, 50)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def expected(rows, limits):
    state, out = {}, {}
    for rid, user, endpoint, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        cap, rate = limits.get(endpoint, limits["default"])
        tokens, last = state.get((user, endpoint), (cap, ts))
        tokens, ok, left, wait = rate_limit.consume(tokens, (ts - last).total_seconds(), cap, rate)
        state[(user, endpoint)] = (tokens, ts)
        out[rid] = (ok, left, wait)
    return out


SCHEMA = "request_id int, user_id string, endpoint string, ts timestamp"


def test_bucket_refills_after_six_seconds(spark):
    rows = [(k, "u", "POST:/api/articles", at(0)) for k in range(11)] + [(11, "u", "POST:/api/articles", at(6.1))]
    got = {r.request_id: r for r in rate_limit.rate_limit_batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k].allowed for k in range(12)] == [True] * 10 + [False, True]
    assert got[0].remaining == 9 and got[10].retry_after == 6
    assert {r.limit for r in got.values()} == {10}


def test_batch_against_plain_loop(spark):
    rng, limits = random.Random(5), {"a": (3.0, 1 / 600), "default": (2.0, 1 / 900)}
    # One user makes most requests; gaps from seconds to many hours.
    rows, clock = [], {}
    for k in range(400):
        user = rng.choice(["hot", "hot", "hot", "u1", "u2"])
        clock[user] = clock.get(user, 0) + rng.choice([1, 40, 500, 700, 3000, 20000])
        rows.append((k, user, rng.choice("ab"), at(clock[user])))
    got = rate_limit.rate_limit_batch(spark.createDataFrame(rows, SCHEMA), limits).collect()
    assert {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in got} == expected(rows, limits)


def _pages(spark, folder, name, rows):
    spark.createDataFrame(rows, "url string, html string").coalesce(1).write.mode("append").parquet(folder)


def test_incremental_ingest(spark):
    folder, path, checkpoint = (work_path(spark, n) for n in ("in", "log", "cp"))

    def step(policy):
        stream = spark.readStream.schema("url string, html string").parquet(folder)
        ingest.incremental_ingest(stream, path, checkpoint, F.lit("p"), policy).awaitTermination()
        return {r.url[-1]: r.title for r in ingest.current_articles(spark, path).collect()}

    page = "<title>{}</title><body>{}".format
    _pages(spark, folder, "1", [("https://e.com/a", page("A", "x")), ("https://e.com/b", page("B", "x"))])
    assert step("upload") == {"a": "A", "b": "B"}
    _pages(spark, folder, "2", [("https://e.com/a", page("A2", "x")), ("https://e.com/b", page("B2", "y"))])
    # Same body: skipped. New body: replaced.
    assert step("upload") == {"a": "A", "b": "B2"}
    batch = spark.read.parquet(f"{path}/batch=1")
    assert batch.count() == 1
    # A replay of the batch leaves the table as it was.
    ingest.append_batch(batch, 1, path, "upload")
    assert {r.url[-1]: r.title for r in ingest.current_articles(spark, path).collect()} == {"a": "A", "b": "B2"}


def test_streams(spark):
    source = work_path(spark, "beats")
    rows = [("quiet", at(0)), ("alive", at(0)), ("alive", at(3500)), ("late", at(4000))]
    spark.createDataFrame(rows, "run_id string, ts timestamp").coalesce(1).write.parquet(source)

    def drain(stream, mode):
        out = work_path(spark, "out")
        liveness.write_batches(stream, out, work_path(spark, "cp"), mode).awaitTermination()
        return spark.read.parquet(out)

    beats = spark.readStream.schema("run_id string, ts timestamp").parquet(source)
    assert {r.run_id for r in drain(liveness.liveness_stream(beats), "append").collect()} == {"quiet"}
    runs = beats.select(F.col("run_id").alias("project_id"), F.col("ts").alias("created_at"))
    counts = drain(liveness.quota_stream(runs), "update")
    assert {r.project_id: r.used for r in counts.collect()} == {"quiet": 1, "alive": 2, "late": 1}
    updates = beats.select(F.lit("t").alias("task_id"), F.lit("done").alias("status"), "ts")
    assert drain(liveness.fresh_updates(updates), "append").count() == 1


def test_rate_limit_order_over_arrow_batches(spark):
    """Ten thousand requests of one user in disorder, in Arrow batches of 50."""
    rng = random.Random(9)
    rows = [(k, "u", "x", at(rng.randrange(200_000) / 10)) for k in range(10_000)]
    folder = work_path(spark, "requests")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        stream = rate_limit.rate_limit_stream(spark.readStream.schema(SCHEMA).parquet(folder))
        out = work_path(spark, "answers")
        liveness.write_batches(stream, out, work_path(spark, "cp")).awaitTermination()
        got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(out).collect()}
        assert {r.limit for r in spark.read.parquet(out).collect()} == {60}
    finally:
        spark.conf.set(key, before)
    assert got == expected(rows, rate_limit.LIMITS)


def test_late_rows_are_answered_and_counted(spark):
    folder, out, checkpoint = (work_path(spark, n) for n in ("late", "late-out", "late-cp"))
    counted, counted_cp = work_path(spark, "late-quota"), work_path(spark, "late-quota-cp")
    for name, rows in enumerate(([(1, at(18_000))], [(2, at(0)), (3, at(18_001))])):
        full = [(k, "u", "x", ts) for k, ts in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        liveness.write_batches(rate_limit.rate_limit_stream(stream), out, checkpoint).awaitTermination()
        runs = stream.select(F.col("user_id").alias("project_id"), F.col("ts").alias("created_at"))
        liveness.write_batches(liveness.quota_stream(runs), counted, counted_cp, "update").awaitTermination()
    answers = {r.request_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert answers == {1: True, 2: True, 3: True}
    assert max(r.used for r in spark.read.parquet(counted).collect()) == 3


def _append(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_many_keys_share_few_states(spark):
    """Python is called once a group of keys; buckets go on in the next micro-batch."""
    rng, limits = random.Random(3), {"default": (2.0, 1 / 900)}
    rows = [(k, f"u{k % 1500}", "x", at(k // 1500 * rng.choice([1, 700]) + k)) for k in range(4500)]
    for lateness in (None, "1 hour"):
        folder, out, checkpoint = (work_path(spark, n) for n in ("many", "many-out", "many-cp"))
        for part in (rows[:2500], rows[2500:]):
            _append(spark, folder, part, SCHEMA)
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            answers = rate_limit.rate_limit_stream(stream, limits, lateness)
            query = liveness.write_batches(answers, out, checkpoint)
            query.awaitTermination()
            states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            assert max(states) <= 1024  # not one for each of the 1,500 users
        got = {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(out).collect()}
        assert got == expected(rows, limits)


def test_runs_of_one_state_are_watched_apart(spark):
    folder, out, checkpoint = (work_path(spark, n) for n in ("runs", "runs-out", "runs-cp"))
    schema = "run_id long, ts timestamp"
    for part in ([(1, at(0)), (2, at(5)), (3, at(4000))], [(1, at(4100)), (4, at(9000))], [(4, at(9001))]):
        _append(spark, folder, part, schema)
        beats = spark.readStream.schema(schema).parquet(folder)
        liveness.write_batches(liveness.liveness_stream(beats, groups=1), out, checkpoint).awaitTermination()
    seen = sorted((r.run_id, r.last_seen_ms - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1000) for r in spark.read.parquet(out).collect())
    assert seen == [(1, 0), (1, 4_100_000), (2, 5_000), (3, 4_000_000)]
