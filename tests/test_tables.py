"""Article, recommendation and ledger tables on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import content_hash
from linkloom.operators import articles as art
from linkloom.operators import export, ledger, rank, reports, review
from linkloom.plans import crosslink as cl
from linkloom.plans import inputs as i
from linkloom.plans.analyze import analyze, analyze_all
from linkloom.plans.crosslink import default_registry
from linkloom.plans.ingest import ingest
from linkloom.schemas import ARTICLES, JOBS, PROPOSALS, RECS, RUNS, TASKS, conform

NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def ago(minutes):
    return NOW - dt.timedelta(minutes=minutes)


def frame(spark, schema, **columns):
    n = len(next(iter(columns.values())))
    fields = {f.name: f for f in schema.fields}
    rows = [tuple(columns.get(name, [None] * n)[k] for name in fields) for k in range(n)]
    return spark.createDataFrame(rows, schema)


def recs(spark, rows):
    """rows: (id, source, target, severity, confidence, approach[, status, run])."""
    return frame(
        spark, RECS,
        rec_id=[r[0] for r in rows], source_id=[r[1] for r in rows], target_id=[r[2] for r in rows],
        severity=[r[3] for r in rows], confidence=[r[4] for r in rows], matching_approach=[r[5] for r in rows],
        status=[(r[6] if len(r) > 6 else "pending") for r in rows], run_id=[(r[7] if len(r) > 7 else "r") for r in rows],
        project_id=["p"] * len(rows), strategy_id=["crosslink"] * len(rows), ord=list(range(len(rows))),
        updated_at=[NOW] * len(rows), created_at=[NOW] * len(rows),
    )


# --- ranking -----------------------------------------------------------------------


def test_merge_and_rank(spark):
    df = recs(spark, [
        ("1", "a", "b", "warning", 0.7, "keyword"), ("2", "a", "b", "warning", 0.8, "semantic"),
        ("3", "a", "c", "critical", 0.5, "keyword"), ("4", "a", "d", "warning", 0.9, "keyword"),
        ("5", "a", "d", "critical", 0.2, "keyword"), ("6", "a", "e", "odd", 0.99, "keyword"),
        ("7", "a", "f", "warning", 0.95, "semantic"), ("8", "a", "f", "info", 0.9, "keyword"),
    ])
    got = [(r.rec_id, r.matching_approach, round(r.confidence, 4)) for r in rank.dedup_and_rank(df).collect()]
    assert got == [("5", "keyword", 0.9), ("3", "keyword", 0.5), ("7", "both", 1.0), ("1", "both", 0.95), ("6", "keyword", 0.99)]


def test_cap_and_export_order(spark):
    df = recs(spark, [(f"{k:02}", "a", f"t{k}", "warning", k / 100, "keyword") for k in range(20)])
    capped = rank.per_page_cap(df, 5).collect()
    assert sorted(r.confidence for r in capped) == [0.15, 0.16, 0.17, 0.18, 0.19]
    mixed = recs(spark, [("1", "a", "b", "odd", 0.9, "k"), ("2", "a", "c", "info", 0.95, "k"), ("3", "a", "d", "critical", 0.1, "k")])
    assert [r.rec_id for r in rank.export_order(mixed).collect()] == ["3", "2", "1"]


def test_pages_cover_everything_once(spark):
    rows = [(f"{k:02}", "a", f"t{k}", ("info", "critical")[k % 2], (k % 4) / 10, "keyword") for k in range(23)]
    df, seen, cursor = recs(spark, rows).cache(), [], None
    while True:
        page = rank.recs_page(df, 10, cursor).collect()
        weights = [{"critical": 0, "info": 2}[r.severity] for r in page]
        assert weights == sorted(weights)
        seen += [r.rec_id for r in page]
        if not page[0].has_more:
            break
        last = max(page, key=lambda r: r.position)
        cursor = (last.confidence, last.rec_id)
    assert sorted(seen) == [r[0] for r in rows] and len(seen) == 23
    with pytest.raises(ValueError):
        rank.recs_page(df, 101)


# --- articles ---------------------------------------------------------------------------


def _article(spark, rows):
    """rows: (url, title, body[, embedding])."""
    df = frame(
        spark, ARTICLES, url=[r[0] for r in rows], title=[r[1] for r in rows], body=[r[2] for r in rows],
        embedding=[[1.0] if len(r) > 3 else None for r in rows], embedding_model=["m" if len(r) > 3 else None for r in rows],
        project_id=["p"] * len(rows), article_id=["id-" + r[0] for r in rows], http_status=[200] * len(rows),
    )
    return df.withColumns({"body_hash": content_hash(F.col("body")), "title_hash": content_hash(F.col("title"))})


@pytest.mark.parametrize(
    "policy,want",
    [
        ("crawl", {"same": "updated", "title": "updated", "body": "updated"}),
        ("upload", {"same": "unchanged", "title": "unchanged", "body": "updated"}),
        ("push", {"same": "unchanged", "title": "updated", "body": "updated"}),
    ],
)
def test_upsert(spark, policy, want):
    current = _article(spark, [(u, "t", "b", 1) for u in ("same", "title", "body", "old")])
    incoming = _article(spark, [("same", "t", "b"), ("title", "t2", "b"), ("body", "t", "b2"), ("new", "t", "b"),
                                ("new", "t", "b-last")])
    incoming = incoming.withColumn("seq", F.when(F.col("body") == "b-last", 2).otherwise(1)).withColumn("http_status", F.lit(201))
    out = {r.url: r for r in art.upsert_articles(current, incoming, policy, now()).collect()}
    assert {u: out[u].action for u in out} == {**want, "new": "created", "old": "kept"}
    assert out["new"].body == "b-last" and out["new"].http_status == (None if policy == "push" else 201)
    assert out["body"].embedding is None and out["body"].body == "b2" and out["body"].article_id == "id-body"
    assert out["body"].http_status == (200 if policy == "push" else 201)
    assert out["old"].embedding == [1.0]
    # A second pass changes nothing more.
    again = art.upsert_articles(
        art.upsert_articles(current, incoming, policy, now()).drop("action"), incoming, policy, now()
    )
    assert {r.url: r.body for r in again.collect()} == {u: out[u].body for u in out}


def test_change_scope(spark):
    articles = spark.createDataFrame(
        [("new", "b", "t"), ("changed", "b", "t"), ("title", "b", "t"), ("same", "b", "t"), ("unknown", "b", "t")],
        "article_id string, body_hash string, title_hash string",
    )
    last = spark.createDataFrame(
        [("changed", "x", "t"), ("title", "b", "x"), ("same", "b", "t"), ("unknown", None, None)],
        "article_id string, body_hash string, title_hash string",
    )
    scope = art.change_scope(articles, last).cache()
    assert {r.article_id: r.change for r in scope.collect()} == {
        "new": "new", "changed": "changed", "title": "changed", "same": "unchanged", "unknown": "unchanged"}
    assert {r.article_id for r in art.union_scope(scope).collect()} == {"new", "changed", "title"}
    old = recs(spark, [
        ("1", "changed", "x", "info", 0.1, "k", "accepted"), ("2", "same", "x", "info", 0.1, "k", "dismissed"),
        ("3", "changed", "x", "info", 0.1, "k", "dismissed"), ("4", "same", "x", "info", 0.1, "k", "pending")])
    assert {r.rec_id for r in art.preserved_recs(old, scope).collect()} == {"1", "2"}


def test_delete_cascade(spark):
    articles = _article(spark, [("a", "t", "b"), ("b", "t", "b"), ("c", "t", "b")])
    rows = recs(spark, [("1", "id-a", "id-b", "info", 0.1, "k"), ("2", "id-b", "id-c", "info", 0.1, "k"), ("3", "id-c", "id-a", "info", 0.1, "k")])
    ids = articles.filter("url = 'a'").select("article_id")
    idle = frame(spark, RUNS, run_id=["r"], project_id=["p"], status=["completed"])
    left, kept = art.delete_cascade(articles, rows, ids, idle)
    assert left.count() == 2 and [r.rec_id for r in kept.collect()] == ["2"]
    with pytest.raises(RuntimeError):
        art.delete_cascade(articles, rows, ids, idle.withColumn("status", F.lit("running")))


def test_embeddings(spark):
    articles = _article(spark, [("hit", "t", "b", 1), ("stale", "t", "b", 1), ("none", "t", "b"), ("blank", "", " \n"), ("model", "t", "b", 1)])
    articles = articles.withColumn("embedding_model", F.when(F.col("url") == "model", "old").otherwise(F.col("embedding_model")))
    flagged = articles.withColumn("has_embedding", F.col("embedding").isNotNull())
    hashes = articles.select("article_id", F.when(F.col("url") == "stale", "x").otherwise(F.col("body_hash")).alias("body_hash"), "title_hash")
    split = art.embedding_cache_split(flagged, hashes, "m").cache()
    assert {r.url for r in split.filter("cached").collect()} == {"hit"}

    def embed(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    vectors = art.embed_missing(split, embed, 2, dims=4).cache()
    assert {r.article_id: r.embedding for r in vectors.collect()} == {
        f"id-{u}": [4.0, 1.0, 0.0, 0.0] for u in ("stale", "none", "model")}
    stored = {r.url: r for r in art.persist_embeddings(articles, vectors, "m2").collect()}
    assert stored["hit"].embedding_model == "m" and stored["none"].embedding_model == "m2"
    with pytest.raises(Exception, match="vectors for"):
        art.embed_missing(split, lambda texts: [], 2).collect()
    cleared = art.invalidate_embeddings(articles, articles.filter("url = 'hit'").select("article_id"))
    assert {r.url for r in cleared.filter("embedding is not null").collect()} == {"stale", "model"}
    assert art.invalidate_embeddings(articles, articles.select("project_id")).filter("embedding is not null").count() == 0
    estimate = reports.embedding_estimate(split).first()
    assert (estimate.cached, estimate.needs_generation, estimate.estimated_cost) == (1, 4, 0.0)


# --- reviews --------------------------------------------------------------------------------


def test_review(spark):
    df = recs(spark, [("1", "a", "b", "info", 0.1, "k"), ("2", "a", "c", "info", 0.1, "k"), ("3", "a", "d", "info", 0.1, "k")])
    actions = spark.createDataFrame(
        [("1", "accepted", None, NOW, 1), ("1", "dismissed", "late", NOW, 2), ("2", "dismissed", "no", ago(5), 1), ("9", "accepted", None, NOW, 1)],
        "rec_id string, status string, dismiss_reason string, expected_updated_at timestamp, seq int",
    )
    snapshot, outcomes = review.apply_review(df, actions, now())
    assert {(r.rec_id, r.seq): r.outcome for r in outcomes.collect()} == {
        ("1", 1): "updated", ("1", 2): "conflict", ("2", 1): "conflict", ("9", 1): "not_found"}
    assert {r.rec_id: r.status for r in snapshot.collect()} == {"1": "accepted", "2": "pending", "3": "pending"}
    ids = spark.createDataFrame([("1",), ("3",), ("9",)], "rec_id string")
    bulk, counts = review.bulk_review(df, ids, "dismissed", "why", now(), "p")
    assert tuple(counts.first()) == (2, 3)
    assert {r.rec_id: r.dismiss_reason for r in bulk.collect()} == {"1": "why", "2": None, "3": "why"}
    with pytest.raises(ValueError):
        review.bulk_review(df, ids, "pending", None, now())
    with pytest.raises(ValueError):
        review.rec_filter(df, severity="fatal")


def test_insert_and_supersede(spark):
    articles = _article(spark, [("a", "t", "b"), ("b", "t", "b")])
    old = recs(spark, [("1", "id-a", "id-b", "info", 0.1, "k", "pending", "r0"), ("2", "id-a", "id-b", "info", 0.1, "k", "accepted", "r0")])
    marked = review.supersede_pending(old, "p", "r1")
    assert {r.rec_id: r.status for r in marked.collect()} == {"1": "superseded", "2": "accepted"}
    new = recs(spark, [("3", "id-a", "id-b", "info", 0.1, "k", "pending", "r1"), ("4", "id-a", "id-b", "info", 0.1, "k", "pending", "r1"),
                       ("5", "id-a", "id-gone", "info", 0.1, "k", "pending", "r1")])
    assert {r.rec_id for r in review.insert_recs(marked, new, articles).collect()} == {"1", "2", "3"}


def test_validation_and_settings(spark):
    df = spark.createDataFrame(
        [("accepted", "x" * 500, ["keyword"], 0.5, 1.0, 50.0, "groq"), ("pending", "x" * 501, [], 0.96, 0.59, 1.5, "acme"),
         ("dismissed", None, None, None, None, None, None), ("accepted", None, ["psychic"], 0.49, 1.01, 51.0, "cohere")],
        "status string, dismiss_reason string, default_approaches array<string>, similarity_threshold double, "
        "fuzzy_tolerance double, max_links_per_page double, embedding_provider string",
    )
    got = [r.errors for r in review.validate_rows(df).collect()]
    assert got[0] == [] and got[2] == []
    assert got[1] == ["status", "dismiss_reason", "default_approaches", "similarity_threshold", "fuzzy_tolerance", "max_links_per_page", "embedding_provider"]
    assert got[3] == ["default_approaches", "similarity_threshold", "fuzzy_tolerance", "max_links_per_page"]
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    configs = spark.createDataFrame([("p", "crosslink", (0.6, None)), ("q", "other", (0.9, 1))],
                                    "project_id string, strategy_id string, settings struct<similarity_threshold:double,max_links_per_page:int>")
    got = {r.project_id: r for r in review.config_lookup(projects, configs, "crosslink").collect()}
    assert (got["p"].similarity_threshold, got["p"].max_links_per_page) == (0.6, 10)
    assert (float(got["q"].similarity_threshold), got["q"].default_approaches) == (0.75, ["keyword"])


# --- ledger -------------------------------------------------------------------------------------


def test_failures_and_stale_tasks(spark):
    tasks = frame(spark, TASKS, task_id=list("abcde"), job_id=["j"] * 5, status=["processing"] * 5,
                  retry_count=[0, 2, 0, 1, 2], started_at=[ago(15), ago(15), ago(5), ago(15), ago(15)])
    failures = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("c", "x", False), ("d", "x", True)],
                                     "task_id string, error_message string, is_transient boolean")
    got = {r.task_id: r for r in ledger.fail_transition(tasks, failures, now()).collect()}
    assert [got[k].status for k in "abcde"] == ["pending", "failed", "failed", "pending", "processing"]
    assert got["a"].retry_after == NOW + dt.timedelta(seconds=30) and got["a"].started_at is None
    assert got["d"].retry_after == NOW + dt.timedelta(seconds=60) and got["d"].retry_count == 2
    stale = ledger.stale_tasks(tasks, now())
    assert {r.task_id: r.status for r in stale.collect()} == {
        "a": "pending", "b": "failed", "c": "processing", "d": "pending", "e": "failed"}
    jobs = frame(spark, JOBS, job_id=["j", "k"], failed_urls=[1, 0])
    assert {r.job_id: r.failed_urls for r in ledger.failed_increment(jobs, stale).collect()} == {"j": 3, "k": 0}


def test_rollup_runs_and_health(spark):
    jobs = frame(spark, JOBS, job_id=["done", "lost", "open", "empty"], status=["running"] * 4, completed_urls=[1, 0, 1, 0],
                 failed_urls=[1, 2, 0, 0], created_at=[ago(20), ago(5), ago(16), ago(1)])
    tasks = frame(spark, TASKS, task_id=list("abc"), job_id=["done", "lost", "open"], status=["completed", "failed", "pending"])
    got = {r.job_id: r.status for r in ledger.job_rollup(jobs, tasks, now()).collect()}
    assert got == {"done": "completed", "lost": "failed", "open": "running", "empty": "completed"}
    runs = frame(spark, RUNS, run_id=list("abcd"), project_id=["p"] * 4, status=["running", "running", "running", "pending"],
                 started_at=[ago(30), ago(30), ago(11), ago(30)], last_heartbeat_at=[ago(2), ago(11), None, None])
    got = {r.run_id: (r.status, r.error) for r in ledger.stale_runs(runs, now()).collect()}
    assert [got[k][0] for k in "abcd"] == ["running", "failed", "failed", "pending"] and got["a"][1] is None
    stuck = ledger.stuck_jobs(jobs, runs, now())
    assert {(r.id, r.type) for r in stuck.collect()} == {
        ("done", "ingestion_job"), ("open", "ingestion_job"), ("a", "analysis_run"), ("b", "analysis_run")}
    assert tuple(ledger.health_status(stuck).first()) == ("warning", 4)
    assert tuple(ledger.health_status(stuck.limit(0)).first()) == ("ok", 0)
    kept, count = ledger.expire_rows(jobs, "created_at", now() - F.expr("INTERVAL 10 MINUTES"))
    assert {r.job_id for r in kept.collect()} == {"lost", "empty"} and count.first().deleted == 2


def test_urls_and_fold(spark):
    urls = ["https://example.com/page", "https://EXAMPLE.COM/page", "https://example.com/other/", "https://example.com/other"]
    assert ledger.distinct_urls(spark.createDataFrame([(u,) for u in urls], "url string")).count() == 2
    log = spark.createDataFrame([("a", "pending", NOW, 1), ("a", "completed", NOW, 3), ("a", "processing", NOW, 2), ("b", "failed", ago(1), 9)],
                                "task_id string, status string, ts timestamp, seq int")
    assert {r.task_id: r.status for r in ledger.ledger_fold(log).collect()} == {"a": "completed", "b": "failed"}
    tasks = frame(spark, TASKS, task_id=["a", "b"], status=["processing", "failed"])
    updates = spark.createDataFrame([("a", "completed", NOW), ("b", "completed", NOW)], "task_id string, status string, ts timestamp")
    assert {r.task_id: r.status for r in ledger.late_update_rule(tasks, updates).collect()} == {"a": "completed", "b": "failed"}


# --- reports and files -------------------------------------------------------------------------------


def test_quota(spark):
    users = spark.createDataFrame([(1, "free", 3), (2, "pro", 3), (3, "free", 0)], "user_id int, plan string, run_limit bigint")
    projects = spark.createDataFrame([("f", 1), ("g", 1), ("p", 2), ("z", 3), ("x", 9)], "project_id string, user_id int")
    runs = spark.createDataFrame([("f", NOW)] * 3 + [("g", NOW), ("g", dt.datetime(2023, 12, 31))] + [("p", NOW)] * 9, "project_id string, created_at timestamp")
    got = {r.project_id: r for r in reports.monthly_run_quota(runs, projects, users, now()).collect()}
    assert {k: got[k].analyze_allowed for k in got} == {"f": False, "g": True, "p": True, "z": False, "x": False}
    assert got["g"].used == 1 and got["p"].run_limit is None and got["p"].semantic_allowed and not got["f"].api_allowed


def test_exports(spark, tmp_path):
    df = recs(spark, [("1", "a", "b", "info", 0.5, None), ("2", "a", "gone", "critical", 1.0, "keyword")])
    df = df.withColumns({"anchor_text": F.when(F.col("rec_id") == "1", '=say "hi", you\nthere'),
                         "suggestion": F.lit(None).cast(df.schema["suggestion"].dataType)})
    articles = spark.createDataFrame([("a", "A, one", "https://e.com/a"), ("b", "-B", "https://e.com/b")], "article_id string, title string, url string")
    export.export_csv(df, articles, str(tmp_path / "csv"))
    [part] = (tmp_path / "csv").glob("part-*")
    assert part.read_text(encoding="utf-8") == (
        "﻿source_title,source_url,anchor_text,target_title,target_url,severity,confidence,matching_approach,status,recommendation_id\n"
        '"A, one",https://e.com/a,,,,critical,1,keyword,pending,2\n'
        '"A, one",https://e.com/a,"\'=say ""hi"", you\nthere",\'-B,https://e.com/b,info,0.5,,pending,1\n')
    export.export_json(df, articles, str(tmp_path / "json"))
    import json

    [part] = (tmp_path / "json").glob("part-*")
    rows = json.loads(part.read_text())
    assert [r["id"] for r in rows] == ["2", "1"] and rows[0]["targetTitle"] == "" and len(rows[0]) == 15
    with pytest.raises(export.TooManyRows):
        export.export_csv(df, articles, str(tmp_path / "more"), cap=1)


# --- composites ------------------------------------------------------------------------------------------


def test_ingest(spark):
    tasks = frame(spark, TASKS, task_id=list("abcd"), job_id=["j"] * 4, status=["processing"] * 4, retry_count=[0, 0, 0, 0],
                  url=["https://e.com/a", "https://e.com/b", "https://bad.com/c", "https://e.com/en/d"])
    jobs = frame(spark, JOBS, job_id=["j"], status=["running"], completed_urls=[0], failed_urls=[0])
    log = tasks.select("task_id", "url").withColumns({
        "html": F.when(F.col("task_id") != "b", "<title>T</title><body>x"), "http_status": F.when(F.col("task_id") == "b", 0).otherwise(404),
        "response_time_ms": F.lit(5), "error": F.when(F.col("task_id") == "b", "ETIMEDOUT")})
    dns = spark.createDataFrame([("e.com", "8.8.8.8"), ("bad.com", "8.8.8.8"), ("bad.com", "10.0.0.1")], "host string, ip string")
    from linkloom.sources.network import robots_rules

    rules = robots_rules(spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /en/")], "domain string, robots_txt string"))
    out = ingest(log, tasks, jobs, spark.createDataFrame([], ARTICLES), F.lit("p"), now(), dns, rules, "bot")
    got = {r.task_id: (r.status, r.error_message) for r in out["tasks"].collect()}
    assert got == {"a": ("completed", None), "b": ("pending", "ETIMEDOUT"),
                   "c": ("failed", "ssrf: Resolved to private IP: 10.0.0.1"), "d": ("failed", "robots: disallowed")}
    [row] = out["articles"].collect()
    assert (row.url, row.http_status, row.action) == ("https://e.com/a", 404, "created")
    job = out["jobs"].first()
    assert (job.status, job.completed_urls, job.failed_urls) == ("running", 1, 2)


def test_analyze(spark):
    fill = "word " * 60
    articles = _article(spark, [("https://e.com/a", "Source", "see the react hooks guide " + fill), ("https://e.com/b", "React Hooks Guide", fill)])
    articles = articles.withColumn("word_count", F.lit(60))
    runs = frame(spark, RUNS, run_id=["r1", "r0"], project_id=["p", "p"], status=["pending", "completed"])
    old = recs(spark, [("1", "x", "y", "info", 0.1, "k", "pending", "r0")])
    tables = {"articles": articles, "recs": old, "runs": runs}
    out = analyze(tables, "r1", "p", default_registry(), {"fuzzy_plan": "none"}, embed=lambda ts: [[1.0, len(t)] for t in ts], model="m", now=now())
    stored = {(r.source_id, r.target_id): r for r in out["recs"].collect()}
    assert stored[("x", "y")].status == "superseded"
    assert stored[("id-https://e.com/a", "id-https://e.com/b")].matching_approach == "keyword"
    run = out["runs"].filter("run_id = 'r1'").first()
    assert (run.status, run.article_count, run.embeddings_cached, run.embeddings_generated) == ("completed", 2, 0, 2)
    assert run.recommendation_count == len(stored) - 1
    assert out["articles"].filter("embedding is null").count() == 0
    # A run cancelled meanwhile stays cancelled.
    cancelled = runs.withColumn("status", F.lit("cancelled"))
    ended = analyze(tables, "r1", "p", default_registry(), {"fuzzy_plan": "none"}, now=now(), latest_runs=lambda: cancelled)
    assert ended["runs"].filter("run_id = 'r1'").first().status == "cancelled"
    # A finished run is left alone; an error marks the run and nothing else.
    assert analyze(out, "r1", "p", default_registry()) == out
    broken = analyze(tables, "r1", "p", default_registry(), embed=lambda ts: [], model="m", now=now())
    assert broken["runs"].filter("run_id = 'r1'").first().status == "failed" and broken["recs"] is old
    assert conform(out["recs"], PROPOSALS).columns == PROPOSALS.names


def test_analyze_all_equals_one_run_after_the_other(spark):
    """Four projects with settings of their own: one plan gives what single runs give."""
    import random

    rng = random.Random(11)
    words = "alpha beta gamma delta rho sigma taus omega".split()
    rows = []
    for project in ("p", "q", "r", "s"):
        titles = [" ".join(rng.choices(words, k=4)) for _ in range(5)]
        for k in range(9):
            parts = rng.choices(words, k=55)
            for t in rng.sample(titles, 3):
                t = list(t)
                if rng.random() < 0.6:
                    t[rng.randrange(len(t))] = rng.choice("abxyz ")
                parts.insert(rng.randrange(50), "".join(t))
            vector = [rng.random() + (3.0 if d == k % 3 else 0.0) for d in range(4)]
            rows.append((project, f"{project}{k}", f"https://e.com/{project}{k}", rng.choice(titles), " ".join(parts), vector, "m"))
    names = "project_id article_id url title body embedding embedding_model".split()
    articles = frame(spark, ARTICLES, **dict(zip(names, map(list, zip(*rows)))))
    articles = articles.withColumns({"body_hash": F.sha2("body", 256), "word_count": F.lit(60), "http_status": F.lit(200)}).cache()
    settings = {
        "p": (["keyword", "semantic"], 0.9, 0.7, 2),
        "q": (["semantic"], 0.95, 0.8, 10),
        "r": (["keyword"], 0.5, 0.95, 1),
    }
    configs = spark.createDataFrame(
        [(k, "crosslink", v) for k, v in settings.items()],
        "project_id string, strategy_id string, settings struct<default_approaches:array<string>,similarity_threshold:double,"
        "fuzzy_tolerance:double,max_links_per_page:int>",
    )
    runs = frame(spark, RUNS, run_id=["rp", "rq", "rr", "rs", "rp2", "ro"], project_id=list("pqrsp") + ["o"], status=["pending"] * 6,
                 created_at=[NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=2), NOW + dt.timedelta(hours=1)])
    old = recs(spark, [("1", "x", "y", "info", 0.1, "k", "pending", "r0")])
    tables = {"articles": articles, "recs": old, "runs": runs}
    out = analyze_all(tables, default_registry(), configs, now=now())
    columns = "run_id source_id target_id matching_approach confidence anchor_text char_start status".split()
    got = sorted(tuple(r) for r in out["recs"].filter("run_id <> 'r0'").select(columns).collect())
    want = []
    for project in settings | {"s": None}:
        own = settings.get(project) or (["keyword"], 0.75, 0.8, 10)
        options = dict(zip(("approaches", "similarity_threshold", "fuzzy_tolerance", "max_links_per_page"), own))
        single = analyze(tables, f"r{project}", project, default_registry(), options, now=now())
        want += [tuple(r) for r in single["recs"].filter("run_id <> 'r0'").select(columns).collect()]
    assert got == sorted(want) and {r[3] for r in got} >= {"keyword", "semantic"}
    status = {r.run_id: (r.status, r.article_count, r.recommendation_count) for r in out["runs"].collect()}
    assert status["rp2"][0] == "pending" and status["ro"][0] == "completed"
    for run in ("rp", "rq", "rr", "rs"):
        assert status[run] == ("completed", 9, sum(r[0] == run for r in got))
    assert out["recs"].filter("run_id = 'r0'").first().status == "superseded"
    broken = analyze_all(tables, default_registry(), configs, embed=lambda ts: [], model="other", now=now())
    assert {r.run_id: r.status for r in broken["runs"].collect()} == {
        "rp": "failed", "rq": "failed", "rr": "failed", "rs": "failed", "ro": "failed", "rp2": "pending"
    }
    assert analyze_all({**tables, "runs": runs.limit(0)}, default_registry())["recs"].count() == 1


def test_partitioned_report_equals_the_single_file(spark, tmp_path):
    from linkloom.plans import inputs

    recs = inputs.order_recs(spark, "/root/testdata/sf0.001")
    arts = inputs.customer_articles(spark, "/root/testdata/sf0.001")
    export.export_csv(recs, arts, str(tmp_path / "one"))
    export.export_csv_parts(recs, arts, str(tmp_path / "parts"))

    def joined(name):
        return "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))

    assert joined("one") == joined("parts")
    assert joined("one").startswith(export.BOM + export.CSV_HEADER + "\n")
    export.export_json_parts(recs, arts, str(tmp_path / "json"))
    import json

    rows = [json.loads(x) for x in joined("json").splitlines()]
    assert len(rows) == recs.count()
    keys = [({"critical": 0, "warning": 1, "info": 2}[r["severity"]], -r["confidence"], r["id"]) for r in rows]
    assert keys == sorted(keys)


def test_filter_arguments(spark):
    rows = recs(spark, [("1", "x", "y", "info", 0.1, "k", "pending", "r0")])
    assert review.rec_filter(rows, output="csv", limit=100).count() == 1
    for bad in ({"output": "xml"}, {"limit": 0}, {"limit": 101}, {"severity": "high"}):
        with pytest.raises(ValueError):
            review.rec_filter(rows, **bad)


def test_two_decimals_of_exact_halves(spark):
    """an exact half rounds up, a printed half rounds by its binary value."""
    values = [0.875, 0.125, 0.375, 0.625, 1.005, 0.615, 0.8749999999999999, 1.0, 0.0, 2.675]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in rows.select(cl.two_decimals(F.col("x"))).collect()]
    assert got == ["0.88", "0.13", "0.38", "0.63", "1.00", "0.61", "0.87", "1.00", "0.00", "2.67"]


def test_confidence_is_rounded_as_in_sql(spark, tmp_path):
    """9725 / 500000 is 0.01945 when printed, but lies below the half."""
    import duckdb

    prices = [9725.0, 437500.0, 123456.78, 600000.0, 25.0, 75.0]
    rows = [(k, 1, "O", p, dt.date(1998, 1, 1), "2-HIGH") for k, p in enumerate(prices, 1)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(i.with_ctes("recs", "SELECT rec_id, confidence FROM recs ORDER BY rec_id")).fetchall()
    got = i.order_recs(spark, str(tmp_path)).select("rec_id", "confidence").orderBy("rec_id").collect()
    assert [tuple(r) for r in got] == want and want[0][1] == 0.0194
