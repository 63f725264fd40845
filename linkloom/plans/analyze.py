"""One analysis run: embed, run strategies, merge, rank, store."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import articles as art
from linkloom.operators import matching, rank, reports, review
from linkloom.plans.crosslink import keyword_proposals, phrase_targets
from linkloom.plans.registry import Context, StrategyRegistry
from linkloom.schemas import RECS, conform
from linkloom.session import cut_lineage
from linkloom.sources.pages import scoped

log = logging.getLogger(__name__)


def stored_recs(ranked: DataFrame, run_id: str | Column, now: Column) -> DataFrame:
    """Proposals as pending recommendation rows of a run (or of each row's run)."""
    run_id = F.lit(run_id) if isinstance(run_id, str) else run_id
    return conform(
        ranked.withColumns(
            {
                "run_id": run_id,
                "rec_id": F.sha2(
                    F.concat_ws("\n", run_id, "source_id", "target_id", "strategy_id"), 256
                ),
                "status": F.lit("pending"),
                "created_at": now,
                "updated_at": now,
            }
        ),
        RECS,
    )


def cached_vectors(articles: DataFrame, model: str) -> DataFrame:
    """Adds ``cached``: a vector of that model is stored. A snapshot's hashes are
    the current ones (an overwrite clears the vector), so nothing is compared."""
    stored = F.col("embedding").isNotNull() & (F.col("embedding_model") == model)
    return articles.withColumn("cached", F.coalesce(stored, F.lit(False)))


def dry_run(articles: DataFrame, model: str) -> DataFrame:
    """Cache counts and cost per project; nothing is written."""
    return reports.embedding_estimate(cached_vectors(articles, model))


def reanalysis_scope(articles: DataFrame, last: DataFrame, recs: DataFrame) -> dict[str, DataFrame]:
    """What to analyse again, and which reviewed rows to keep."""
    scope = art.change_scope(articles, last)
    return {
        "scope": scope,
        "to_analyze": art.union_scope(scope),
        "preserved": art.preserved_recs(recs, scope),
    }


def embed_step(
    articles: DataFrame,
    embed: Callable[[list[str]], list[list[float]]] | None,
    model: str | None,
    batch_size: int,
) -> tuple[DataFrame, DataFrame]:
    """(articles with vectors, project_id/cached rows of what was done)."""
    split = cached_vectors(articles, model or "")
    done = split.filter(F.col("cached"))
    if embed is not None:
        todo = art.skip_empty_content(split.filter(~F.col("cached")))
        done = split.filter(F.col("cached")).unionByName(todo)
        # The provider is called once per text, so its answers are written out.
        vectors = cut_lineage(art.embed_missing(split, embed, batch_size), "vectors")
        articles = art.persist_embeddings(articles, vectors, model)
    return articles, done.select("project_id", "cached")


def analyze(
    tables: Mapping[str, DataFrame],
    run_id: str,
    project_id: str,
    registry: StrategyRegistry,
    settings: Mapping[str, Any] | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    model: str | None = None,
    batch_size: int = 512,
    last: DataFrame | None = None,
    now: Column | None = None,
    latest_runs: Callable[[], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Next snapshots of articles, recs and runs.

    ``tables``: articles, recs, runs. With ``last`` (the hashes of the previous
    run) only new and changed articles are analysed as sources. An error marks
    the run failed and leaves the other tables as they were; strategies fail
    one by one. ``latest_runs`` reads the stored runs again before the end: a
    run that was cancelled or ended by someone else meanwhile keeps that state.
    """
    now = F.current_timestamp() if now is None else now
    runs, recs = tables["runs"], tables["recs"]
    mine = F.col("run_id") == run_id
    state = runs.filter(mine).select("status").first()
    if state is None or state.status not in ("pending", "running"):
        return dict(tables)
    runs = runs.withColumns(
        {
            "status": F.when(mine, "running").otherwise(F.col("status")),
            "started_at": F.when(mine, now).otherwise(F.col("started_at")),
            "last_heartbeat_at": F.when(mine, now).otherwise(F.col("last_heartbeat_at")),
        }
    )
    try:
        own = scoped(tables["articles"], project_id)
        others = tables["articles"].filter(F.col("project_id") != project_id)
        own, done = embed_step(own, embed, model, batch_size)
        source_ids = None
        if last is not None:
            scope = art.change_scope(own, last)
            source_ids = art.union_scope(scope).withColumn("project_id", F.lit(project_id))
        found, errors = registry.analyze_with_all(Context(own, source_ids), settings)
        cap = int((settings or {}).get("max_links_per_page") or 10)
        ranked = rank.per_page_cap(rank.merge_pairs(found), cap)
        fresh = cut_lineage(stored_recs(ranked, run_id, now), "recs")
        kept = review.supersede_pending(recs, project_id, run_id)
        stored = review.insert_recs(kept, fresh, own)
        counted = reports.run_counters(runs.filter(mine), own, fresh, done)
        finished = counted.withColumns(
            {
                "status": F.lit("completed"),
                "completed_at": now,
                "strategies_used": F.array(*[F.lit(s.id) for s in registry.list()]).cast(
                    "array<string>"
                ),
                "error": F.lit("; ".join(f"{k}: {v}" for k, v in errors.items()) or None).cast(
                    "string"
                ),
            }
        ).select(runs.columns)
        after = {"articles": others.unionByName(own), "recs": stored}
        if latest_runs is not None:
            found_runs = latest_runs()
            stands = found_runs.filter(mine).select("status").first()
            if stands is None or stands.status not in ("pending", "running"):
                return {**tables, **after, "runs": found_runs}
        written = cut_lineage(runs.filter(~mine).unionByName(finished), "runs")
        return {**tables, **after, "runs": written}
    except Exception as error:  # noqa: BLE001 - the run records it
        log.warning("run %s failed: %s", run_id, error)
        failed = runs.withColumns(
            {
                "error": F.when(mine, F.lit(str(error))).otherwise(F.col("error")),
                "completed_at": F.when(mine, now).otherwise(F.col("completed_at")),
                "status": F.when(mine, "failed").otherwise(F.col("status")),
            }
        )
        return {**tables, "runs": failed}


def analyze_all(
    tables: Mapping[str, DataFrame],
    registry: StrategyRegistry,
    configs: DataFrame | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    model: str | None = None,
    batch_size: int = 512,
    now: Column | None = None,
    options: Mapping[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """Next snapshots of articles, recs and runs: every project's open run in one plan.

    ``tables`` as for :func:`analyze`. Of a project's pending or running runs the first
    (by creation, then id) is done, others wait. Settings are columns: each project's
    stored ones (``configs``: project_id, strategy_id, settings) or the defaults, joined
    by project, so projects with different approaches, thresholds and budgets share
    every join. A project without articles gets a completed run without rows. Runs fail
    together; strategies fail one by one, and each run records the errors.
    """
    now = F.current_timestamp() if now is None else now
    runs, recs = tables["runs"], tables["recs"]
    first = Window.partitionBy("project_id").orderBy(F.col("created_at").asc_nulls_first(), "run_id")
    waiting = runs.filter(F.col("status").isin("pending", "running")).withColumn("_rn", F.row_number().over(first))
    claimed = cut_lineage(waiting.filter("_rn = 1").select("project_id", "run_id"), "claimed")
    projects = claimed.select("project_id")
    if configs is None:
        configs = runs.sparkSession.createDataFrame([], "project_id string, strategy_id string, settings struct<none:int>")
    settings = cut_lineage(review.config_lookup(projects, configs, "crosslink"), "settings")
    mine = claimed.select("run_id", F.lit(True).alias("_mine"))

    def ended(status: str, error: Column) -> DataFrame:
        marked = runs.join(mine, "run_id", "left")
        is_mine = F.coalesce("_mine", F.lit(False))
        new = {"status": F.lit(status), "error": error, "completed_at": now, "started_at": now, "last_heartbeat_at": now}
        return marked.withColumns({c: F.when(is_mine, v).otherwise(F.col(c)) for c, v in new.items()}).select(runs.columns)

    try:
        own = tables["articles"].join(projects, "project_id", "left_semi").select(tables["articles"].columns)
        others = tables["articles"].join(projects, "project_id", "left_anti").select(tables["articles"].columns)
        own, done = embed_step(own, embed, model, batch_size)
        found, errors = registry.analyze_with_all(Context(own, None, {"settings": settings}), options)
        budget = settings.select("project_id", F.col("max_links_per_page").alias("_cap"))
        w = Window.partitionBy("project_id", "source_id").orderBy(*rank.rank_order())
        merged = rank.merge_pairs(found).join(budget, "project_id")
        capped = merged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_cap")).drop("_rn", "_cap")
        owned = capped.drop("run_id").join(claimed, "project_id")
        fresh = cut_lineage(stored_recs(owned, F.col("run_id"), now), "recs")
        running = claimed.withColumnRenamed("run_id", "_run")
        old = recs.join(running, "project_id", "left")
        stale = F.col("_run").isNotNull() & (F.col("status") == "pending") & (F.col("run_id") != F.col("_run"))
        kept = old.withColumn("status", F.when(stale, "superseded").otherwise(F.col("status"))).select(recs.columns)
        stored = review.insert_recs(kept, fresh, own)
        message = "; ".join(f"{k}: {v}" for k, v in errors.items()) or None
        active = runs.join(mine, "run_id", "left_semi").withColumn("status", F.lit("running"))
        counted = reports.run_counters(active, own, fresh, done).withColumns(
            {
                "status": F.lit("completed"),
                "error": F.lit(message).cast("string"),
                "started_at": now,
                "last_heartbeat_at": now,
                "completed_at": now,
                "strategies_used": F.array(*[F.lit(s.id) for s in registry.list()]).cast("array<string>"),
            }
        )
        waiting_on = runs.join(mine, "run_id", "left_anti").select(runs.columns)
        written = cut_lineage(waiting_on.unionByName(counted.select(runs.columns)), "runs")
        return {**tables, "articles": others.unionByName(own), "recs": stored, "runs": written}
    except Exception as error:  # noqa: BLE001 - the runs record it
        log.warning("runs failed: %s", error)
        return {**tables, "runs": ended("failed", F.lit(str(error)))}


def page_links(articles: DataFrame, max_new: int = 10) -> DataFrame:
    """Which pages should link to which, by exact title phrase, ranked.

    Articles are stored first: the matching reads their columns several times,
    pages should be parsed once.
    """
    stored = cut_lineage(articles, "articles")
    sources = matching.source_guards(stored)
    targets = cut_lineage(phrase_targets(stored), "phrase-targets")
    pairs = matching.keyword_exact(sources, targets, max_new)
    return rank.rank_recs(keyword_proposals(pairs, targets))
