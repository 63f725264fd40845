"""The crosslink strategy: keyword (exact, fuzzy) and semantic proposals."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.functions import text as tx
from linkloom.operators import fuzzy, matching, semantic, vectors
from linkloom.plans.registry import Context, Strategy, StrategyRegistry
from linkloom.schemas import PROPOSALS, conform
from linkloom.session import cut_lineage

DEFAULTS = {
    "approaches": ("keyword", "semantic"),
    "similarity_threshold": vectors.STRATEGY_THRESHOLD,
    "fuzzy_tolerance": fuzzy.DICE_THRESHOLD,
    "max_links_per_page": matching.DEFAULT_MAX_NEW,
    "fuzzy_plan": "auto",
}


def _ordered(source: Column, target: Column, step: int) -> Column:
    """A reproducible tie-break: keyword rows first, then by pair."""
    low = F.shiftrightunsigned(F.xxhash64(source, target), 2)
    return F.lit(step).cast("bigint") * (1 << 62) + low


def keyword_proposals(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    about = targets.select("project_id", "target_id", "target_url", "title", "anchor_text")
    anchor = F.col("anchor_text")
    return conform(
        pairs.join(about, ["project_id", "target_id"]).select(
            "project_id",
            F.lit("crosslink").alias("strategy_id"),
            "source_id",
            "target_id",
            F.lit("crosslink").alias("type"),
            scoring.severity_of(F.col("confidence")).alias("severity"),
            rec_title(F.col("title")).alias("title"),
            keyword_description(anchor).alias("description"),
            anchor,
            "confidence",
            F.lit("keyword").alias("matching_approach"),
            F.col("context").alias("source_context"),
            F.col("offset").alias("char_start"),
            (F.col("offset") + F.length("phrase")).alias("char_end"),
            suggestion(anchor, F.col("target_url")).alias("suggestion"),
            _ordered(F.col("source_id"), F.col("target_id"), 0).alias("ord"),
        ),
        PROPOSALS,
    )


def semantic_proposals(rows: DataFrame) -> DataFrame:
    anchor, similarity = F.col("anchor_text"), F.col("similarity")
    return conform(
        rows.select(
            "project_id",
            F.lit("crosslink").alias("strategy_id"),
            "source_id",
            "target_id",
            F.lit("crosslink").alias("type"),
            scoring.severity_of(similarity).alias("severity"),
            rec_title(tx.display_title(F.col("target_title"))).alias("title"),
            semantic_description(similarity).alias("description"),
            anchor,
            similarity.alias("confidence"),
            F.lit("semantic").alias("matching_approach"),
            F.col("context").alias("source_context"),
            F.col("offset").alias("char_start"),
            (F.col("offset") + F.length(anchor)).alias("char_end"),
            suggestion(anchor, F.col("target_url")).alias("suggestion"),
            _ordered(F.col("source_id"), F.col("target_id"), 1).alias("ord"),
        ),
        PROPOSALS,
    )


def rec_title(title: Column) -> Column:
    return F.concat(F.lit('Link to "'), title, F.lit('"'))


def keyword_description(anchor: Column) -> Column:
    return F.concat(F.lit('Found keyword match for "'), anchor, F.lit('" in article body.'))


def two_decimals(x: Column) -> Column:
    """Text with two decimals, rounded by the exact binary value (x < 8)."""
    low = F.floor(x * 100)
    # Through bigint: a double cast to decimal keeps 17 digits only.
    scaled = (x * F.lit(float(1 << 60))).cast("bigint").cast("decimal(38,0)")
    half = (2 * low + 1).cast("decimal(10,0)") * F.lit(1 << 60).cast("decimal(20,0)")
    cents = low + F.when(scaled * 200 >= half, 1).otherwise(0)
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def semantic_description(similarity: Column) -> Column:
    return F.concat(
        F.lit("Found semantically similar article (similarity: "),
        two_decimals(similarity),
        F.lit(")."),
    )


def suggestion(anchor: Column, url: Column) -> Column:
    return F.struct(anchor.alias("anchor_text"), url.alias("target_url"))


def tenant_settings(context: Context) -> DataFrame | None:
    """Settings as columns, one row for each project, where the context has them."""
    given = context.tables.get("settings")
    if given is None:
        return None
    return given.select(
        "project_id",
        F.col("default_approaches").alias("_approaches"),
        F.col("similarity_threshold").cast("double").alias("_similarity"),
        F.col("fuzzy_tolerance").cast("double").alias("_tolerance"),
        F.col("max_links_per_page").cast("int").alias("_budget"),
    )


def own_budget(pairs: DataFrame, per_project: DataFrame) -> DataFrame:
    """Of each source's pairs (cut to the largest budget) the first of its project's budget."""
    w = Window.partitionBy("project_id", "source_id").orderBy("target_id")
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).join(
        per_project.select("project_id", "_budget"), "project_id"
    )
    return ranked.filter(F.col("_rn") <= F.col("_budget")).select(pairs.columns)


def keyword_pairs(
    sources: DataFrame,
    targets: DataFrame,
    threshold: float,
    max_new: int,
    plan: str = "auto",
    per_project: DataFrame | None = None,
) -> DataFrame:
    """Exact and fuzzy hits together, cut to the page budget.

    With ``per_project`` (see :func:`tenant_settings`) ``threshold`` and ``max_new`` are
    the loosest of all projects: a best window does not depend on the threshold, so a
    project's own one is applied to what was found, before the budget.
    """
    bodies = matching.distinct_bodies(sources)
    phrases = matching.distinct_phrases(targets)
    exact = matching.phrase_hits(bodies, phrases).withColumn("confidence", F.lit(1.0))
    if plan != "none":
        near = fuzzy.fuzzy_hits(bodies, phrases, None, threshold)
        if per_project is not None:
            near = near.join(per_project.select("project_id", "_tolerance"), "project_id")
            near = near.filter(F.col("confidence") >= F.col("_tolerance")).drop("_tolerance")
        exact = exact.unionByName(near)
    pairs = matching.keyword_budget(exact, sources, targets, max_new)
    return pairs if per_project is None else own_budget(pairs, per_project)


def phrase_targets(articles: DataFrame) -> DataFrame:
    return matching.title_guards(matching.eligible_targets(articles)).select(
        "project_id",
        F.col("article_id").alias("target_id"),
        F.col("url").alias("target_url"),
        "title",
        "phrase",
        "anchor_text",
    )


def _lift_flags(articles: DataFrame) -> DataFrame:
    if "noindex" in articles.columns:
        return articles
    return articles.withColumn("noindex", F.coalesce("metadata.noindex", F.lit(False)))


def crosslink(context: Context, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Proposals for every source of the corpus, in one DAG.

    ``approaches`` selects the halves; without vectors only keyword rows
    arise. A table ``settings`` of the context (one row for each project, as
    ``config_lookup`` gives) takes the place of ``settings``.
    """
    options = {**DEFAULTS, **{k: v for k, v in (settings or {}).items() if v is not None}}
    per_project = tenant_settings(context)
    if per_project is not None:
        # Small, but read by several steps; only its loosest values come to the driver.
        per_project = cut_lineage(per_project, "tenant-settings")
        loosest = per_project.agg(F.min("_similarity"), F.min("_tolerance"), F.max("_budget")).first()
        if loosest[2] is None:
            return context.articles.sparkSession.createDataFrame([], PROPOSALS)
        options |= dict(zip(("similarity_threshold", "fuzzy_tolerance", "max_links_per_page"), loosest, strict=True))
    max_new = int(options["max_links_per_page"])
    articles = _lift_flags(context.articles)

    def taking_part(rows: DataFrame, approach: str) -> DataFrame:
        if per_project is None:
            return rows
        wanted = per_project.filter(F.array_contains("_approaches", approach)).select("project_id")
        return rows.join(wanted, "project_id", "left_semi")

    sources = matching.source_guards(articles)
    if context.source_ids is not None:
        sources = sources.join(
            context.source_ids.select("project_id", "article_id"),
            ["project_id", "article_id"],
            "left_semi",
        )
    spark = articles.sparkSession
    pairs = spark.createDataFrame(
        [], "project_id string, source_id string, target_id string"
    )
    proposals = spark.createDataFrame([], PROPOSALS)
    if "keyword" in options["approaches"]:
        # Titles only, but read by every step of the matching.
        targets = cut_lineage(phrase_targets(taking_part(articles, "keyword")), "phrase-targets")
        found = keyword_pairs(
            taking_part(sources, "keyword"), targets, float(options["fuzzy_tolerance"]), max_new,
            options["fuzzy_plan"], per_project,
        )
        # Read three times below: budget, exclusion and output.
        pairs = cut_lineage(found, "keyword-pairs")
        proposals = keyword_proposals(pairs, targets)
    if "semantic" in options["approaches"] and "embedding" in articles.columns:
        similar = vectors.similar_articles(
            taking_part(articles, "semantic"), vectors.STRATEGY_K, float(options["similarity_threshold"])
        )
        budget = F.lit(max_new)
        if per_project is not None:
            # Ranks follow similarity, so a higher threshold takes rows off the end.
            similar = similar.join(per_project.select("project_id", "_similarity"), "project_id")
            similar = similar.filter(F.col("similarity") >= F.col("_similarity")).drop("_similarity")
        rows = semantic.semantic_targets(
            similar, sources, matching.eligible_targets(articles), pairs
        )
        if per_project is not None:
            rows = rows.join(per_project.select("project_id", "_budget"), "project_id")
            budget = F.col("_budget")
        fill = semantic.semantic_fill(rows, pairs, budget)
        proposals = proposals.unionByName(semantic_proposals(fill))
    return proposals


CROSSLINK = Strategy(
    id="crosslink",
    name="Crosslink Analysis",
    description="Finds pages whose text mentions or resembles another page of the same project.",
    analyze=crosslink,
)


def default_registry() -> StrategyRegistry:
    registry = StrategyRegistry()
    registry.register(CROSSLINK)
    return registry
