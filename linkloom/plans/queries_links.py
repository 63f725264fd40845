"""Queries over matching, vectors, ranking and the crosslink strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.functions import text as tx
from linkloom.operators import articles as art
from linkloom.operators import fuzzy, matching, rank, semantic, vectors
from linkloom.plans import crosslink as cl
from linkloom.plans import inputs as i
from linkloom.plans.analyze import page_links
from linkloom.plans.catalog import query
from linkloom.plans.inputs import with_ctes as w
from linkloom.plans.registry import Context, Strategy
from linkloom.session import cut_lineage

# --- guards ----------------------------------------------------------------------------


@query(
    "source_guards",
    w("docs", "SELECT article_id FROM docs WHERE (http_status IS NULL OR http_status < 400) AND "
      "word_count >= 50 AND body <> '' AND project_id IN (SELECT project_id FROM docs GROUP BY 1 "
      "HAVING count(*) >= 2)"),
)
def _source_guards(spark, sf):
    return matching.source_guards(i.document_articles(spark, sf)).select("article_id")


@query("title_guards", w("pg tgt", "SELECT article_id, phrase, anchor_text FROM tgt"))
def _title_guards(spark, sf):
    return matching.title_guards(matching.eligible_targets(i.page_articles(spark, sf))).select(
        "article_id", "phrase", "anchor_text"
    )


def _parts(spark, sf):
    """Parts as articles that link to the suppliers they were ordered with."""
    li = i.table(spark, sf, "lineitem")
    # Suppliers are few per part; the set is the page's link list.
    links = li.groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("_s"))
    hrefs = F.transform(
        "_s",
        lambda s: F.struct(
            F.concat(F.lit("../part/"), s.cast("string"), F.lit("/?ref=order#x")).alias("href"),
            F.lit("part").alias("anchor_text"),
        ),
    )
    key = F.col("p_partkey").cast("string")
    part = i.table(spark, sf, "part")
    return part.join(links, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.lit("shop").alias("project_id"),
        key.alias("article_id"),
        F.concat(F.lit("https://Shop.example.com/en/part/"), key).alias("url"),
        hrefs.alias("existing_links"),
        (F.col("p_size") > 40).alias("noindex"),
        F.when(F.col("p_size") == 7, 404).alias("http_status"),
    )


def _part_pairs(spark, sf):
    """Parts paired with the part numbered like the line's quantity."""
    return (
        i.table(spark, sf, "lineitem")
        .select(
            F.lit("shop").alias("project_id"),
            F.col("l_partkey").cast("string").alias("source_id"),
            F.col("l_quantity").cast("bigint").cast("string").alias("target_id"),
        )
        .distinct()
    )


@query(
    "already_linked",
    "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS source_id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS target_id "
    "FROM lineitem a WHERE CAST(l_quantity AS BIGINT) IN (SELECT p_partkey FROM part) AND NOT EXISTS (SELECT 1 FROM "
    "lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = CAST(a.l_quantity AS BIGINT))",
)
def _already_linked(spark, sf):
    return matching.already_linked(_part_pairs(spark, sf), _parts(spark, sf)).select(
        "source_id", "target_id"
    )


@query(
    "target_guards",
    "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS source_id, CAST(p_partkey AS VARCHAR) AS target_id FROM lineitem a "
    "JOIN part ON p_partkey = CAST(l_quantity AS BIGINT) WHERE p_size <= 40 AND p_size <> 7 AND p_partkey <> l_partkey "
    "AND l_partkey IN (SELECT p_partkey FROM part) AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE "
    "b.l_partkey = a.l_partkey AND b.l_suppkey = p_partkey)",
)
def _target_guards(spark, sf):
    parts = _parts(spark, sf)
    sources = parts.select(F.col("article_id").alias("source_id"))
    pairs = _part_pairs(spark, sf).join(sources, "source_id", "left_semi")
    return matching.target_guards(pairs, parts).select("source_id", "target_id")


# --- keyword matching ----------------------------------------------------------------------


def _page_sides(spark, sf):
    """Guarded sources and phrase targets of the stored pages."""
    pages = cut_lineage(i.page_articles(spark, sf), "articles")
    targets = cut_lineage(cl.phrase_targets(pages), "phrase-targets")
    return matching.source_guards(pages), targets


def _naive(limit: str) -> str:
    """Every source against every phrase of its project, in id order."""
    return f"""
SELECT source_id, target_id, offset_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY target_id) AS rn FROM (SELECT s.article_id AS source_id, t.article_id AS target_id,
  CAST(strpos(lower(s.body), t.phrase) - 1 AS INTEGER) AS offset_at FROM src s JOIN tgt t
  ON s.project_id = t.project_id AND s.article_id <> t.article_id
  WHERE strpos(lower(s.body), t.phrase) > 0)){limit}"""


@query(
    "phrase_hits",
    w("docs items", f"SELECT d.article_id, i.target_id, CAST(strpos(lower(d.body), lower({i.s_strip('i.title')})) - 1 AS INTEGER) "
      f"AS offset_at FROM docs d, items i WHERE strpos(lower(d.body), lower({i.s_strip('i.title')})) > 0 "
      f"AND len({i.s_distinctive(i.s_strip('i.title'))}) >= 3"),
)
def _phrase_hits(spark, sf):
    """Benchmark sentences inside documents of any language."""
    docs = i.document_articles(spark, sf).withColumn("project_id", F.lit("all"))
    items = i.benchmark_phrases(spark, sf).select(
        F.lit("all").alias("project_id"),
        F.col("target_id").alias("article_id"),
        "title",
    )
    targets = matching.title_guards(items)
    hits = matching.phrase_hits(
        matching.distinct_bodies(docs), matching.distinct_phrases(targets)
    )
    owners = docs.select("article_id", "body_hash").join(
        matching.body_groups(docs).select("body_hash", "body_id"), "body_hash"
    )
    return (
        hits.join(owners, "body_id")
        .join(targets.select("phrase", F.col("article_id").alias("target_id")), "phrase")
        .select("article_id", "target_id", F.col("offset").alias("offset_at"))
    )


@query("keyword_exact", w("pg src tgt", _naive(" WHERE rn <= 10")))
def _keyword_exact(spark, sf):
    pairs = matching.keyword_exact(*_page_sides(spark, sf))
    return pairs.select("source_id", "target_id", F.col("offset").alias("offset_at"))


@query("keyword_budget", w("pg src tgt", _naive(" WHERE rn <= 3")))
def _keyword_budget(spark, sf):
    pairs = matching.keyword_exact(*_page_sides(spark, sf), max_new=3)
    return pairs.select("source_id", "target_id", F.col("offset").alias("offset_at"))


@query(
    "page_links",
    w("pg src tgt", "SELECT s.source_id, s.target_id, 'critical' AS severity, 1.0::DOUBLE AS confidence, "
      "'Link to \"' || t.title || '\"' AS title, t.anchor_text, s.offset_at AS char_start, "
      f"s.offset_at + CAST(length(t.phrase) AS INTEGER) AS char_end FROM ({_naive(' WHERE rn <= 10')}) s JOIN tgt t "
      "ON t.article_id = s.target_id"),
)
def _page_links(spark, sf):
    return page_links(i.page_articles(spark, sf)).select(
        "source_id", "target_id", "severity", "confidence", "title", "anchor_text", "char_start", "char_end"
    )


@query("self_exclusion", w("pg src tgt", f"SELECT count(*) AS pairs, 0::BIGINT AS self_pairs FROM ({_naive(' WHERE rn <= 10')})"))
def _self(spark, sf):
    pairs = matching.keyword_exact(*_page_sides(spark, sf))
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("source_id") == F.col("target_id")).alias("self_pairs"),
    )


@query(
    "tenant_join",
    w("pg src tgt", f"SELECT s.project_id, count(*) AS pairs FROM ({_naive(' WHERE rn <= 10')}) x JOIN src s "
      "ON s.article_id = x.source_id GROUP BY 1"),
)
def _tenant(spark, sf):
    pairs = matching.keyword_exact(*_page_sides(spark, sf))
    return pairs.groupBy("project_id").agg(F.count("*").alias("pairs"))


# SQL needs minutes for every window against every phrase: checked by brute
# force on fixtures instead (tests/test_matching.py).
@query("keyword_fuzzy")
def _keyword_fuzzy(spark, sf):
    pairs = fuzzy.keyword_fuzzy(*_page_sides(spark, sf))
    return pairs.select("source_id", "target_id", "offset", F.round("confidence", 9).alias("confidence"))


@query("best_window")
def _best_window(spark, sf):
    """Best fuzzy window per distinct body and phrase."""
    sources, targets = _page_sides(spark, sf)
    bodies, phrases = matching.distinct_bodies(sources), matching.distinct_phrases(targets)
    return fuzzy.fuzzy_hits(bodies, phrases).select(
        "project_id", "body_id", "phrase", "offset", F.round("confidence", 9).alias("confidence")
    )


# --- vectors ---------------------------------------------------------------------------------


@query(
    "similar_articles",
    w("vec knn", "SELECT source_id, target_id, round(similarity, 6) AS similarity FROM knn WHERE rank <= 10"),
)
def _similar(spark, sf):
    return vectors.similar_articles(i.vectors(spark, sf), 10, 0.3).select(
        "source_id", "target_id", F.round("similarity", 6).alias("similarity")
    )


@query("knn_rank", w("vec knn", "SELECT source_id, target_id, CAST(rank AS BIGINT) AS rank FROM knn"))
def _knn_rank(spark, sf):
    return vectors.similar_articles(i.vectors(spark, sf), 20, 0.3).select(
        "source_id", "target_id", F.col("rank").cast("bigint").alias("rank")
    )


_SEMANTIC = f"""
sim AS (SELECT a.project_id, a.article_id AS source_id, b.article_id AS target_id, b.title, a.body,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
  FROM edocs a JOIN edocs b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id)
  AS rank FROM sim WHERE similarity >= 0.3) WHERE rank <= 20 AND (CAST(source_id AS BIGINT) + CAST(target_id AS BIGINT)) % 3 <> 0),
open AS (SELECT n.* FROM near n JOIN docs s ON s.article_id = n.source_id JOIN docs t ON t.article_id = n.target_id
  WHERE (s.http_status IS NULL OR s.http_status < 400) AND s.word_count >= 50 AND NOT t.noindex
  AND (t.http_status IS NULL OR t.http_status < 400))"""


def _semantic_rows(spark, sf):
    docs = i.embedded_documents(spark, sf)
    sources = matching.source_guards(docs)
    similar = cut_lineage(vectors.similar_articles(docs, vectors.STRATEGY_K, 0.3), "similar")
    # A third of the similar pairs, as if keyword matching had found them.
    known = similar.filter((F.col("source_id").cast("bigint") + F.col("target_id").cast("bigint")) % 3 == 0)
    bodies = i.document_bodies(spark, sf)
    return semantic.semantic_targets(similar, sources, matching.eligible_targets(docs), known, bodies)


# Anchors are never empty here, so the rows are those of the guards.
@query(
    "semantic_targets",
    w("docs edocs", f", {_SEMANTIC} SELECT source_id, target_id, round(similarity, 6) AS similarity FROM open "
      f"WHERE len({i.s_distinctive(i.s_display('title'))}) > 0").replace(")\n,", "),"),
)
def _semantic_targets(spark, sf):
    return _semantic_rows(spark, sf).select(
        "source_id", "target_id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "semantic_fill",
    w("docs edocs", f", {_SEMANTIC}, ok AS (SELECT * FROM open WHERE len({i.s_distinctive(i.s_display('title'))}) > 0), "
      "n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS rn FROM ok) "
      "SELECT source_id, target_id FROM n WHERE rn <= 2 - CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END"
      ).replace(")\n,", "),"),
)
def _semantic_fill(spark, sf):
    """With one keyword row on every even document and a budget of two."""
    docs = i.document_articles(spark, sf)
    used = docs.filter("doc_id % 2 = 0").select(
        "project_id", F.col("article_id").alias("source_id"), F.lit("x").alias("target_id")
    )
    rows = _semantic_rows(spark, sf)
    return semantic.semantic_fill(rows, used, 2).select("source_id", "target_id")


@query(
    "except_keyword",
    w("recs", "SELECT DISTINCT source_id, target_id FROM recs WHERE matching_approach = 'semantic' EXCEPT "
      "SELECT source_id, target_id FROM recs WHERE matching_approach = 'keyword'"),
)
def _except(spark, sf):
    recs = i.order_recs(spark, sf).withColumn("project_id", F.lit("all"))
    approach = F.col("matching_approach")
    left = semantic.without_keyword(recs.filter(approach == "semantic"), recs.filter(approach == "keyword"))
    return left.select("source_id", "target_id").distinct()


# --- the strategy ---------------------------------------------------------------------------------


def _run_crosslink(spark, sf):
    settings = {"similarity_threshold": 0.3, "max_links_per_page": 10}
    stored = cut_lineage(i.embedded_documents(spark, sf), "articles")
    return cl.crosslink(Context(stored), settings)


@query("crosslink")
def _crosslink(spark, sf):
    return _run_crosslink(spark, sf).select(
        "source_id", "target_id", "severity", "anchor_text", "matching_approach",
        F.round("confidence", 9).alias("confidence"), "char_start", "char_end",
    )


def _rec_strategy(name: str, approach: str, fails: bool = False) -> Strategy:
    def analyze(context, settings):
        if fails:
            raise RuntimeError("broken strategy")
        return context.tables["recs"].filter(F.col("matching_approach") == approach)

    return Strategy(name, name, "rows by approach", analyze)


def _registry():
    registry = cl.StrategyRegistry()
    registry.register(_rec_strategy("kw", "keyword"))
    registry.register(_rec_strategy("broken", "keyword", fails=True))
    registry.register(_rec_strategy("sem", "semantic"))
    registry.register(_rec_strategy("gone", "semantic"))
    registry.unregister("gone")
    return registry


@query(
    "strategy_registry",
    w("recs", "SELECT matching_approach, count(*) AS n FROM recs GROUP BY 1"),
)
def _strategy_registry(spark, sf):
    recs = i.order_recs(spark, sf)
    rows, errors = _registry().analyze_with_all(Context(recs, None, {"recs": recs}))
    assert set(errors) == {"broken"}
    return rows.groupBy("matching_approach").agg(F.count("*").alias("n"))


@query("union_strategies", w("recs", "SELECT source_id, target_id, matching_approach, confidence FROM recs"))
def _union_strategies(spark, sf):
    recs = i.order_recs(spark, sf)
    rows, _ = _registry().analyze_with_all(Context(recs, None, {"recs": recs}))
    return rows.select("source_id", "target_id", "matching_approach", "confidence")


# --- merge and rank --------------------------------------------------------------------------------

# Twenty times fewer pages than customers, so that pairs repeat.
_DENSE = (
    "dense AS (SELECT * REPLACE (CAST(CAST(source_id AS BIGINT) % 60 AS VARCHAR) AS source_id, "
    "CAST(CAST(target_id AS BIGINT) % 50 AS VARCHAR) AS target_id) FROM recs)"
)


def _dense(spark, sf):
    return i.order_recs(spark, sf).withColumns(
        {
            "source_id": (F.col("source_id").cast("bigint") % 60).cast("string"),
            "target_id": (F.col("target_id").cast("bigint") % 50).cast("string"),
        }
    ).drop("project_id", "run_id")


_MERGED = (
    f"{_DENSE}, merged AS (SELECT source_id, target_id, arg_min(severity, (-{i.s_weight('severity')}, ord)) AS severity, "
    f"arg_min(ord, (-{i.s_weight('severity')}, ord)) AS ord, "
    f"CASE WHEN bool_or(matching_approach = 'keyword') AND bool_or(matching_approach = 'semantic') "
    f"THEN 'both' ELSE arg_min(matching_approach, (-{i.s_weight('severity')}, ord)) END AS matching_approach, "
    "CASE WHEN bool_or(matching_approach = 'keyword') AND bool_or(matching_approach = 'semantic') "
    "THEN least(max(confidence) + 0.15, 1.0) ELSE max(confidence) END AS confidence FROM dense GROUP BY 1, 2)"
)


@query(
    "merge_pairs",
    w("recs", f", {_MERGED} SELECT source_id, target_id, severity, ord, matching_approach, "
      "round(confidence, 9) AS confidence FROM merged").replace(")\n,", "),"),
)
def _merge(spark, sf):
    return rank.merge_pairs(_dense(spark, sf)).select(
        "source_id", "target_id", "severity", "ord", "matching_approach",
        F.round("confidence", 9).alias("confidence"),
    )


@query(
    "per_page_cap",
    w("recs", f", {_MERGED} SELECT source_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY source_id "
      f"ORDER BY {i.s_weight('severity')} DESC, confidence DESC, ord) AS rn FROM merged) WHERE rn <= 10"
      ).replace(")\n,", "),"),
)
def _cap(spark, sf):
    return rank.per_page_cap(rank.merge_pairs(_dense(spark, sf))).select("source_id", "ord")


@query(
    "rank_recs",
    w("recs", f"SELECT ord, severity, confidence FROM recs ORDER BY {i.s_weight('severity')} DESC, "
      "confidence DESC, ord"),
)
def _rank(spark, sf):
    return rank.rank_recs(i.order_recs(spark, sf)).select("ord", "severity", "confidence")


@query(
    "export_order",
    w("recs", f"SELECT rec_id, severity, confidence FROM recs ORDER BY {i.s_export_weight('severity')}, "
      "confidence DESC, rec_id"),
)
def _export_order(spark, sf):
    return rank.export_order(i.order_recs(spark, sf)).select("rec_id", "severity", "confidence")


# --- pages ------------------------------------------------------------------------------------------


@query(
    "recs_page",
    w("recs", "SELECT *, row_number() OVER (ORDER BY "
      f"{i.s_export_weight('severity')}, confidence DESC, position) - 1 AS page_rank FROM (SELECT rec_id, severity, "
      "confidence, row_number() OVER (ORDER BY confidence DESC, rec_id) - 1 AS position, true AS has_more FROM recs "
      "WHERE (confidence, rec_id) IS NOT NULL AND (confidence < 0.6 OR (confidence = 0.6 AND rec_id > '')) "
      "ORDER BY confidence DESC, rec_id LIMIT 20)"),
)
def _recs_page(spark, sf):
    """The first page below a confidence of 0.6."""
    page = rank.recs_page(i.order_recs(spark, sf), 20, (0.6, ""))
    return page.select(
        "rec_id", "severity", "confidence", "has_more",
        F.col("position").cast("bigint").alias("position"),
        F.col("page_rank").cast("bigint").alias("page_rank"),
    )


@query(
    "articles_page",
    w("custs", "SELECT article_id, row_number() OVER (ORDER BY created_at DESC, article_id) - 1 AS position "
      "FROM custs ORDER BY created_at DESC, article_id LIMIT 20"),
)
def _articles_page(spark, sf):
    return rank.articles_page(i.customer_articles(spark, sf)).select(
        "article_id", F.col("position").cast("bigint").alias("position")
    )


@query(
    "runs_page",
    w("runs", "SELECT run_id, status FROM runs WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' "
      "ORDER BY created_at DESC, run_id LIMIT 20"),
)
def _runs_page(spark, sf):
    import datetime

    start = (datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc), "")
    runs = i.event_runs(spark, sf)
    return rank.runs_page(runs.drop("configuration"), 20, start).select("run_id", "status")


@query("tasks_page", w("tasks", "SELECT task_id, status FROM tasks WHERE task_id > '5' ORDER BY task_id LIMIT 100"))
def _tasks_page(spark, sf):
    return rank.tasks_page(i.event_tasks(spark, sf), 100, ("5",)).select("task_id", "status")
