"""The article table: upsert, change scope, embeddings, deletion.

Tables are immutable snapshots; every operator returns the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.functions import text as tx
from linkloom.operators.matching import limit_per_key

POLICIES = ("crawl", "upload", "push")
_CONTENT = (
    "title",
    "body",
    "body_hash",
    "title_hash",
    "word_count",
    "metadata",
    "source_type",
    "existing_links",
    "parse_warning",
)


def tenant_key(*tables: DataFrame, name: str = "article_id") -> list[str]:
    """The tenant and the id, as far as all tables name the tenant."""
    named = all("project_id" in t.columns for t in tables)
    return ["project_id", name] if named else [name]


def last_by_seq(incoming: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the last by ``seq``, or any of several alike ones.

    Without ``seq`` nothing says which of two different rows is the later one:
    then the job fails instead of losing one.
    """
    if "seq" in incoming.columns:
        return limit_per_key(incoming, key, [F.desc("seq")], 1)
    kinds = F.struct("body_hash", "title_hash")
    rest = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(
        F.first(F.struct(*rest)).alias("_row"), F.min(kinds).alias("_low"), F.max(kinds).alias("_high")
    )
    clash = F.raise_error(F.concat(F.lit("several versions without seq: "), F.col(key[-1])))
    alike = F.col("_low").eqNullSafe(F.col("_high"))
    return one.filter(F.when(alike, F.lit(True)).otherwise(clash.cast("boolean"))).select(
        *[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in incoming.columns]
    )


def upsert_articles(
    current: DataFrame, incoming: DataFrame, policy: str, now: Column | None = None
) -> DataFrame:
    """Next article snapshot plus ``action`` (created, updated, unchanged, kept).

    crawl always overwrites; upload skips an equal body; push skips an equal
    body and title. An overwrite clears the embedding. Push leaves the HTTP
    status alone. Of several incoming rows of one key the last by ``seq``
    counts; without that column they must be alike, or the job fails.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    now = F.current_timestamp() if now is None else now
    key = ["project_id", "url"]
    last = last_by_seq(incoming, key)
    missing = [c for c in current.columns if c not in last.columns]
    new = last.select(
        *key,
        F.struct(
            *[F.col(c) for c in current.columns if c not in missing and c not in key]
        ).alias("_new"),
    )
    old = current.select(
        *key, F.struct(*[F.col(c) for c in current.columns if c not in key]).alias("_old")
    )
    same_body = F.col("_old.body_hash") == F.col("_new.body_hash")
    same_title = F.col("_old.title_hash") == F.col("_new.title_hash")
    unchanged = {
        "crawl": F.lit(False),
        "upload": same_body,
        "push": same_body & same_title,
    }[policy]
    joined = old.join(new, key, "full_outer").withColumn(
        "action",
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), "kept")
        .when(unchanged, "unchanged")
        .otherwise("updated"),
    )
    written = F.col("action").isin("created", "updated")
    fields = {f.name: f.dataType for f in current.schema.fields}

    def value(name: str) -> Column:
        old_value = F.col(f"_old.{name}")
        if name == "article_id":
            return F.coalesce(old_value, F.col("_new.article_id"))
        if name in ("embedding", "embedding_model"):
            return F.when(~written, old_value)
        if name == "created_at":
            return F.coalesce(old_value, now)
        if name == "updated_at":
            return F.when(written, now).otherwise(old_value)
        if name == "http_status" and policy == "push":
            return old_value
        if name in missing:
            return old_value
        return F.when(written, F.col(f"_new.{name}")).otherwise(old_value)

    return joined.select(
        *[
            F.col(name) if name in key else value(name).cast(kind).alias(name)
            for name, kind in fields.items()
        ],
        "action",
    )


def change_scope(articles: DataFrame, last: DataFrame) -> DataFrame:
    """``change`` per article: new, changed or unchanged since the last run.

    ``last``: article_id and the hashes known then. An id without hashes counts
    as unchanged.
    """
    key = tenant_key(articles, last)
    prev = last.select(
        *key,
        F.col("body_hash").alias("_body"),
        F.col("title_hash").alias("_title"),
        F.lit(True).alias("_known"),
    )
    differs = (F.col("_body") != F.col("body_hash")) | (F.col("_title") != F.col("title_hash"))
    return (
        articles.join(prev, key, "left")
        .withColumn(
            "change",
            F.when(F.col("_known").isNull(), "new")
            .when(
                F.col("_body").isNotNull() & F.col("_title").isNotNull() & differs, "changed"
            )
            .otherwise("unchanged"),
        )
        .drop("_body", "_title", "_known")
    )


def preserved_recs(recs: DataFrame, scope: DataFrame) -> DataFrame:
    """Reviewed recommendations that survive a re-run: accepted ones, and
    dismissed ones whose source did not change."""
    unchanged = scope.filter(F.col("change") == "unchanged").select(
        F.col("article_id").alias("source_id")
    )
    accepted = recs.filter(F.col("status") == "accepted")
    dismissed = recs.filter(F.col("status") == "dismissed").join(
        unchanged, "source_id", "left_semi"
    )
    return accepted.unionByName(dismissed)


def union_scope(scope: DataFrame) -> DataFrame:
    """Articles to analyse: the new and the changed ones."""
    return (
        scope.filter(F.col("change") == "new")
        .select("article_id")
        .unionByName(scope.filter(F.col("change") == "changed").select("article_id"))
    )


def delete_cascade(
    articles: DataFrame, recs: DataFrame, ids: DataFrame, runs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Articles and recommendations without the given ids.

    Refused while a run of one of the touched projects is pending or running.
    """
    gone = ids.select(F.col("article_id")).distinct()
    touched = articles.join(gone, "article_id", "left_semi").select("project_id").distinct()
    active = runs.filter(F.col("status").isin("pending", "running")).join(
        touched, "project_id", "left_semi"
    )
    if not active.isEmpty():
        raise RuntimeError("articles cannot be deleted while an analysis run is active")
    left = articles.join(gone, "article_id", "left_anti")
    kept = recs.join(gone.withColumnRenamed("article_id", "source_id"), "source_id", "left_anti")
    kept = kept.join(gone.withColumnRenamed("article_id", "target_id"), "target_id", "left_anti")
    return left, kept.select(recs.columns)


# --- embeddings ------------------------------------------------------------------


def embedding_cache_split(articles: DataFrame, hashes: DataFrame, model: str) -> DataFrame:
    """Adds ``cached``: vector present, same model, both hashes still current."""
    key = tenant_key(articles, hashes)
    now = hashes.select(
        *key,
        F.col("body_hash").alias("_body"),
        F.col("title_hash").alias("_title"),
    )
    hit = (
        F.col("has_embedding")
        & (F.col("embedding_model") == model)
        & (F.col("body_hash") == F.col("_body"))
        & (F.col("title_hash") == F.col("_title"))
    )
    return (
        articles.join(now, key, "left")
        .withColumn("cached", F.coalesce(hit, F.lit(False)))
        .drop("_body", "_title")
    )


def skip_empty_content(articles: DataFrame) -> DataFrame:
    return articles.filter(tx.has_content(F.col("title"), F.col("body")))


def embed_missing(
    articles: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    batch_size: int,
    dims: int = scoring.STORED_DIMENSIONS,
    skip_empty: bool = True,
) -> DataFrame:
    """article_id -> vector for articles without one (``cached`` false).

    ``embed`` runs inside the tasks on at most ``batch_size`` texts in input
    order; a wrong vector count fails the job. Articles of blanks only are left out
    unless ``skip_empty`` is false.
    """
    todo = articles.filter(~F.col("cached"))
    todo = (skip_empty_content(todo) if skip_empty else todo).select(
        F.col("article_id").cast("string").alias("article_id"),
        tx.embed_text(F.col("title"), F.col("body")).alias("_text"),
    )
    schema = pa.schema([("article_id", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), batch_size):
                part = texts[at : at + batch_size]
                vectors = embed(part)
                if len(vectors) != len(part):
                    raise ValueError(
                        f"embedding provider returned {len(vectors)} vectors for {len(part)} texts"
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(part)),
                        pa.array([list(v) for v in vectors], pa.list_(pa.float32())),
                    ],
                    schema=schema,
                )

    vectors = todo.mapInArrow(run, "article_id string, embedding array<float>")
    return vectors.withColumn("embedding", scoring.zero_pad(F.col("embedding"), dims))


def persist_embeddings(articles: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Article snapshot with new vectors filled in."""
    key = tenant_key(articles, vectors)
    new = vectors.select(*key, F.col("embedding").alias("_vector"))
    return (
        articles.join(new, key, "left")
        .withColumns(
            {
                "embedding": F.coalesce("_vector", "embedding"),
                "embedding_model": F.when(F.col("_vector").isNotNull(), F.lit(model)).otherwise(
                    F.col("embedding_model")
                ),
            }
        )
        .select(articles.columns)
    )


def invalidate_embeddings(articles: DataFrame, keys: DataFrame) -> DataFrame:
    """Clear vector and model; ``keys`` holds article_id or project_id rows."""
    by = "article_id" if "article_id" in keys.columns else "project_id"
    marks = keys.select(by).distinct().withColumn("_stale", F.lit(True))
    keep = F.col("_stale").isNull()
    return (
        articles.join(marks, by, "left")
        .withColumns(
            {
                "embedding": F.when(keep, F.col("embedding")),
                "embedding_model": F.when(keep, F.col("embedding_model")),
            }
        )
        .select(articles.columns)
    )
