"""Which phrase occurs in which body: guards, exact phrase join, budget.

Matching runs on distinct bodies and distinct phrases, so a group of copies is
matched once however large it is; hits are handed to the individual articles
afterwards, per source and bounded by the source's own budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls
from linkloom.functions.let import let
from linkloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------
MIN_SOURCE_WORDS = 50
MIN_DISTINCTIVE_WORDS = 3
DEFAULT_MAX_NEW = 10
# ----------------------------------------------------------------------------


def reachable(status: Column) -> Column:
    return status.isNull() | (status < 400)


def source_guards(sources: DataFrame) -> DataFrame:
    """Sources worth analysing: reachable, long enough, with a body, and in a
    project of at least two articles.

    An empty body is told by its hash where there is one, so that steps which
    need no text do not read the body column.
    """
    if "body_hash" in sources.columns:
        filled = F.col("body_hash") != tx.content_hash(F.lit(""))
    else:
        filled = F.col("body") != ""
    sizes = sources.groupBy("project_id").agg(F.count("*").alias("_articles"))
    return (
        sources.join(sizes.filter(F.col("_articles") >= 2), "project_id", "left_semi")
        .filter(reachable(F.col("http_status")))
        .filter(F.col("word_count") >= MIN_SOURCE_WORDS)
        .filter(filled)
    )


def eligible_targets(targets: DataFrame) -> DataFrame:
    """The part of the target guard that does not depend on the source."""
    return targets.filter(~F.coalesce(F.col("noindex"), F.lit(False))).filter(
        reachable(F.col("http_status"))
    )


def target_guards(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs (project_id, source_id, target_id) without self, noindex, error
    and already linked targets."""
    open_targets = eligible_targets(articles).select(
        "project_id", F.col("article_id").alias("target_id")
    )
    kept = pairs.filter(F.col("source_id") != F.col("target_id")).join(
        open_targets, ["project_id", "target_id"], "left_semi"
    )
    return already_linked(kept, articles)


def link_key(url: Column) -> Column:
    """The URL under which an article is compared with existing links."""
    return urls.normalize_link_url(url, url)


def linked_urls(existing_links: Column, base: Column) -> Column:
    """Distinct normalised link targets of a page; empty when it has none."""
    keys = urls.normalize_link_urls(F.transform(existing_links, lambda x: x["href"]), base)
    return F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))


def already_linked(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs (project_id, source_id, target_id) whose link does not exist yet."""
    # Links become rows first: the filters that Spark infers for a generator and for a
    # join's key would normalise all links once more each.
    pages = articles.filter(F.col("url").isNotNull()).select(
        "project_id",
        F.col("article_id").alias("source_id"),
        urls.base_parts(F.col("url")).alias("_base"),
        F.transform("existing_links", lambda x: x["href"]).alias("_hrefs"),
    )
    links = pages.select(
        "project_id", "source_id", "_base", F.explode("_hrefs").alias("_href")
    ).filter(F.col("_href").isNotNull())
    key = urls.link_key(F.col("_href"), F.col("_base"))
    # Never null here; the planner is told so.
    edges = links.select(
        "project_id", "source_id", F.coalesce(key, F.lit("")).alias("_key")
    )
    keys = articles.select(
        "project_id", F.col("article_id").alias("target_id"), link_key(F.col("url")).alias("_key")
    )
    return (
        pairs.join(keys, ["project_id", "target_id"])
        .join(edges, ["project_id", "source_id", "_key"], "left_anti")
        .drop("_key")
    )


def title_guards(targets: DataFrame) -> DataFrame:
    """Targets whose title can serve as a phrase; adds phrase and anchor.

    ``phrase`` is what is searched (lower-cased title without prefix),
    ``anchor_text`` what is shown.
    """
    stripped = tx.strip_title_prefix(F.col("title"))
    return (
        targets.withColumn("_stripped", stripped)
        .filter(F.size(tx.distinctive_words(F.col("_stripped"))) >= MIN_DISTINCTIVE_WORDS)
        .withColumn("anchor_text", tx.sanitize_anchor(F.col("_stripped")))
        .filter((F.col("anchor_text") != "") & ~tx.is_generic_anchor(F.col("anchor_text")))
        .withColumn("phrase", F.lower(F.col("_stripped")))
        .drop("_stripped")
    )


# --- distinct bodies -----------------------------------------------------------


def body_groups(sources: DataFrame) -> DataFrame:
    """(project_id, body_hash) -> body_id, the first article with that body.

    Only ids and hashes are shuffled, pre-aggregated in each task.
    """
    return sources.groupBy("project_id", "body_hash").agg(F.min("article_id").alias("body_id"))


def distinct_bodies(sources: DataFrame) -> DataFrame:
    """One (project_id, body_id, body) row per distinct body."""
    return (
        sources.select("project_id", F.col("article_id").alias("body_id"), "body")
        .join(
            body_groups(sources).select("project_id", "body_id"),
            ["project_id", "body_id"],
            "left_semi",
        )
    )


def distinct_phrases(targets: DataFrame) -> DataFrame:
    return targets.select("project_id", "phrase").distinct()


# --- exact ---------------------------------------------------------------------


def _block_keys(lowered: Column) -> Column:
    """Hashes of every inner token with the characters next to it.

    Where a phrase of three or more tokens occurs in a body, each inner token
    stands there as a whole token, the token before it ends and the token after
    it starts with the same character. So phrase keys are body keys, and an
    equi-join on one of them loses no occurrence.
    """
    tokens = F.filter(tx.split_blank(lowered), lambda t: t != "")

    def build(ts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(2), F.size(ts) - 1),
            lambda i: F.xxhash64(
                F.substring(F.element_at(ts, i - 1), -1, 1),
                F.element_at(ts, i),
                F.substring(F.element_at(ts, i + 1), 1, 1),
            ),
        )

    return let(
        tokens, lambda ts: F.when(F.size(ts) >= 3, F.array_distinct(build(ts)))
    )


def phrase_hits(bodies: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact, case-insensitive occurrences of phrases in bodies of the project.

    ``bodies``: project_id, body_id, body. ``phrases``: project_id, phrase (of
    at least three words). Returns project_id, body_id, phrase, offset,
    context. Each phrase is looked up through its rarest key; candidates are
    verified against the whole body.
    """
    body_keys = bodies.select(
        "project_id", "body_id", F.explode(_block_keys(F.lower(F.col("body")))).alias("_key")
    )
    phrase_keys = phrases.select(
        "project_id", "phrase", F.explode(_block_keys(F.col("phrase"))).alias("_key")
    )
    wanted = phrase_keys.select("project_id", "_key").distinct()
    # The inverted index: made in one pass over the bodies, read by both steps below.
    index = cut_lineage(body_keys.join(wanted, ["project_id", "_key"], "left_semi"), "body-keys")
    frequency = index.groupBy("project_id", "_key").agg(F.count("*").alias("_bodies"))
    # A phrase with a key found in no body cannot occur at all.
    rarest = (
        phrase_keys.join(frequency, ["project_id", "_key"], "left")
        .withColumn("_bodies", F.coalesce("_bodies", F.lit(0)))
        .groupBy("project_id", "phrase")
        .agg(F.min(F.struct("_bodies", "_key")).alias("_best"))
        .filter(F.col("_best._bodies") > 0)
        .select("project_id", "phrase", F.col("_best._key").alias("_key"))
    )
    candidates = index.join(rarest, ["project_id", "_key"]).select(
        "project_id", "body_id", "phrase"
    )
    lowered = bodies.withColumn("_lower", F.lower(F.col("body")))
    return (
        candidates.join(lowered, ["project_id", "body_id"])
        .withColumn("offset", (F.position(F.col("phrase"), F.col("_lower")) - 1).cast("int"))
        .filter(F.col("offset") >= 0)
        .select(
            "project_id",
            "body_id",
            "phrase",
            "offset",
            tx.context_at(F.col("body"), F.col("offset"), F.length("phrase")).alias("context"),
        )
    )


# --- from hits to pairs ----------------------------------------------------------


def limit_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every key.

    Spark cuts each input partition to ``n`` rows per key before the shuffle
    while ``n`` is below its group-limit threshold; beyond it a salted first
    pass does the same, so no key's rows ever meet in one task uncut.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        salted = df.withColumn("_salt", F.spark_partition_id())
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= n)
        df = df.drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def phrase_members(targets: DataFrame, max_new: int, max_links: int) -> DataFrame:
    """Per phrase the targets any source could still need, first ids first.

    A source skips itself and the targets it already links to, so of one
    phrase it can use at most ``max_new + 1`` targets per address and
    ``max_new + 1 + links`` addresses. Later members can never be picked: the
    lists stay short although the selection is complete.
    """
    keyed = targets.select(
        "project_id", "phrase", "target_id", link_key(F.col("target_url")).alias("_key")
    )
    first = limit_per_key(
        keyed, ["project_id", "phrase", "_key"], [F.col("target_id")], max_new + 1
    )
    by_address = first.groupBy("project_id", "phrase", "_key").agg(
        F.array_sort(F.collect_list("target_id")).alias("_ids")
    )
    addresses = limit_per_key(
        by_address, ["project_id", "phrase"], [F.col("_ids")[0], F.col("_key")],
        max_new + 1 + max_links,
    )
    return addresses.groupBy("project_id", "phrase").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_ids")[0].alias("first_id"),
                    F.col("_key").alias("key"),
                    F.col("_ids").alias("ids"),
                )
            )
        ).alias("_members")
    )


def most_links(sources: DataFrame) -> int:
    """The largest number of existing links on one page (one scalar)."""
    row = sources.agg(F.max(F.size(F.coalesce("existing_links", F.array())))).first()
    return max(row[0] or 0, 0)


def keyword_budget(
    hits: DataFrame, sources: DataFrame, targets: DataFrame, max_new: int = DEFAULT_MAX_NEW
) -> DataFrame:
    """Phrase hits as (source, target) pairs: the first ``max_new`` eligible
    targets of each source, in target id order.

    ``hits``: project_id, body_id, phrase, offset, context, confidence.
    ``sources``: articles with body_hash, url and existing_links. ``targets``:
    title-guarded targets with target_id and target_url.
    """
    members = phrase_members(targets, max_new, most_links(sources))
    owned = sources.select(
        "project_id",
        F.col("article_id").alias("source_id"),
        "body_hash",
        linked_urls(F.col("existing_links"), F.col("url")).alias("_linked"),
    ).join(body_groups(sources), ["project_id", "body_hash"])
    pairs = (
        hits.join(members, ["project_id", "phrase"])
        .join(owned, ["project_id", "body_id"])
        .select(
            "project_id",
            "source_id",
            "phrase",
            "offset",
            "context",
            "confidence",
            "_linked",
            F.explode(F.slice(F.col("_members"), F.lit(1), max_new + 1 + F.size("_linked"))).alias("_m"),
        )
        .filter(~F.array_contains("_linked", F.col("_m.key")))
        .select(
            "project_id",
            "source_id",
            "phrase",
            "offset",
            "context",
            "confidence",
            F.explode("_m.ids").alias("target_id"),
        )
        .filter(F.col("source_id") != F.col("target_id"))
    )
    return limit_per_key(
        pairs, ["project_id", "source_id"], [F.col("target_id")], max_new
    )


def keyword_exact(sources: DataFrame, targets: DataFrame, max_new: int = DEFAULT_MAX_NEW) -> DataFrame:
    """Exact phrase matches under the page budget: guarded sources x targets."""
    hits = phrase_hits(distinct_bodies(sources), distinct_phrases(targets)).withColumn(
        "confidence", F.lit(1.0)
    )
    return keyword_budget(hits, sources, targets, max_new)
