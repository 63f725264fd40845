"""Robots rules and address safety, over supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import scoring, urls
from linkloom.functions import text as tx
from linkloom.session import cut_lineage


def robots_rules(robots: DataFrame) -> DataFrame:
    """Robots files (domain, robots_txt) as groups.

    Returns domain, group_id, agents, crawl_delay and rules
    (array<struct<path, allow, ord>>). Lines of one file are numbered and a
    running sum starts a group at each user-agent line that follows a rule; a
    window never spans more than one file.
    """
    lines = robots.select("domain", F.posexplode(F.split("robots_txt", "\n")).alias("pos", "_raw"))
    bare = lines.withColumn("_line", tx.trim_blank(F.regexp_replace("_raw", "(?s)#.*$", "")))
    parts = bare.filter(F.contains("_line", F.lit(":"))).select(
        "domain",
        "pos",
        F.lower(tx.trim_blank(F.regexp_extract("_line", "^([^:]*):", 1))).alias("directive"),
        tx.trim_blank(F.regexp_extract("_line", "(?s)^[^:]*:(.*)$", 1)).alias("value"),
    )
    kind = (
        F.when(F.col("directive") == "user-agent", "agent")
        .when(F.col("directive").isin("allow", "disallow") & (F.col("value") != ""), "rule")
        .when(F.col("directive") == "crawl-delay", "delay")
    )
    rows = parts.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    before = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    previous = F.last(
        F.when(F.col("kind") != "delay", F.col("kind")), ignorenulls=True
    ).over(before)
    starts = (F.col("kind") == "agent") & (previous.isNull() | (previous == "rule"))
    delay = F.regexp_extract("value", r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    grouped = (
        rows.withColumn("_starts", starts.cast("int"))
        .withColumn("group_id", F.sum("_starts").over(upto).cast("int"))
        .filter(F.col("group_id") > 0)
        .withColumn("_delay", F.when((F.col("kind") == "delay") & (delay > 0), delay))
    )
    is_rule, is_agent = F.col("kind") == "rule", F.col("kind") == "agent"
    rule = F.struct(
        F.col("pos").alias("ord"),
        F.col("value").alias("path"),
        (F.col("directive") == "allow").alias("allow"),
    )
    return grouped.groupBy("domain", "group_id").agg(
        F.array_sort(F.collect_set(F.when(is_agent, F.lower("value")))).alias("agents"),
        F.max_by("_delay", F.when(F.col("_delay").isNotNull(), F.col("pos"))).alias("crawl_delay"),
        F.array_sort(F.collect_list(F.when(is_rule, rule))).alias("rules"),
    )


def robots_allowed(url_rows: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds allowed and crawl_delay to URL rows.

    The first group naming the agent applies, else the first for ``*``; the
    longest matching path decides, the first on ties. Rules are an index by domain
    and path: a URL path asks it for its beginnings of the lengths that the domain's
    rules have, in an equi-join, so a domain with very many rules is no walk for each
    URL. Each distinct (domain, path) is asked once.
    """
    exact = F.array_contains("agents", agent.lower())
    star = F.array_contains("agents", "*")
    chosen = (
        rules.filter(exact | star)
        .groupBy("domain")
        .agg(
            F.min_by(
                F.struct("rules", "crawl_delay"),
                F.struct(F.when(exact, 0).otherwise(1), F.col("group_id")),
            ).alias("_group")
        )
        .select(
            F.col("domain").alias("_domain"),
            F.col("_group.rules").alias("_rules"),
            F.col("_group.crawl_delay").alias("crawl_delay"),
            F.array_distinct(F.transform("_group.rules", lambda r: F.length(r["path"]))).alias("_lengths"),
        )
    )
    chosen = cut_lineage(chosen, "robots-groups")
    index = (
        chosen.select("_domain", F.explode("_rules").alias("_r"))
        .groupBy("_domain", F.col("_r.path").alias("_beginning"))
        .agg(F.min(F.struct("_r.ord", "_r.allow")).alias("_first"))
    )
    asked = url_rows.withColumns({"_domain": urls.host_of(F.col("url")), "_path": urls.path_of(F.col("url"))})
    paths = asked.select("_domain", "_path").distinct().join(chosen.select("_domain", "_lengths"), "_domain")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    decided = (
        paths.select("_domain", "_path", F.explode(F.transform(fitting, lambda n: F.substring("_path", F.lit(1), n))).alias("_beginning"))
        .join(index, ["_domain", "_beginning"])
        .groupBy("_domain", "_path")
        .agg(F.max(F.struct(F.length("_beginning").alias("n"), (-F.col("_first.ord")).alias("o"), F.col("_first.allow").alias("allow"))).alias("_best"))
        .select("_domain", "_path", F.col("_best.allow").alias("allowed"))
    )
    return (
        asked.join(chosen.select("_domain", "crawl_delay"), "_domain", "left")
        .join(decided, ["_domain", "_path"], "left")
        .select(*url_rows.columns, F.coalesce("allowed", F.lit(True)).alias("allowed"), "crawl_delay")
    )


def url_safety(url_rows: DataFrame, dns: DataFrame) -> DataFrame:
    """Adds safe, resolved_ip and reason: http(s) only, host known, and every
    address of the host public. ``dns``: host, ip and optionally ord."""
    order = F.col("ord") if "ord" in dns.columns else F.col("ip")
    hosts = dns.groupBy(F.lower("host").alias("_host")).agg(
        F.min_by("ip", order).alias("_first"),
        F.min_by(
            F.when(scoring.is_private_ip(F.col("ip")), F.col("ip")),
            F.when(scoring.is_private_ip(F.col("ip")), order),
        ).alias("_private"),
    )
    scheme = urls.scheme_of(F.col("url"))
    reason = (
        F.when(~urls.is_url(F.col("url")), "Invalid URL")
        .when(
            ~scheme.isin("http", "https"),
            F.concat(F.lit("Unsupported scheme: "), scheme, F.lit(":")),
        )
        .when(
            F.col("_first").isNull(),
            F.concat(F.lit("DNS returned no addresses for "), F.col("_host")),
        )
        .when(
            F.col("_private").isNotNull(),
            F.concat(F.lit("Resolved to private IP: "), F.col("_private")),
        )
    )
    return (
        url_rows.withColumn("_host", urls.host_of(F.col("url")))
        .join(hosts, "_host", "left")
        .withColumn("reason", reason)
        .withColumn("safe", F.col("reason").isNull())
        .withColumn("resolved_ip", F.when(F.col("safe"), F.col("_first")))
        .drop("_host", "_first", "_private")
    )
