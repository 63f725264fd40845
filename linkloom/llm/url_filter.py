"""URL filters: rules, and a tree of path templates judged by labelled purity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import ascii_lower_col, register, table
from linkloom.session import cut_lineage

#: A segment (or its form with digits masked) stays in a template if so many
#: pages of the host have it at its depth, and at least this percentage of them.
MIN_SUPPORT, MIN_SHARE_PERCENT = 5, 2
#: Squared deviation (chi-square, one degree, 5 %) from which branches differ.
DIFFER = 3.841
#: Bad share, smoothed by one bad and one good page, from which a template is rejected.
REJECT_PERCENT = 60
WILD = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(after, F.lit(""))
    return ascii_lower_col(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls if none does.

    ``rules`` is a short list, planned as one expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def masked(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def _token(depth: Column, segment: Column) -> Column:
    return F.concat(depth.cast("string"), F.lit("/"), segment)


def constant_tokens(urls: DataFrame) -> DataFrame:
    """``(host, tokens)``: depth and value of the segments that are no variables.

    At most 50 values reach the share at a depth, so the list of a host is
    bounded by its depth. Counts are combined before the shuffle; what is
    counted once per value never meets in one place.
    """
    segments = urls.select("host", F.posexplode(F.split("path", "/")).alias("depth", "segment"))
    forms = segments.select("host", "depth", F.explode(F.array_distinct(F.array("segment", masked(F.col("segment"))))).alias("form"))
    counts = forms.groupBy("host", "depth", "form").agg(F.count("*").alias("n"))
    totals = segments.groupBy("host", "depth").agg(F.count("*").alias("all"))
    often = counts.where(F.col("n") >= MIN_SUPPORT).join(totals, ["host", "depth"])
    often = often.where(F.col("n") * 100 >= F.col("all") * MIN_SHARE_PERCENT)
    return often.groupBy("host").agg(F.collect_set(_token(F.col("depth"), F.col("form"))).alias("tokens"))


def template(path: Column, tokens: Column) -> Column:
    """Segments of ``path``: as they are, with digits masked, or a wildcard."""

    def general(s: Column, i: Column) -> Column:
        m = masked(s)
        kept = lambda x: F.coalesce(F.array_contains(tokens, _token(i, x)), F.lit(False))
        return F.when(kept(s), s).when(kept(m), m).otherwise(F.lit(WILD))

    return F.transform(F.split(path, "/"), general)


def beginnings(segments: Column) -> Column:
    """Hashes of the beginnings of a template, each with the one above it. A hash is made
    of the one above and the next segment, so the work is in proportion to the depth."""
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<struct<own:bigint,above:bigint>>").alias("all"))

    def grow(a: Column, s: Column) -> Column:
        h = F.xxhash64(a["last"], s)
        return F.struct(h.alias("last"), F.concat(a["all"], F.array(F.struct(h.alias("own"), a["last"].alias("above")))).alias("all"))

    return F.aggregate(segments, start, grow)["all"]


def judged_templates(counts: DataFrame) -> DataFrame:
    """``(host, template, branch, block)`` from ``(host, template, n, bad)``, the
    labelled and the bad pages of each template.

    Nodes of a host's tree are the prefixes of its templates. A node whose bad
    share differs from that of its parent's other pages begins a branch of its
    own; one that doesn't is merged into its parent's branch. A template belongs
    to its deepest own branch (else to the host's), and a branch is rejected by
    the smoothed share of its pages.
    """
    below = F.posexplode(beginnings(F.col("template"))).alias("at", "node")
    spots = counts.select("host", "template", "n", "bad", below).withColumn("depth", F.col("at") + 1)
    nodes = spots.groupBy("host", "depth", F.col("node.own").alias("node"), F.col("node.above").alias("parent")).agg(
        F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")
    )
    nodes = cut_lineage(nodes, "url-nodes")
    above = nodes.select("host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    n, bad, pn, pbad = (F.col(c) for c in ("n", "bad", "pn", "pbad"))
    cross = bad * (pn - n) - (pbad - bad) * n
    own = (
        nodes.join(above, ["host", "depth", "parent"])
        .where(cross * cross * pn > F.lit(DIFFER) * n * (pn - n) * pbad * (pn - pbad))
        .select("host", "depth", "node")
    )
    found = spots.select("host", "template", "n", "bad", "depth", F.col("node.own").alias("node")).join(own.withColumn("own", F.lit(True)), ["host", "depth", "node"], "left")
    deepest = F.max(F.when(F.col("own"), F.col("depth")))
    placed = found.groupBy("host", "template").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.coalesce(deepest, F.lit(0)).alias("deepest"))
    branch = F.array_join(F.slice("template", F.lit(1), F.col("deepest")), "/")
    placed = placed.select("host", "template", "n", "bad", branch.alias("branch"))
    placed = cut_lineage(placed, "url-placed")
    totals = placed.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    verdicts = totals.select("host", "branch", ((F.col("bad") + 1) * 100 >= (F.col("n") + 2) * REJECT_PERCENT).alias("block"))
    return placed.select("host", "template", "branch").join(verdicts, ["host", "branch"])


def judge(pages: DataFrame, bad: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template)``, one row for each row of ``pages``.

    ``pages``: ``page_id``, ``url``; ``bad``: ``(page_key, bad)`` with 0 or 1 for
    the pages whose label is known, where a page's key is the last number in its
    path. Null and odd urls have an empty host and path and are judged like a
    host of that name. Null labels are left out; a key with several labels counts
    as bad when most of them are. A page without label only follows.
    """
    host, path = split_url(F.col("url"))
    key = F.regexp_extract("path", "^.*?([0-9]{1,18})[^0-9]*$", 1)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("page_key", F.when(key != "", key.cast("bigint")))
    tokens = cut_lineage(constant_tokens(urls), "url-tokens")
    known = (
        bad.where("page_key IS NOT NULL AND bad IS NOT NULL")
        .groupBy("page_key")
        .agg((F.sum("bad") * 2 > F.count("*")).cast("bigint").alias("bad"))
    )
    marked = urls.join(tokens, "host", "left").select("page_id", "host", "path", "page_key", template(F.col("path"), F.col("tokens")).alias("template"))
    marked = cut_lineage(marked, "url-templates")
    counts = marked.join(known, "page_key", "left").groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    verdicts = judged_templates(cut_lineage(counts, "url-counts")).select("host", "template", "block")
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    return marked.join(verdicts, ["host", "template"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(F.col("block"), "block").otherwise("allow")).alias("verdict"),
        F.array_join("template", "/").alias("template"),
    )


def _oracle() -> str:
    rule = "CAST(NULL AS VARCHAR)"
    ruled = "CAST(NULL AS VARCHAR)"
    for r in sorted(RULES, key=lambda r: (len(r.text), r.text)):
        fits = f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')"
        rule, ruled = f"CASE WHEN {fits} THEN '{r.text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {ruled} END"
    return f"""
WITH s AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
k AS (SELECT *, string_split(path, '/') AS parts, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS page_key FROM u),
seg AS (SELECT host, unnest(range(0, len(parts))) AS depth, unnest(parts) AS segment FROM k),
forms AS (
  SELECT host, depth, segment AS form FROM seg
  UNION ALL SELECT host, depth, regexp_replace(segment, '[0-9]+', '#', 'g') FROM seg
    WHERE regexp_replace(segment, '[0-9]+', '#', 'g') <> segment),
totals AS (SELECT host, depth, count(*) AS a FROM seg GROUP BY ALL),
often AS (SELECT host, depth, form, count(*) AS n FROM forms GROUP BY ALL HAVING n >= {MIN_SUPPORT}),
tokens AS (
  SELECT host, list(depth || '/' || form) AS tokens FROM often JOIN totals USING (host, depth)
  WHERE n * 100 >= a * {MIN_SHARE_PERCENT} GROUP BY host),
m AS (
  SELECT page_id, host, path, page_key, list_transform(parts, lambda x, i:
    CASE WHEN list_contains(tokens, (i - 1) || '/' || x) THEN x
      WHEN list_contains(tokens, (i - 1) || '/' || regexp_replace(x, '[0-9]+', '#', 'g')) THEN regexp_replace(x, '[0-9]+', '#', 'g')
      ELSE '{WILD}' END) AS template
  FROM k LEFT JOIN tokens USING (host)),
known AS (SELECT doc_id AS page_key, CAST(sum(1 - quality) * 2 > count(*) AS BIGINT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT host, template, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN known USING (page_key) GROUP BY host, template),
spots AS (
  SELECT host, template, n, bad, d AS depth, array_to_string(template[1:d], '/') AS node, array_to_string(template[1:d - 1], '/') AS parent
  FROM (SELECT *, unnest(range(1, len(template) + 1)) AS d FROM c)),
nodes AS (SELECT host, depth, node, parent, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM spots GROUP BY ALL),
own AS (
  SELECT x.host, x.depth, x.node FROM nodes x JOIN nodes y ON x.host = y.host AND x.depth = y.depth + 1 AND x.parent = y.node
  WHERE pow(x.bad * (y.n - x.n) - (y.bad - x.bad) * x.n, 2) * y.n > {DIFFER} * x.n * (y.n - x.n) * y.bad * (y.n - y.bad)),
placed AS (
  SELECT s.host, s.template, any_value(s.n) AS n, any_value(s.bad) AS bad,
    coalesce(max_by(own.node, own.depth), '') AS branch
  FROM spots s LEFT JOIN own ON s.host = own.host AND s.depth = own.depth AND s.node = own.node GROUP BY s.host, s.template),
verdicts AS (SELECT host, branch, (sum(bad) + 1) * 100 >= (sum(n) + 2) * {REJECT_PERCENT} AS block FROM placed GROUP BY host, branch),
j AS (
  SELECT m.*, {rule} AS rule, {ruled} AS ruled, block
  FROM m JOIN placed USING (host, template) JOIN verdicts USING (host, branch))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN block THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(template, '/') AS template FROM j
"""


@register("op2_url_filters", _oracle())
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; labels are those of the documents that paths name."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_key"), (1 - F.col("quality")).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)
