"""Benchmark decontamination: windows of test items looked up in documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import PLAIN_WORD, annotate, ascii_lower, ascii_lower_col, register, table
from linkloom.session import cut_lineage

WINDOW = 10
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of windows that one broadcast holds; more windows take more passes.
BLOCK_CHARS = 32_000_000

Windows = dict[str, list]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(win, items)``: each distinct window (words joined by blanks) and its item ids.

    Items without words have none; one of fewer than ten words is one window.
    Needs ``item_id`` and ``text``. A null item_id gives windows without an id.
    """
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        F.regexp_extract_all(ascii_lower_col(F.col("text")), F.lit(WORDS_SQL), F.lit(0)).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW - 1)))
    text = F.transform(starts, lambda i: F.array_join(F.slice("words", i, WINDOW), " "))
    return words.select("item", F.explode(text).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def _finder(windows: Windows) -> Callable[[list[str]], tuple[list[tuple[int, int]], set]]:
    """From words to the spans and item ids of the windows that occur in them.

    The first two words of a window are looked up at every place, the whole
    window only where they fit.
    """
    singles = {w for w in windows if " " not in w}
    heads: dict[tuple[str, str], set[int]] = {}
    for w in windows:
        parts = w.split(" ")
        if len(parts) > 1:
            heads.setdefault((parts[0], parts[1]), set()).add(len(parts))

    def find(words: list[str]) -> tuple[list[tuple[int, int]], set]:
        spans, items = [], set()
        if singles:
            for i, w in enumerate(words):
                if w in singles:
                    spans.append((i, i + 1))
                    items.update(windows[w])
        for i in [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in heads]:
            for n in heads[words[i], words[i + 1]]:
                found = windows.get(" ".join(words[i : i + n])) if i + n <= len(words) else None
                if found is not None:
                    spans.append((i, i + n))
                    items.update(found)
        return spans, items

    return find


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row`` (the carried columns), ``n_words``, ``spans`` (word positions inside
    any occurrence of a window, end exclusive, merged) and ``items`` (sorted ids).

    The windows are a set that each worker holds, broadcast only after their size
    was measured: beyond ``block_chars`` they are split by hash and documents are
    read once for each part, with a written table between; spans and ids add up.
    Documents are never shuffled. Null text has no words. An empty benchmark hits
    nothing. Repeated documents and items are each handled by themselves.
    """
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(benchmark), "windows")
    chars = windows.agg(F.sum(F.length("win") + F.coalesce(F.length(F.array_join("items", ",")), F.lit(0)))).first()[0]
    parts = max(1, -(-(chars or 0) // block_chars))
    done = None
    for k in range(parts):
        part = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == k)
        held = spark.sparkContext.broadcast({r.win: r["items"] for r in part.collect()})
        if done is None:
            done = annotate(docs, "text", [*carry] if parts == 1 else [*dict.fromkeys([*carry, "text"])], _scanner(held), "n_words long, spans array<array<int>>, items array<string>")
            if parts > 1:
                done = cut_lineage(done, "scanned")
            continue
        flat = done.select("row", "n_words", "spans", "items", F.col("row.text").alias("text"))
        more = annotate(flat, "text", ["row", "n_words", "spans", "items"], _scanner(held), "n_words long, spans array<array<int>>, items array<string>")
        done = cut_lineage(
            more.select(
                "row.row", "row.n_words",
                F.concat("row.spans", "spans").alias("spans"),
                F.array_union("row.items", "items").alias("items"),
            ),
            "scanned",
        )
    if parts > 1:
        kept = F.struct(*[F.col(f"row.`{c}`") for c in carry]) if carry else F.col("row")
        done = done.select(kept.alias("row"), "n_words", _merged("spans").alias("spans"), F.array_sort("items").alias("items"))
    return done


def _merged(spans: str):
    """``merged`` as a fold, for what several passes found."""
    def grow(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.array(last[0], F.greatest(last[1], s[1]))),
        )
        return F.when((F.size(out) > 0) & (s[0] <= F.get(F.get(out, F.size(out) - 1), F.lit(1))), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), grow)


def _scanner(held):
    state: list = []

    def run(texts: list) -> list[list]:
        if not state:
            state.append(_finder(held.value))
        n, spans, items = [], [], []
        for text in texts:
            words = PLAIN_WORD.findall(ascii_lower(text or ""))
            s, i = state[0](words)
            n.append(len(words))
            spans.append(merged(s))
            items.append(sorted(i))
        return [n, spans, items]

    return run


def without_spans(text: str | None, spans: list) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if not text or not spans:
        return text
    at = [m.span() for m in PLAIN_WORD.finditer(ascii_lower(text))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without what the benchmark holds; columns stay.

    ``remove="documents"`` drops every document with a hit, ``"spans"`` cuts the
    hit words and what stands between them out of the text.
    """
    found = scan(docs, benchmark, docs.columns)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = F.udf(without_spans, "string", useArrow=True)
    hit = F.size("spans") > 0
    columns = [F.when(hit, cut("row.text", "spans")).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


ORACLE = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS words
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS k,
    array_to_string(list_slice(words, p, p + {WINDOW - 1}), ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - {WINDOW - 1}) + 1)) AS p FROM items WHERE len(words) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}'), []) AS words
  FROM documents),
spots AS (
  SELECT doc_id, p, k, array_to_string(list_slice(words, p, p + k - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM docs), (SELECT DISTINCT k FROM wins) WHERE p + k - 1 <= len(words)),
found AS (SELECT doc_id, p, spots.k, item_id FROM spots JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@register("op6_benchmark_decontamination", ORACLE)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
