"""Quality rules: repeated stretches of a text, found with a suffix array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import BLANK_WORD, annotate, register, table

#: Repeats of at least so many words count as covered text.
MIN_REPEAT = 8
#: Rejected beyond this share of covered words, or a longer single repeat.
MAX_COVERED_PERCENT = 30
MAX_REPEAT_WORDS = 100
MIN_WORDS = 50
MAX_WINDOW_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def repeat_lengths(words: list[str]) -> np.ndarray:
    """For each position, the longest stretch from there that the text holds twice.

    Prefix doubling sorts the suffixes; the ranks of each round are kept. Ranks
    of round k are equal for two suffixes just when their first 2**k words are,
    so the common prefix of neighbours in the suffix array is read off the
    rounds from the last to the first. A position's longest repeat is the larger
    common prefix with its two neighbours: those are the intervals of the
    longest-common-prefix array, whose spans make up all maximal repeats.
    """
    n = len(words)
    ids: dict[str, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    best = np.zeros(n, dtype=np.int64)
    if n < 2 or len(ids) == n:
        return best
    rounds, width, distinct = [rank], 1, len(ids)
    while distinct < n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        values, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        distinct = len(values)
        rounds.append(rank)
        width *= 2
    order = np.argsort(rank)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        a, b = left + common, right + common
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[rounds[k][a[inside]] == rounds[k][b[inside]]]
        common[same] += 1 << k
    best[left] = common
    best[right] = np.maximum(best[right], common)
    return best


def union_size(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Positions covered by the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The fields of ``MEASURES`` for one text; null counts as empty."""
    text = text or ""
    words = BLANK_WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup_lines += line in seen
            seen.add(line)
    lengths = repeat_lengths(words)
    triple = np.flatnonzero(lengths >= 3)
    repeated = union_size(triple, np.full(len(triple), 3), n) if len(triple) else 0
    long = np.flatnonzero(lengths >= MIN_REPEAT)
    covered = union_size(long, lengths[long], n) if len(long) else 0
    longest = int(lengths.max()) if n else 0
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_WINDOW_PERCENT * n
    repetitive = 100 * covered > MAX_COVERED_PERCENT * n or longest > MAX_REPEAT_WORDS
    symbols = sum(text.count(c) for c in SYMBOLS)
    return n, sum(map(len, words)), symbols, dup_lines, repeated, covered, longest, base_failed, not (base_failed or repetitive)


def _measures(texts: list) -> list[list]:
    return [list(column) for column in zip(*map(measure, texts), strict=True)] or [[] for _ in MEASURES.split(",")]


def quality_measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) and ``MEASURES`` for every row of ``docs``.

    A null or empty text has no words and fails. Each row is judged by itself, so
    repeated rows, null ids and columns of any name need nothing. The memory of a
    text is some dozen arrays of its number of words.
    """
    return annotate(docs, "text", carry, _measures, MEASURES)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return quality_measures(docs, docs.columns).where("kept").select("row.*")


ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w),
windows AS (
  SELECT doc_id, p, k, array_to_string(list_slice(words, p, p + k - 1), ' ') AS win
  FROM starts, (VALUES (3), ({MIN_REPEAT}), ({MAX_REPEAT_WORDS + 1})) AS sizes(k)
  WHERE p + k - 1 <= len(words)),
twice AS (
  SELECT doc_id, p, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, md5(win)) AS n FROM windows) WHERE n > 1),
hit AS (SELECT DISTINCT doc_id, k, unnest(range(p, p + k)) AS q FROM twice),
sums AS (
  SELECT doc_id, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = {MIN_REPEAT}) AS n8,
    count(*) FILTER (k = {MAX_REPEAT_WORDS + 1}) AS nl
  FROM hit GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(n3, 0)::BIGINT AS n_repeat_words,
    coalesce(n8, 0)::BIGINT AS n_covered_words, coalesce(nl, 0) > 0 AS long_repeat
  FROM w LEFT JOIN sums USING (doc_id) LEFT JOIN dups USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR 100 * n_covered_words > {MAX_COVERED_PERCENT} * n_words OR long_repeat) AS kept FROM b
"""


@register("op8_quality_rules", ORACLE)
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    found = quality_measures(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words",
        (F.col("longest_repeat") > MAX_REPEAT_WORDS).alias("long_repeat"), "base_failed", "kept",
    )
