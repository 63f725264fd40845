"""Spelling variant grouping: words one edit apart, through an index of variable-length grams.

Each position of a word gives one gram: three characters, and more while what it
has so far is frequent in the vocabulary. An edit changes only the grams over it;
their greatest number is a word's bound. Two near words share all grams but those,
so merging the lists of a few of the first grams (in one order for all words) meets
every near pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import ascii_lower, register, small_batches, table
from linkloom.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT = 5, 3
#: Shortest and longest gram. Grams found more often than a threshold are extended; the
#: threshold follows the vocabulary, so that at most so many grams are frequent (all
#: workers hold these), and is never under ``RARE``.
SHORT, LONG = 3, 6
MAX_FREQUENT, RARE = 200_000, 24
FLUSH = 300_000
#: A word is altered where this divides the hash of its document and itself.
ALTERED = 97
#: Ends of a word, so that its first and last letters are in as many grams as others.
HEAD, TAIL = "\x02", "\x03"


def _counts(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])


def _words(altered: bool):
    """Words of a partition with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = RUN.findall(ascii_lower(text or ""))
                counts.update(words)
                if not altered or doc_id is None:
                    continue
                seed = zlib.crc32(b"%d:" % doc_id)
                own = Counter(words)
                for word, h in zip(own, [zlib.crc32(w.encode(), seed) for w in own], strict=True):
                    if h % ALTERED == 0:
                        k = h % len(word)
                        counts[word] -= own[word]
                        counts[word[:k] + word[k + 1 :]] += own[word]
                if len(counts) > FLUSH:
                    yield _counts(counts, "word")
                    counts = Counter()
        yield _counts(counts, "word")

    return run


def vocabulary(docs: DataFrame, altered: bool = False) -> DataFrame:
    """``(word, n)``: words of at least five letters with at least three occurrences."""
    small_batches(docs.sparkSession)
    given = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    counts = given.mapInArrow(_words(altered), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT))


def _short_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All grams of a partition's words that can be a beginning of a longer one."""
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            text = f"{HEAD}{word}{TAIL}"
            counts.update(text[p : p + q] for q in range(SHORT, LONG) for p in range(len(text) - q + 1))
            if len(counts) > FLUSH:
                yield _counts(counts, "gram")
                counts = Counter()
    yield _counts(counts, "gram")


def frequent_grams(words: DataFrame, most: int = MAX_FREQUENT) -> dict[str, int]:
    """The gram dictionary, pruned by frequency: grams (with their counts) to extend.

    Words have ``p`` places for each length of gram; if more than ``p * lengths / most``
    of them are needed for a gram, at most ``most`` grams have so many.
    """
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(RARE, -(-places * (LONG - SHORT) // most))
    counts = words.select("word").mapInArrow(_short_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.where(F.col("n") > least).toLocalIterator()}


def grams(word: str, frequent: dict[str, int], longest: int = LONG) -> list[str]:
    """The gram of each position. It depends on its own characters alone."""
    text = f"{HEAD}{word}{TAIL}"
    out = []
    for p in range(len(text) - SHORT + 1):
        q = SHORT
        while q < longest and p + q < len(text) and text[p : p + q] in frequent:
            q += 1
        out.append(text[p : p + q])
    return out


def affected(parts: list[str]) -> int:
    """Most grams that one edit can change: the most over one character."""
    edge = [0] * (len(parts) + LONG + 1)
    for p, g in enumerate(parts):
        edge[p] += 1
        edge[p + len(g)] -= 1
    most = now = 0
    for step in edge:
        now += step
        most = max(most, now)
    return most


def indexed(word: str, frequent: dict[str, int]) -> list[tuple[int, str, int]]:
    """(scheme, gram, position) under which a word is listed.

    ``m`` grams and a bound of ``a``: near words share ``m - a`` grams at least, so one
    of the first ``a + 1``. Where no gram may be left, all are listed, which meets the
    words that have grams left; two such words meet through grams of three letters
    (scheme 1), of which an edit changes three and a word has five or more.
    """
    out = []
    for scheme, longest in ((0, LONG), (1, SHORT)):
        parts = grams(word, frequent, longest)
        bound = affected(parts)
        order = sorted(range(len(parts)), key=lambda p: (frequent.get(parts[p], 0), parts[p], p))
        out += [(scheme, parts[p], p) for p in order[: bound + 1]]
        if scheme == 0 and len(parts) > bound:
            break
    return out


def _entries(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows = [(w, n, *e) for w, n in zip(words, counts, strict=True) for e in indexed(w, frequent)]
            columns = [*zip(*rows, strict=True)] if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n", "scheme", "gram", "at"]
            )

    return run


def near_words(words: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """``(word, near, near_n)``: each word with each other that is one edit away.

    ``words``: distinct ``word`` with ``n``. Lists are kept by gram, position and length
    of the word; a word asks the lists of its own length, and those of one letter more
    at the same and at the next position. Long lists are split by Spark like any hot
    join key; candidates are verified inside the join.
    """
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(frequent_grams(words, most))
    entries = cut_lineage(words.mapInArrow(_entries(held), "word string, n long, scheme int, gram string, at int"), "variant-grams")

    def key(more: int, shift: int):
        return F.xxhash64("scheme", "gram", F.col("at") + shift, F.length("word") + more)

    listed = entries.select(key(0, 0).alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    asked = entries.select(F.explode(F.array(key(0, 0), key(1, 0), key(1, 1))).alias("key"), "word", "n")
    longer = F.length("near") - F.length("word")
    fits = ((longer == 0) & (F.col("word") < F.col("near"))) | (longer == 1)
    found = asked.join(listed, "key").where(fits & (F.levenshtein("word", "near", 1) == 1))
    pairs = cut_lineage(found.select("word", "n", "near", "near_n").distinct(), "variant-pairs")
    return pairs.select("word", "near", "near_n").union(pairs.select("near", "word", "n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of the chain that starts with a word's form.

    ``forms``: ``(word, form)``, each word once, without cycles. Each round doubles the
    steps that are taken, and is a written table; rows at their end leave the rounds.
    """
    done = None
    open_ = cut_lineage(forms.select("word", F.col("form").alias("root")), "variant-chains")
    while True:
        onward = open_.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Chains that already ended are asked as well: their roots are the ends of others.
        if done is not None:
            onward = onward.union(done.select(F.col("word").alias("root"), F.col("root").alias("next")))
        step = cut_lineage(open_.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("ended")), "variant-chains")
        ended = step.where("ended").select("word", "root")
        done = ended if done is None else done.union(ended)
        open_ = step.where("NOT ended").select("word", "root")
        if open_.isEmpty():
            return done


def group_variants(words: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``words``.

    A word's form is its near word of the largest ``n`` (ties: the smallest in code-point
    order), if that is twice its own at least. ``n`` doubles along a chain of forms, so
    chains are short and end in a root; a word without a form is its own root.
    """
    near = near_words(words, most)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best")
    stats = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(stats, "word", "left")
    form = F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best.w"))
    joined = cut_lineage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")),
        "variant-forms",
    )
    roots = roots_of(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM runs GROUP BY doc_id, run),
coded AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM own, tab),
changed AS (
  SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM coded),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed GROUP BY word HAVING sum(n) >= {MIN_COUNT} AND length(word) >= {MIN_CHARS}),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT less.word AS a, less.n AS an, words.word AS b, words.n AS bn FROM less JOIN words ON less.rest = words.word),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, an, b, bn FROM shorter UNION ALL SELECT b, bn, a, an FROM shorter),
top AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS best, max(near_n) AS best_n FROM near GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
    CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN top ON words.word = top.word),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT chain.word, form, depth + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE form IS NOT NULL)
SELECT forms.word, n, n_near, form, form_n, ends.root FROM forms
JOIN (SELECT word, max_by(root, depth) AS root FROM chain GROUP BY word) ends ON forms.word = ends.word
"""


@register("op12_spelling_variants", ORACLE)
def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, altered as the query demands, with its form and root."""
    words = cut_lineage(vocabulary(table(spark, sf_dir, "documents"), altered=True), "variant-words")
    return group_variants(words)
