"""Toxicity: a softmax over averaged subword embeddings, trained with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import codes
from linkloom.llm.base import annotate, register, small_batches, table

#: Character n-grams of words with a mark at both ends, and the word itself.
GRAMS = (3, 4, 5)
#: Bits of the number of buckets; 8 numbers for each.
BUCKET_BITS = 18
WIDTH = 8
#: The fit uses at most so many labelled texts of each class (the ones whose ids
#: hash lowest); class weights bring back the shares of all labelled rows.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
#: Buckets that fewer texts of the sample fill keep the vector 0.
MIN_TEXTS = 4
EPOCHS, RATE = 8, 0.3
THRESHOLD = 0.3
#: Factor on the average, so that rare subwords of a long text can decide, and
#: neutral subwords that each average holds besides, so that a short text can't
#: be judged by a few rare ones.
GAIN, NEUTRAL = 50.0, 200.0
_U = np.uint64


@dataclass(frozen=True)
class Model:
    """``vectors``: bucket embeddings; ``output``: (WIDTH, 2); ``bias``: (2,)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The softmax of two classes needs only the difference of their logits,
        and that of an average is the average of each bucket's difference."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every subword of a whole text, with repeats.

    Words are runs of letters and digits, lower-cased. A misspelt word shares
    most of its n-grams, so most of its vectors, with the right one.
    """
    points = codes.code_points(f" {(text or '').lower()} ")
    word = (points >= 128) | ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
    points = np.where(word, points, 32)
    starts, ends = codes.spans(word)
    prefix = codes.prefix_hash(points)
    gaps = np.concatenate(([0], np.cumsum(~word)))
    found = [codes.span_hash(prefix, starts, ends) + _U(1)]
    for n in GRAMS:
        if len(points) >= n:
            at = np.flatnonzero(gaps[n - 1 : len(points)] == gaps[1 : len(points) - n + 2])
            found.append(codes.mix(codes.span_hash(prefix, at, at + n) + _U(n)))
    return (np.concatenate(found) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _bags(batches):
    """Distinct buckets and their counts: what the fit needs of a text."""
    for batch in batches:
        keys, counts = [], []
        for text in batch.column("text").to_pylist():
            k, n = np.unique(buckets(text), return_counts=True)
            keys.append(k.astype(np.int32))
            counts.append(np.minimum(n, 32767).astype(np.int16))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("doc_id"), batch.column("print"), pa.array(keys, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int16()))],
            names=["label", "doc_id", "print", "keys", "counts"],
        )


def fit(labels: np.ndarray, keys: list, counts: list, share: float, seed: int = 7) -> Model:
    """Embeddings and softmax trained together by Adam on minibatches.

    ``share`` is the share of toxic rows that the scores should assume. The large
    constant under Adam's root keeps rare buckets from moving as fast as common
    ones, so that single texts aren't learnt by heart.
    """
    size, n = 1 << BUCKET_BITS, len(labels)
    rng = np.random.default_rng(seed)
    texts = np.zeros(size, dtype=np.int64)
    for k in keys:  # distinct in each text
        texts[k] += 1
    kept = np.flatnonzero(texts >= min(MIN_TEXTS, max(1, n // 20)))
    place = np.full(size, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    bags = []
    for k, c in zip(keys, counts, strict=True):
        here = place[k] >= 0
        bags.append((place[k[here]], (c[here] / (c.sum() + NEUTRAL)).astype(np.float32)))
    vectors = rng.normal(0, 0.01, (len(kept), WIDTH)).astype(np.float32)
    output = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    mine = min(1 - 1e-9, max(1e-9, labels.mean())) if n else 0.5
    weights = np.where(labels == 1, share / mine, (1 - share) / (1 - mine)).astype(np.float32)
    m, v, mo, vo = np.zeros_like(vectors), np.zeros_like(vectors), np.zeros_like(output), np.zeros_like(output)
    step, batch = 0, 64 if n < 2000 else 128
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.001
        order = rng.permutation(n)
        for rows in np.split(order, range(batch, n, batch)) if n else []:
            key = np.concatenate([bags[r][0] for r in rows])
            part = np.concatenate([bags[r][1] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            mean = np.stack([np.bincount(row, part * vectors[key, d], len(rows)) for d in range(WIDTH)], 1).astype(np.float32) * GAIN
            logits = mean @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= (weights[rows] / len(rows))[:, None]
            back = (p @ output.T) * GAIN
            grad = np.stack([np.bincount(key, part * back[row, d], len(kept)) for d in range(WIDTH)], 1).astype(np.float32)
            grad_out = mean.T @ p + 1e-4 * output
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            vectors -= rate * fix * m / (np.sqrt(v) + 0.1)
            mo, vo = 0.9 * mo + 0.1 * grad_out, 0.999 * vo + 0.001 * grad_out * grad_out
            output -= rate * fix * mo / (np.sqrt(vo) + 1e-3)
            bias -= rate * p.sum(0)
    whole = np.zeros((size, WIDTH), dtype=np.float32)
    whole[kept] = vectors
    return Model(whole, output, bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit on the rows of ``labels`` (``doc_id``, ``toxic``) that ``usable`` admits.

    Null labels and rows without a document are left out; a doc_id with several
    labels or texts counts once for each pair. The sample is bounded after labels met
    their texts, one row for each pair, so a doc_id repeated without end adds no more
    than the bound; only bags of subwords of the sample reach the driver. Without any labelled row the model scores
    everything alike, by a share of one half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    if usable is not None:
        own = own.where(usable)
    totals = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    total = sum(totals.values())
    share = min(0.99, max(0.01, totals.get(1, 0) / total)) if total else 0.5
    ranked = own.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    picked = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = ranked.where(F.col("label") == label).orderBy("h", "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    met = given.select("doc_id", "print").join(F.broadcast(picked.distinct()), "doc_id").distinct()
    bounded = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = met.where(F.col("label") == label).orderBy("h", "doc_id", "print").limit(most).drop("h")
        bounded = part if bounded is None else bounded.union(part)
    sample = given.join(F.broadcast(bounded), ["doc_id", "print"]).select("label", "doc_id", "print", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = sample.mapInArrow(_bags, f"label int, doc_id {kind}, print long, keys array<int>, counts array<smallint>")
    one = F.first(F.struct("keys", "counts")).alias("bag")
    bags = bags.groupBy("label", "doc_id", "print").agg(one).select("label", "bag.keys", "bag.counts").toArrow()
    got = bags.column("label").to_numpy().astype(np.int64)
    keys = [np.asarray(x.values) for x in bags.column("keys")]
    counts = [np.asarray(x.values) for x in bags.column("counts")]
    order = np.lexsort([[int(k.sum()) for k in keys], [len(k) for k in keys], got]) if len(got) else []
    return fit(got[order] if len(got) else got, [keys[k] for k in order], [counts[k] for k in order], share)


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) and ``score``, the probability of label 1.

    Whole texts are scored, each by itself. A null text, an empty one and one
    without words have the score of the bias alone.
    """
    folded, bias = model.folded()
    held = docs.sparkSession.sparkContext.broadcast(folded)  # 2**BUCKET_BITS numbers, whatever the data

    def run(texts: list) -> list[list]:
        out = []
        for text in texts:
            found = buckets(text)
            logit = bias + GAIN * float(held.value[found].sum(dtype=np.float64)) / (len(found) + NEUTRAL)
            out.append(1 / (1 + np.exp(-min(50.0, max(-50.0, logit)))))
        return [out]

    return annotate(docs, "text", carry, run, "score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@register("op1_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = scored(docs, model, ["doc_id"]).select("row.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
