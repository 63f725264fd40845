"""MinHash near-duplicates: SuperMinHash signatures, bands, verification, groups."""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import codes
from linkloom.llm.base import BLANK_WORD, ascii_lower, by_batch, register, small_batches, table
from linkloom.llm.graph import components, link_within_groups
from linkloom.session import cut_lineage

SHINGLE = 5
#: 24 bands of 5: a pair at similarity 0.85 misses all bands once in 1.3 million.
BANDS, ROWS = 24, 5
#: Signatures that agree in fewer slots than so many deviations below the mean are
#: no candidates: at similarity 0.85 the mean is 102 of 120, the deviation 3.9 at most.
AGREE_DEVIATIONS = 4.6
#: The query's threshold; stages of a pipeline name their own.
LINK_PERCENT = 85
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15

_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("node", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("sig", pa.binary()),
    ]
)


def rows_for(percent: int) -> int:
    """Rows of a band: the most at which a pair at the threshold misses all bands
    less than once in a million (5 at 85, 4 at 80)."""
    slots = BANDS * ROWS
    fit = [r for r in range(1, ROWS + 1) if slots % r == 0 and (1 - (percent / 100) ** r) ** (slots // r) < 1e-6]
    return max(fit, default=1)


def agree_for(percent: int) -> int:
    """Slots in which candidates agree at least (84 at 85, 75 at 80)."""
    slots, share = BANDS * ROWS, percent / 100
    return max(1, math.floor(slots * share - AGREE_DEVIATIONS * math.sqrt(slots * share * (1 - share))))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of k-word windows; of the whole when there are fewer words."""
    if not len(words):
        return words
    width = min(k, len(words))
    h = words[: len(words) - width + 1].copy()
    for j in range(1, width):
        h = codes.mix(h * _U(0x2545F4914F6CDD1D) + words[j : len(words) - width + 1 + j])
    return np.unique(h)


def super_minhash(elements: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """Signature of a set of 64-bit elements.

    Every element walks a random permutation of the slots (Fisher-Yates, one
    swap a step) and offers ``step + uniform`` to the slot it stands on. A slot
    keeps its least offer, so the walk ends as soon as no later step can beat
    the largest one. All elements take a step together. Step and uniform are
    packed into one integer.
    """
    best = np.full(slots, np.iinfo(np.uint64).max, dtype=_U)
    n = len(elements)
    if not n:
        return best
    perm = None
    rows = np.arange(n)
    first = None
    for step in range(slots):
        draw = codes.mix(elements + _U((_STEP * (step + 1)) & (2**64 - 1)))
        pick = (step + (draw >> _U(32)) % _U(slots - step)).astype(np.int64)
        offer = (_U(step) << _U(32)) | (draw & _U(0xFFFFFFFF))
        if step == 0:
            first = slot = pick
        else:
            if perm is None:
                perm = np.broadcast_to(np.arange(slots, dtype=np.int16), (n, slots)).copy()
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, step]
            perm[:, step] = slot
        np.minimum.at(best, slot, offer)
        if int(best.max() >> _U(32)) <= step:
            break
    return best


def band_keys(best: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = codes.mix(best).reshape(-1, rows)
    key = codes.mix(np.arange(1, len(grid) + 1, dtype=_U) * _U(_STEP))
    for j in range(rows):
        key = codes.mix(key * _U(0x2545F4914F6CDD1D) + grid[:, j])
    return key.view(np.int64)


def _sign(batch: pa.RecordBatch, rows: int) -> pa.RecordBatch:
    n_shingles, nodes, bands, sigs = [], [], [], []
    for text in batch.column("text").to_pylist():
        words = BLANK_WORD.findall(ascii_lower(text or ""))
        if not words:
            n_shingles.append(0)
            nodes.append(None)
            bands.append(None)
            sigs.append(None)
            continue
        joined = " ".join(words)
        nodes.append(hashlib.blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if len(words) < SHINGLE:  # one shingle: linked to its exact copies only
            n_shingles.append(1)
            bands.append(None)
            sigs.append(None)
            continue
        elements = shingle_hashes(codes.word_hashes(codes.code_points(joined)))
        n_shingles.append(len(elements))
        best = super_minhash(elements)
        bands.append(band_keys(best, rows))
        sigs.append((codes.mix(best) & _U(0xFFFF)).astype(np.uint16).tobytes())
    arrays = [
        batch.column("doc_id").cast(pa.int64()),
        pa.array(n_shingles, pa.int64()),
        pa.array(nodes, pa.binary()),
        pa.array(bands, pa.list_(pa.int64())),
        pa.array(sigs, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_SIGNED)


def _alike(signatures: list[bytes], agree: int) -> list[tuple[int, int]]:
    grid = np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(len(signatures), -1)
    out = []
    for i in range(len(grid) - 1):
        near = np.flatnonzero((grid[i + 1 :] == grid[i]).sum(axis=1) >= agree)
        out += [(i, i + 1 + int(j)) for j in near]
    return out


def exact_links(texts: list[str], percent: int = LINK_PERCENT) -> list[tuple[int, int]]:
    """Pairs with 100 * intersection >= percent * union, on full shingle sets.

    Windows are numbered, not hashed (words, then pairs, fours and fives of
    words), so different windows never count as one.
    """
    vocabulary: dict[str, int] = {}
    docs = [[vocabulary.setdefault(w, len(vocabulary)) for w in BLANK_WORD.findall(ascii_lower(t or ""))] for t in texts]
    sizes = np.array([len(d) for d in docs])
    w = np.array([x for d in docs for x in d], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))  # words from here to the end
    at = np.flatnonzero(left >= SHINGLE)
    if len(at) == 0:
        return []
    two = np.zeros(len(w), dtype=np.int64)
    pair = np.flatnonzero(left >= 2)
    two[pair] = np.unique(w[pair] * len(vocabulary) + w[pair + 1], return_inverse=True)[1]
    four = np.unique(two[at] * (int(two.max()) + 1) + two[at + 2], return_inverse=True)[1]
    five = np.unique(four * len(vocabulary) + w[at + 4], return_inverse=True)[1]
    keys = np.unique(doc[at] * (int(five.max()) + 1) + five)
    owner, gram = np.divmod(keys, int(five.max()) + 1)
    n = np.bincount(owner, minlength=len(docs)).astype(np.int64)
    often = np.bincount(gram)
    column = np.cumsum(often > 1) - 1
    keep = often[gram] > 1
    owner, gram = owner[keep], column[gram[keep]]
    both = np.zeros((len(docs), len(docs)))
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    width = 4096
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        a, b = np.searchsorted(gram, [low, low + width])
        grid = np.zeros((len(docs), width), dtype=np.float32)
        grid[owner[a:b], gram[a:b] - low] = 1
        both += grid @ grid.T
    both = np.rint(both).astype(np.int64)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)]


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Texts whose shingle sets share ``percent`` of their union are linked.

    Needs ``doc_id`` and ``text``; other columns are not read. Rows that share a
    doc_id are one document with several texts. A null or blank text has no
    shingles and is linked with nothing; a null doc_id has component null, a row
    by itself. Exact copies are one text from the first step on, so the size of
    a group of copies costs nothing later.

    Signatures find candidates; families of candidates with similar signatures
    are compared on their full texts in blocks. Each text travels once for its
    family (more only for the part of a family that its smallest member doesn't
    reach).
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(
        own.mapInArrow(by_batch(partial(_sign, rows=rows_for(percent))), "doc_id long, n_shingles long, node binary, bands array<long>, sig binary"),
        "near-signed",
    )
    ids = signed.where("doc_id IS NOT NULL AND node IS NOT NULL")
    # Written, so that its join below has two shuffled sides: Spark splits a hot one then.
    copies = cut_lineage(ids.groupBy("node").agg(F.min("doc_id").alias("rep")), "near-copies")
    one = F.min_by(F.struct("doc_id", "bands", "sig"), "doc_id").alias("one")
    texts = cut_lineage(
        ids.where("bands IS NOT NULL")
        .groupBy("node")
        .agg(one)
        .select(F.col("one.doc_id").alias("id"), "one.bands", F.col("one.sig").alias("payload")),
        "near-texts",
    )
    buckets = texts.select(F.explode("bands").alias("grp"), "id").distinct()
    alike = link_within_groups(buckets, texts.select("id", "payload"), partial(_alike, agree=agree_for(percent)), 512, "near-alike")
    families = components(alike, "near-family").select(F.col("root").alias("grp"), "id")
    wanted = families.select(F.col("id").alias("doc_id"))
    bodies = cut_lineage(
        own.join(wanted, "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "text"])
        .select(F.col("doc_id").alias("id"), F.col("text").alias("payload")),
        "near-bodies",
    )
    links = link_within_groups(families, bodies, partial(exact_links, percent=percent), 256, "near-exact")
    # All documents of one text hang on its smallest id; ids with several texts join their groups.
    member = ids.join(copies, "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    roots = components(links.select("a", "b").union(member.distinct()), "near-root")
    return (
        signed.select("doc_id", "n_shingles")
        .join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    All columns stay. Repeated rows of a kept document (same id and text) become
    one; rows without an id stay.
    """
    spare = near_duplicates(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.where("doc_id IS NOT NULL").join(spare, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return stay.select(docs.columns).union(docs.where("doc_id IS NULL"))


@register("op10_minhash_near_dedup")
def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count, group and whether it stays."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
