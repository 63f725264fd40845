"""Substring dedup: word windows that a document with a smaller id holds too.

Rabin-Karp prints of all windows are counted in Spark. Documents are gathered in
chunks of bounded text; a chunk sends every distinct print once, however often
it holds it, so a passage that all documents share is one entry for each chunk.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import codes
from linkloom.llm.base import BLANK_WORD, by_batch, register, small_batches, table
from linkloom.session import cut_lineage

WINDOW = 13
#: Characters of one chunk of documents, and entries of one bucket of prints.
CHUNK_CHARS, BUCKET_ENTRIES = 4_000_000, 1_000_000
_U = np.uint64
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHECK = 0x9FB21C651E98DF25

RESULT = "n_words long, spans array<struct<from:int,to:int>>, kept string"


def _press(array: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: high ones of sorted differences are alike."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T) if len(array) else array
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def _small(array: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as they need."""
    top = int(array.max()) if len(array) else 0
    return array.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def window_prints(words: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) prints of all windows of ``words`` (64-bit hashes of words):
    64 bits and, from the other end of the product, 16 more."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.uint16)
    prefix = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * codes._power(_BASE, len(words)), out=prefix[1:])
    rolled = codes.mix((prefix[width:] - prefix[:-width]) * codes._power(_INVERSE, len(words))[:n])
    # A second sum without places, of words hashed anew: independent of the first.
    total = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(codes.mix(words * _U(_CHECK) + _U(1)), out=total[1:])
    return rolled, (codes.mix(total[width:] - total[:-width]) >> _U(48)).astype(np.uint16)


class Windows:
    """Windows of a chunk's documents: prints in order, and what each one belongs to.

    ``texts`` come in ascending order of their ids, so the first window of a print
    is the one of its smallest document.
    """

    def __init__(self, ids: list, texts: list[str]) -> None:
        points = codes.code_points("\n".join(texts))
        begin, end = codes.spans(~codes.blank(points))
        words = codes.span_hash(codes.prefix_hash(points), begin, end)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.first = np.searchsorted(begin, starts)
        self.n_words = np.diff(np.append(self.first, len(begin)))
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        prints, check = window_prints(words)
        own = np.array([i is not None for i in ids], dtype=bool)
        whole = np.flatnonzero((doc[: len(prints)] == doc[WINDOW - 1 :][: len(prints)]) & own[doc[: len(prints)]])
        prints, check = prints[whole], check[whole]
        order = np.argsort(prints, kind="stable")
        # Prints that agree in 64 bits only are told apart by the other 16.
        split = np.flatnonzero(prints[order][1:] == prints[order][:-1])
        if len(split) and (check[order][split] != check[order][split + 1]).any():
            order = np.lexsort((np.arange(len(prints)), check, prints))
        self.prints, self.check = prints[order], check[order]
        self.at, self.doc = whole[order], doc[whole[order]]
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = (self.prints[1:] != self.prints[:-1]) | (self.check[1:] != self.check[:-1])
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.total = len(begin)


def _opened(chunk: pa.Table) -> tuple[list[int], list, list[str]]:
    """Positions of the chunk's rows by ascending id (null last), ids and texts."""
    unpress = zstandard.ZstdDecompressor().decompress
    ids = chunk.column("doc").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    packed = chunk.column("packed")
    texts = [unpress(packed[k].as_py()).decode("utf-8", "surrogatepass") for k in order]
    return order, [ids[k] for k in order], texts


_ENTRIES = "bucket long, chunk long, prints binary, checks binary, docs binary, ids binary"


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})


def _cuts(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each stretch of sorted prints, and where the stretches begin and end."""
    bucket = (prints >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[at], np.append(at, len(bucket))


def _entries(bits: int):
    """A chunk's distinct prints, each with its smallest document, by bucket."""

    def run(chunk: pa.Table) -> pa.Table:
        _, ids, texts = _opened(chunk)
        w = Windows(ids, texts)
        key = np.array([i or 0 for i in ids], dtype=np.int64)
        prints, check, docs = w.prints[w.heads], w.check[w.heads], w.doc[w.heads]
        number = chunk.column("chunk")[0].as_py()
        buckets, cut = _cuts(prints, bits)
        rows = []
        for k, bucket in enumerate(buckets.tolist()):
            part = slice(cut[k], cut[k + 1])
            used, inverse = np.unique(docs[part], return_inverse=True)
            packed = (np.diff(prints[part], prepend=_U(0)), check[part], _small(inverse), np.diff(key[used], prepend=0))
            rows.append((bucket, number, *map(_press, packed)))
        kinds = [("bucket", pa.int64()), ("chunk", pa.int64()), *[(n, pa.binary()) for n in ("prints", "checks", "docs", "ids")]]
        return _table(rows, kinds)

    return run


_KINDS = (np.uint8, np.uint16, np.uint32)


def _answers(bucket: pa.Table) -> pa.Table:
    """For each chunk, which of its prints a document with a smaller id than the
    chunk's smallest holds elsewhere: one bit for each print it sent."""
    prints, checks, ids, sizes = [], [], [], []
    for row in bucket.select(["prints", "checks", "docs", "ids"]).to_pylist():
        prints.append(np.cumsum(_unpress(row["prints"], _U), dtype=_U))
        checks.append(_unpress(row["checks"], np.uint16))
        known = np.cumsum(_unpress(row["ids"], np.int64))
        n = len(prints[-1])
        raw = zstandard.ZstdDecompressor().decompress(row["docs"])
        ids.append(known[_unpress(row["docs"], _KINDS[(len(raw) // n).bit_length() - 1])])
        sizes.append(n)
    p, c, i = np.concatenate(prints), np.concatenate(checks), np.concatenate(ids)
    order = np.lexsort((i, c, p))
    p, c = p[order], c[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    least = i[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.zeros(len(p), dtype=bool)
    smaller[order] = least < i[order]
    number = bucket.column("bucket")[0].as_py()
    ends = np.cumsum(sizes)
    rows = []
    for chunk, a, b in zip(bucket.column("chunk").to_pylist(), ends - sizes, ends, strict=True):
        if smaller[a:b].any():
            rows.append((chunk, number, zstandard.ZstdCompressor().compress(np.packbits(smaller[a:b]).tobytes())))
    return _table(rows, [("chunk", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: n + 1] += np.bincount(starts, minlength=n + 1)[: n + 1]
    edge[WINDOW:] -= np.bincount(starts, minlength=n + 1)[: n + 1 - WINDOW] if n >= WINDOW else 0
    return np.cumsum(edge[:-1]) > 0


def _removed(bits: int):
    """Rows of a chunk without the words of repeated windows."""

    def run(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        order, ids, texts = _opened(chunk)
        w = Windows(ids, texts)
        elsewhere = np.zeros(len(w.heads), dtype=bool)
        buckets, cut = _cuts(w.prints[w.heads], bits)
        place = {int(b): k for k, b in enumerate(buckets)}
        for row in marks.select(["bucket", "marks"]).to_pylist():
            k = place[row["bucket"]]
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["marks"]), dtype=np.uint8)
            elsewhere[cut[k] : cut[k + 1]] = np.unpackbits(raw, count=cut[k + 1] - cut[k]).astype(bool)
        key = np.array([i or 0 for i in ids], dtype=np.int64)
        gone = elsewhere[w.group] | (key[w.doc] > key[w.doc[w.heads]][w.group]) if len(w.group) else np.zeros(0, dtype=bool)
        cover = _covered(w.at[gone], w.total)
        n_words, spans, kept = [], [], []
        for k, text in enumerate(texts):
            a, n = int(w.first[k]), int(w.n_words[k])
            words, drop = BLANK_WORD.findall(text), cover[a : a + n]
            begin, end = codes.spans(drop)
            n_words.append(n)
            spans.append([{"from": x, "to": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
            kept.append(" ".join(compress(words, (~drop).tolist()) if len(begin) else words))
        rows = chunk.column("row").combine_chunks().take(pa.array(order))
        kinds = (pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.string())
        return pa.Table.from_arrays([rows, *map(pa.array, (n_words, spans, kept), kinds)], names=["row", "n_words", "spans", "kept"])

    return run


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    press = zstandard.ZstdCompressor(level=3).compress
    packed = [press((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["row", "doc", "chunk", "packed"])


def without_repeats(docs: DataFrame, carry: list[str], chunk_chars: int = CHUNK_CHARS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``row`` (the carried columns), ``n_words``, ``spans`` (word positions to remove,
    maximal, end exclusive) and ``kept`` (the other words, joined by blanks).

    A word goes when a window of 13 words over it also begins in a document with a
    smaller ``doc_id``; windows are those of the given texts. Needs ``doc_id`` (a
    whole number) and ``text``. A null text has no words. A row without an id keeps
    all its words and takes none from others. Rows with one id are one document:
    they take nothing from each other. An empty table gives an empty one. A text of
    any length is one unit of work; its memory is some twenty bytes a character.

    Equal rows fall into one chunk; all others are spread by id and text. Windows
    are equal when 64 bits of their rolling hash and 16 bits of another agree.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row")
    given = docs.select(row, docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text"))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars))
    bits = max(0, (chars // 6 // bucket_entries).bit_length())
    chunked = given.select("row", "doc", F.pmod(F.xxhash64("doc", "text"), F.lit(chunks)).cast("long").alias("chunk"), "text")
    kind = given.schema["row"].dataType
    packed = chunked.mapInArrow(by_batch(_pack), f"row {kind.simpleString()}, doc long, chunk long, packed binary")
    entries = packed.groupBy("chunk").applyInArrow(_entries(bits), _ENTRIES)
    marks = cut_lineage(entries.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, marks binary"), "substring-marks")
    return packed.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(
        _removed(bits), f"row {kind.simpleString()}, {RESULT}"
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text`` (words joined by blanks
    where something was cut); columns stay, ``n_chars`` follows."""
    found = without_repeats(docs, docs.columns)
    cut = F.size("spans") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
wins AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(words, p, p + {WINDOW - 1}), ' ')) AS win
  FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM d WHERE len(words) >= {WINDOW})),
least_ AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS q
  FROM wins JOIN least_ USING (win) WHERE doc_id > first_doc),
per AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce(array_to_string(list_where(words, list_transform(range(1, len(words) + 1), lambda i: NOT list_contains(qs, i))), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""


@register("op11_substring_dedup", ORACLE)
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    found = without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select("row.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
