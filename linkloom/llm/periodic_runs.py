"""Periodic run detection: a grammar over the words of a batch of documents.

Re-Pair replaces pairs of symbols that occur again by nonterminals. What is then
left of each document is paired up until it is one symbol. Every run lies in some
nonterminal and crosses its boundary (the place between its two halves), so each
nonterminal is searched once, at its boundary, wherever and however often it is
derived; found runs are then carried to all derivation positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import codes
from linkloom.llm.base import BLANK_WORD, by_batch, register, small_batches, table

#: A run has at least so many words, and so many periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of one grammar (a longer document has one of its own), and pairs of
#: boundary and period that are looked at together.
BATCH_WORDS, LOOK = 400_000, 2_000_000
_U = np.uint64

Run = tuple[int, int, int]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass
class Grammar:
    """Nonterminals ``start, mid, end`` (where each is first derived, and where its
    halves meet), and all derivation positions of those that occur again."""

    start: np.ndarray
    mid: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    at: np.ndarray


def re_pair(ids: np.ndarray, doc: np.ndarray) -> Grammar:
    """The grammar of ``ids``; no pair reaches from one document into another.

    A round replaces every pair that occurs again and, where pairs overlap, is the
    most frequent one there; so the pair that is most frequent of all is replaced
    everywhere in each round. A pair that occurs once stays so until a neighbour is
    replaced: later rounds look at the other pairs only.
    """
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    made = 0
    sym, off, size = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
    after = int(sym.max()) + 1 if len(sym) else 1
    live = np.append(doc[1:] == doc[:-1], False)[: len(ids)]

    def merged(chosen: np.ndarray, symbols: np.ndarray) -> None:
        nonlocal sym, off, size, doc, live
        sym[chosen] = symbols
        size[chosen] += size[chosen + 1]
        live[chosen] = True
        live[np.maximum(chosen - 1, 0)] = True
        keep = np.ones(len(sym), dtype=bool)
        keep[chosen + 1] = False
        sym, off, size, doc, live = sym[keep], off[keep], size[keep], doc[keep], live[keep]
        live[-1] = False
        live[:-1] &= doc[1:] == doc[:-1]

    while True:
        pair = np.flatnonzero(live)
        kinds, kind, count = np.unique(sym[pair] * after + sym[pair + 1], return_inverse=True, return_counts=True)
        again = count[kind] > 1
        pair, kind = pair[again], kind[again]
        live[:] = False
        live[pair] = True
        rank = np.zeros(len(sym) + 1, dtype=np.int64)
        rank[pair] = count[kind] * len(kinds) + kind
        best = (rank[pair] >= rank[pair + 1]) & (rank[pair] >= rank[pair - 1])
        pair, kind = pair[best], kind[best]
        # Of overlapping equal pairs (one symbol repeated) every second one.
        begin = np.flatnonzero(np.diff(pair, prepend=-2) != 1)
        even = (np.arange(len(pair)) - np.repeat(begin, np.diff(np.append(begin, len(pair))))) % 2 == 0
        pair, kind = pair[even], kind[even]
        twice = np.bincount(kind, minlength=1)[kind] > 1
        pair, kind = pair[twice], kind[twice]
        if not len(pair):
            break
        _, first, number = np.unique(kind, return_index=True, return_inverse=True)
        left = pair[first]
        nodes.append((off[left], off[left + 1], off[left + 1] + size[left + 1]))
        places.append((made + number, off[pair]))
        made += len(first)
        merged(pair, after + number)
        after += len(first)
    while len(sym) > 1:
        begin = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
        odd = (np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))) % 2
        left = np.flatnonzero((odd[:-1] == 0) & (doc[1:] == doc[:-1]))
        if not len(left):
            break
        nodes.append((off[left], off[left + 1], off[left + 1] + size[left + 1]))
        merged(left, sym[left])
    start, mid, end = (np.concatenate(x) for x in zip(*nodes, strict=True)) if nodes else [np.zeros(0, dtype=np.int64)] * 3
    rule, at = (np.concatenate(x) for x in zip(*places, strict=True)) if places else [np.zeros(0, dtype=np.int64)] * 2
    return Grammar(start, mid, end, rule, at)


def _squares(ids: np.ndarray, prefix: np.ndarray, node: np.ndarray, mid: np.ndarray, most: np.ndarray, side: int):
    """(node, period) of squares that begin (side 1) or end (side -1) at a boundary."""
    out_node, out_period = [], []
    total = np.cumsum(most)
    for low in range(0, int(total[-1]) if len(total) else 0, LOOK):
        a, b = np.searchsorted(total, [low, low + LOOK], side="right")
        part = slice(a, min(b + 1, len(total)))
        n = most[part]
        period = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        whose, m = np.repeat(node[part], n), np.repeat(mid[part], n)
        here = slice(max(0, low - int(total[a] - most[a])), low + LOOK - int(total[a] - most[a]))
        period, whose, m = period[here], whose[here], m[here]
        for step in (0, 1):
            p = (m if side > 0 else m - 1) + side * np.minimum(step, period - 1)
            same = ids[p] == ids[p + side * period]
            period, whose, m = period[same], whose[same], m[same]
        from_ = m if side > 0 else m - 2 * period
        same = codes.span_hash(prefix, from_, from_ + period) == codes.span_hash(prefix, from_ + period, from_ + 2 * period)
        out_node.append(whose[same])
        out_period.append(period[same])
    if not out_node:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_node), np.concatenate(out_period)


def _equal(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """Words that agree from positions ``a`` and ``b`` on, forwards or backwards."""
    done, width = 0, 64
    while done < most:
        n = min(width, most - done)
        if step > 0:
            other = ids[a + done : a + done + n] != ids[b + done : b + done + n]
        else:
            other = (ids[a - done - n + 1 : a - done + 1] != ids[b - done - n + 1 : b - done + 1])[::-1]
        if other.any():
            return done + int(other.argmax())
        done, width = done + n, width * 4
    return done


def boundary_runs(ids: np.ndarray, g: Grammar) -> list[tuple[int, int, int, int]]:
    """(nonterminal, start, end, period) of runs that cross the nonterminal's boundary,
    within it.

    One side of the boundary holds half of the run, so at least two periods: a square
    begins or ends there. Hashes propose squares, words decide. Squares come by growing
    period; one inside a known run has a multiple of that run's period and is passed over.
    """
    large = np.flatnonzero(g.end - g.start >= MIN_LENGTH)
    s, m, e = g.start[large], g.mid[large], g.end[large]
    prefix = np.zeros(len(ids) + 1, dtype=_U)
    np.cumsum(codes.mix(ids.astype(_U) + _U(1)) * codes._power(codes._BASE, len(ids)), out=prefix[1:])
    known: dict[int, list[Run]] = {}
    for side, room in ((1, e - m), (-1, m - s)):
        most = np.minimum((e - s) // MIN_EXPONENT, room // 2)
        some = np.flatnonzero(most > 0)
        for node, q in zip(*(x.tolist() for x in _squares(ids, prefix, large[some], m[some], most[some], side)), strict=True):
            first, mid, last = int(g.start[node]), int(g.mid[node]), int(g.end[node])
            a = mid if side > 0 else mid - 2 * q
            own = known.setdefault(node, [])
            if any(x <= a and a + 2 * q <= y and p <= q for x, y, p in own):
                continue
            y = a + q + _equal(ids, a, a + q, last - a - q, 1)
            if y < a + 2 * q:
                continue
            own.append((a - _equal(ids, a - 1, a + q - 1, a - first, -1), y, q))
    return [
        (node, x, y, q) for node, own in known.items() for x, y, q in own if y - x >= max(MIN_LENGTH, MIN_EXPONENT * q)
    ]


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """(start, length, period) of all runs of each list of words, by start and period.

    A run is a stretch with a smallest period, at least ``MIN_LENGTH`` words and
    ``MIN_EXPONENT`` periods long, that no neighbouring word extends.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t], dtype=np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if not len(ids):
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    g = re_pair(ids, doc)
    found = boundary_runs(ids, g)
    order = np.argsort(g.rule, kind="stable")
    rules, at = g.rule[order], g.at[order]
    begin = np.cumsum(sizes) - sizes
    held: dict[int, list[Run]] = {}
    for node, x, y, q in found:
        first = int(g.start[node])
        a, b = np.searchsorted(rules, [node, node + 1])
        for o in at[a:b].tolist() if b > a else [first]:
            held.setdefault(int(doc[o]), []).append((q, o + x - first, o + y - first))
    for d, pieces in held.items():
        joined: list[list[int]] = []
        for q, x, y in sorted(pieces):
            if joined and joined[-1][0] == q and x <= joined[-1][2] - q:
                joined[-1][2] = max(joined[-1][2], y)
            else:
                joined.append([q, x, y])
        out[d] = sorted((int(x - begin[d]), y - x, q) for q, x, y in joined)
    return out


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(compress(words, keep.tolist()))


def with_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """The query's documents: one in ten ends in a repeated stretch."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _searched(change: Callable[[int | None, list[str]], list[str]] | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, runs, kept = [], [], []
        held: list[list[str]] = []

        def search() -> None:
            for words, own in zip(held, runs_of(held), strict=True):
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(" ".join(collapsed(words, own)))
            held.clear()

        some = 0
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = BLANK_WORD.findall(text or "")
            if change:
                words = change(doc_id, words)
            if held and some + len(words) > BATCH_WORDS:
                search()
                some = 0
            held.append(words)
            some += len(words)
        search()
        arrays = [batch.column("row"), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(
    docs: DataFrame, carry: list[str], change: Callable[[int | None, list[str]], list[str]] | None = None
) -> DataFrame:
    """``row`` (the carried columns), ``n_words``, ``runs`` (start, length, period; by
    start, then period) and ``collapsed`` (the words without repetitions).

    Needs ``doc_id`` and ``text``. A null or blank text has no words and no runs.
    Each row is searched by itself (rows of one grammar share nonterminals only), so
    null ids and repeated rows need nothing. ``change`` makes other words of a
    document's words before they are searched. A text of any length is one unit of
    work; its memory is some 200 bytes a word.
    """
    small_batches(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row")
    given = docs.select(row, docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    out = f"row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return given.mapInArrow(by_batch(_searched(change)), out)


@register("op13_periodic_runs")
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, and what is left when each is cut to one period."""
    found = periodic_runs(table(spark, sf_dir, "documents"), ["doc_id"], with_tail)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
    found = found.withColumn("best", F.array_min(order))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
