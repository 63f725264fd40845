"""Runs of words against a plain search of every start and period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, row string, runs long"


def plain(words):
    """All (start, length, period), by definition."""
    found = set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                u = words[i : i + q]
                if not any(q % d == 0 and u == u[:d] * (q // d) for d in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def changed(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = changed(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *digest)


def check(texts):
    assert pr.runs_of(texts) == [plain(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_two_words(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "abc", "aab", "d"]), st.integers(1, 9)), max_size=8), max_size=4))
def test_powers(parts):
    check([[c for u, k in doc for c in u * k] for doc in parts])


def test_long_runs():
    rng = np.random.default_rng(5)
    for period in (1, 2, 3, 37, 200):
        base = rng.integers(0, 50, period).astype(str).tolist()
        words = rng.integers(0, 9, 300).astype(str).tolist() + (base * (1500 // period + 5))[:1501] + ["x"] * 7
        check([words, words[100:], [], ["y"], words])
    # Squares of squares, and words that a sum of powers may take for equal.
    morse = ["a"]
    for _ in range(12):
        morse += ["b" if w == "a" else "a" for w in morse]
    check([morse])
    assert pr.runs_of([["z"] * 100_000]) == [[(0, 100_000, 1)]]
    assert pr.runs_of([["y", "z"] * 60_000]) == [[(0, 120_000, 2)]]


def test_grammar_spells_the_words():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5, 400)
    doc = np.repeat(np.arange(4), 100)
    g = pr.re_pair(ids, doc)
    assert ((g.start < g.mid) & (g.mid < g.end)).all()
    for rule, at in zip(g.rule, g.at, strict=True):
        n = g.end[rule] - g.start[rule]
        assert (ids[at : at + n] == ids[g.start[rule] : g.end[rule]]).all() and doc[at] == doc[at + n - 1]
    # Each document is one symbol in the end, so each place between words is a boundary.
    inside = {int(at + g.mid[r] - g.start[r]) for r, at in zip(g.rule, g.at, strict=True)} | set(g.mid.tolist())
    assert inside == set(range(400)) - {0, 100, 200, 300}


@pytest.mark.parametrize("rows", ([], [(1, None), (1, ""), (None, "a b " * 9), (2, "a b " * 9), (2, "a b " * 9), (3, " \t\n")]))
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = pr.periodic_runs(docs, docs.columns).collect()
    assert sorted((r.row.doc_id or 0, r.row.runs, r.n_words, [tuple(x) for x in r.runs]) for r in got) == sorted(
        (i or 0, 7, len((t or "").split()), plain((t or "").split())) for i, t in rows
    )


def test_query(spark, data_dir):
    from linkloom.llm.base import QUERIES

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = QUERIES["op13_periodic_runs"](spark, data_dir)
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(d.doc_id, d.text) for d in docs)
