"""Repeated windows against a plain search of all windows."""

import random
import re

import pytest

from linkloom.llm import substring_dedup as sd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """(doc_id, n_words, spans, kept) of every row."""
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in split:
        if d is not None:
            for k in range(len(words) - 12):
                win = tuple(words[k : k + 13])
                first[win] = min(first.get(win, d), d)
    out = []
    for d, words in split:
        gone = set()
        if d is not None:
            for k in range(len(words) - 12):
                if first[tuple(words[k : k + 13])] < d:
                    gone |= set(range(k, k + 13))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((d, len(words), spans, " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, **sizes):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, chunk string")
    got = sd.without_repeats(docs, docs.columns, **sizes).collect()
    assert all((r.row.row, r.row.chunk) == (1, "x") for r in got)
    return sorted(((r.row.doc_id, r.n_words, [[*s] for s in r.spans], r.kept) for r in got), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 300, "bucket_entries": 20}])
def test_shared_passages(spark, sizes):
    """Copies, near copies, passages that many documents hold, repeats inside one."""
    rng = random.Random(2)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(12, 40))] for k in range(5)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randrange(4) :]
            words += [f"w{rng.randrange(40)}" for _ in range(rng.randrange(20))]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100 + k, rows[3][1]) for k in range(30)]
    rng.shuffle(rows)
    assert found(spark, rows, **sizes) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"u{k}" for k in range(30))
    rows = [
        (1, long), (1, long), (2, long + " x"), (None, long), (None, None), (3, None), (4, ""), (5, " \n"), (-7, "u1 " + long),
        (6, "a " * 200_000), (7, "a " * 13), (8, "a " * 12), (9, "\u00e9\U0001f600 " * 20), (10, "\u00e9\U0001f600 " * 20),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_columns_follow(spark):
    rows = [(1, " ".join(f"u{k}" for k in range(20)), 9, "en"), (2, " ".join(f"u{k}" for k in range(20)) + "  tail", 9, "en"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.dedup_substrings(docs).collect()}
    assert got == {1: (rows[0][1], 9), 2: ("tail", 4), 3: (None, None)}
