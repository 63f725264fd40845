"""Suffix-array measures against a search for every repeated stretch."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import repetition


def brute(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_lengths(words):
    assert repetition.repeat_lengths(words).tolist() == brute(words)


def test_lengths_of_long_repeats():
    rng = random.Random(2)
    part = [str(rng.randrange(50)) for _ in range(70)]
    words = part + ["x"] + part[:40] + ["y"] + part
    assert repetition.repeat_lengths(words).tolist() == brute(words)
    assert repetition.repeat_lengths(["a"] * 500).tolist() == [499, *range(499, 0, -1)]


def test_union():
    assert repetition.union_size(np.array([0, 2, 9]), np.array([3, 3, 1]), 10) == 6


def test_measures_of_odd_texts():
    none = (0, 0, 0, 0, 0, 0, 0, True, False)
    assert repetition.measure(None) == repetition.measure("") == repetition.measure(" \n\t ") == none
    clean = " ".join(f"w{k}" for k in range(60))
    assert repetition.measure(clean)[-2:] == (False, True)
    # A stretch of 30 words that comes back covers 60 of 120 words.
    again = " ".join([f"w{k}" for k in range(90)] + [f"w{k}" for k in range(30)])
    assert repetition.measure(again)[4:] == (60, 60, 30, False, False)
    long = " ".join([f"w{k}" for k in range(1000)] + [f"w{k}" for k in range(101)])
    assert repetition.measure(long)[6:] == (101, False, False)
    assert repetition.measure("a b\n \na b\na b \n#$")[2:4] == (2, 1)


def test_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 5, "q"), (1, text, 5, "q"), (None, None, None, None), (2, "", 1, "r"), (3, text * 400, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    kept = repetition.passing(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == rows[:2]
    assert repetition.passing(docs.limit(0)).count() == 0
