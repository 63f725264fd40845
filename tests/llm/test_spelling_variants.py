"""Words one edit apart against comparing all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import spelling_variants as sv


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    """word -> (n, n_near, form, form_n, root)."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def grouped(spark, counts, most=sv.MAX_FREQUENT):
    words = spark.createDataFrame([*counts.items()], "word string, n long")
    got = sv.group_variants(words, most).collect()
    assert len(got) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}


@settings(max_examples=300, deadline=None)
@given(st.text("abc\u00e9", min_size=5, max_size=12), st.text("abc\u00e9", min_size=5, max_size=12), st.integers(0, 3), st.randoms())
def test_near_words_meet(word, other, kind, rng):
    """A near pair shares a listed gram at positions that the index asks for."""
    k = rng.randrange(len(word))
    other = [other, word[:k] + word[k + 1 :], word[:k] + "b" + word[k:], word[:k] + "b" + word[k + 1 :]][kind]
    frequent = {g: rng.randrange(30, 99) for w in (word, other) for p in range(len(w)) for q in (3, 4, 5) if (g := f"\x02{w}\x03"[p : p + q]) and rng.random() < 0.5}
    frequent = {g: n for g, n in frequent.items() if all(g[:q] in frequent for q in range(3, len(g)))}
    if len(other) < 5 or not one_edit(word, other):
        return
    a, b = sorted((word, other), key=len)
    shifts = (0,) if len(a) == len(b) else (0, 1)
    listed = {*sv.indexed(b, frequent)}
    assert any((s, g, p + d) in listed for s, g, p in sv.indexed(a, frequent) for d in shifts)


@pytest.mark.parametrize("most", [sv.MAX_FREQUENT, 10])
def test_groups(spark, most):
    rng = random.Random(4)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choices("abcd\u00e4", k=rng.randint(5, 9)))
        for _ in range(8):
            counts[word] = rng.choice([3, 4, 6, 8, 16, 40, 100])
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "a" + word[k:], word[:k] + "b" + word[k + 1 :]])
            word = word if len(word) >= 5 else word + "xyz"
    assert grouped(spark, counts, most) == plain(counts)


def test_chains_and_odd_words(spark):
    chain = {"a" * 5 + "b" * k: 3 * 2 ** (10 - k) for k in range(10)}
    odd = {"x" * 3000: 3, "x" * 3001: 6, "other": 4, "othex": 8, "othey": 8}
    counts = {**chain, **odd}
    got = grouped(spark, counts)
    assert got == plain(counts)
    assert got["a" * 5 + "b" * 9][-1] == "aaaaa" and got["other"][2] == "othex"
    assert sv.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_vocabulary(spark):
    rows = [(1, "Hello hello HELLO \u00c4pfel, \u00e4pfel \u00c4pfel\u00c4pfel"), (None, "hello tiny"), (2, None), (3, ""), (4, "word" * 9), (5, "word" * 9), (5, "word" * 9)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = {r.word: r.n for r in sv.vocabulary(docs).collect()}
    assert got == {"hello": 4, "word" * 9: 3}
    assert sv.vocabulary(docs.limit(0), altered=True).count() == 0
