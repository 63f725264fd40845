"""Near-duplicates against brute force over all pairs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.llm import codes, neardup
from linkloom.llm.base import BLANK_WORD, ascii_lower


def shingles(text):
    words = BLANK_WORD.findall(ascii_lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """component_id for each doc_id, by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = {}
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                links[a, b] = links.get((a, b), 0) + 1
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in links.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}, [(d, len(s)) for (d, _), s in zip(rows, sets, strict=True)]


def check(spark, rows, size=None):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]), "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    want, sizes = brute(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted(sizes)
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_given_tables(spark, table):
    path = f"/root/testdata/{table}/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    check(spark, rows)


def test_large_family_of_near_copies(spark):
    """600 copies with up to a fifth of the words changed: some reach the
    smallest one, some only each other, some nobody."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(600):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - k, " ".join(words)))
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, "É é é é é"), (10, "é é é é é")]
    check(spark, rows)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    a = " ".join(f"a{k}" for k in range(40))
    b = " ".join(f"b{k}" for k in range(40))
    rows = [(5, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (None, a, 5), (7, a, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumn("node", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in neardup.near_duplicates(df).collect())
    # Both texts of 5 count: 9 shares the second one, 7 the first.
    assert got == [(0, 0), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text == a) for r in kept.collect()) == [(0, True), (5, False), (5, True)]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(1)
    import numpy as np

    for share in (0.5, 0.85, 0.95):
        n = 800
        both = [rng.getrandbits(64) for _ in range(int(n * share))]
        left = np.array(both + [rng.getrandbits(64) for _ in range(n - len(both))], dtype=np.uint64)
        right = np.array(both + [rng.getrandbits(64) for _ in range(n - len(both))], dtype=np.uint64)
        real = len(both) / (2 * n - len(both))
        hits = (neardup.super_minhash(codes.mix(left)) == neardup.super_minhash(codes.mix(right))).mean()
        assert abs(hits - real) < 0.15


def test_every_slot_is_filled_for_small_sets():
    import numpy as np

    best = neardup.super_minhash(np.array([7], dtype=np.uint64))
    assert len({int(x >> np.uint64(32)) for x in best}) == neardup.BANDS * neardup.ROWS
