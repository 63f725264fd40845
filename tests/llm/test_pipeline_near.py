"""The pipeline's near-dedup stage: 80 % of the shingles, not the query's 85."""

import random

import corpus_pipeline
from test_neardup import shingles

from linkloom.llm import neardup


def brute(rows, percent):
    """Ids that stay, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, _) in enumerate(rows):
        for m in range(k):
            both = len(sets[k] & sets[m])
            if both and 100 * both >= percent * (len(sets[k]) + len(sets[m]) - both):
                x, y = find(a), find(rows[m][0])
                root[max(x, y)] = min(x, y)
    return {d for d, _ in rows if find(d) == d}


def test_stage_links_from_80_percent(spark, data_dir):
    """Pairs of 200 shingles whose last words differ: similarities 0.75 to 0.90."""
    rng = random.Random(8)
    rows, shares = [], []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = 10 + k % 20
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-other] + [f"x{j}" for j in range(other)]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        shares.append(len(a & b) / len(a | b))
    between = sum(0.80 <= s < 0.85 for s in shares)
    assert between > 20 and min(shares) < 0.80
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r.doc_id for r in corpus_pipeline.near(spark, docs, data_dir).collect()}
    assert stay == brute(rows, 80)
    assert len(brute(rows, 85)) - len(stay) == between
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == brute(rows, 85)


def test_bounds_follow_the_threshold():
    assert (neardup.rows_for(85), neardup.agree_for(85)) == (5, 84)
    assert (neardup.rows_for(80), neardup.agree_for(80)) == (4, 75)
