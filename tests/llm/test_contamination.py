"""Decontamination against a plain search, and over several passes."""

import hashlib
import random

import pytest

from linkloom.llm import contamination
from linkloom.llm.base import PLAIN_WORD, ascii_lower


def brute(text, bench):
    words = PLAIN_WORD.findall(ascii_lower(text or ""))
    hit, items = set(), set()
    for item, t in bench:
        own = PLAIN_WORD.findall(ascii_lower(t or ""))
        k = min(10, len(own))
        for a in range(len(own) - k + 1) if own else []:
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[a : a + k]:
                    hit.update(range(p, p + k))
                    if item is not None:
                        items.add(str(item))
    return len(words), len(hit), sorted(items)


def case():
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    bench = [(k, draw(25)) for k in range(12)] + [(20, "one"), (21, "Two Three"), (22, None), (23, "?!"), (None, "no id"), (0, "another text")]
    docs = [(1, None), (2, ""), (3, "x ONE-two, three"), (4, "no id here"), (4, "no id here"), (None, "another TEXT"), (5, "é one")]
    for k in range(30):
        t = bench[k % 12][1].split(" ")
        docs.append((100 + k, draw(15) + " " + " ".join(t[k % 7 : k % 7 + 12]).upper() + ", " + draw(5)))
    return docs, bench


@pytest.mark.parametrize("block_chars", [contamination.BLOCK_CHARS, 1500])
def test_scan(spark, block_chars):
    rows, bench = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS spans")
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = contamination.scan(docs, items, ["doc_id", "text", "spans"], block_chars).collect()
    assert len(found) == len(rows)
    for r in found:
        n, hit, ids = brute(r.row.text, bench)
        assert (r.n_words, sum(b - a for a, b in r.spans), r["items"]) == (n, hit, ids)
        assert r.row.spans == "x"


def test_removal(spark):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    bad = "Start: w1 w2 w3 W4 w5 w6, w7 w8 w9 w10 w11. End"
    docs = spark.createDataFrame([(1, bad, 3), (2, "clean", 4), (None, None, 5)], "doc_id long, text string, items int")
    assert sorted(r["items"] for r in contamination.decontaminated(docs, items).collect()) == [4, 5]
    cut = {r.doc_id: r.text for r in contamination.decontaminated(docs, items, "spans").collect()}
    assert cut == {1: "Start: . End", 2: "clean", None: None}
    assert contamination.decontaminated(docs, items.limit(0)).count() == 3
    assert contamination.decontaminated(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        contamination.decontaminated(docs, items, "lines")


def test_digest_of_no_items(spark, data_dir):
    from linkloom.llm.base import QUERIES

    rows = QUERIES["op6_benchmark_decontamination"](spark, data_dir).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == empty) == (r.n_items == 0) for r in rows) and any(r.contaminated for r in rows)
