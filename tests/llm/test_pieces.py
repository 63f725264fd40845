"""The lattice against the library's own Viterbi, and decoding against the texts."""

import dataclasses
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from linkloom.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    """The same table of pieces and scores, read by the library as a unigram model."""
    import public_tokenizers

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def by_library(library, vocabulary, text):
    """The best path of the library's lattice, unit by unit: it adds scores in single
    precision, where one unknown character (about -10**9) hides all others."""
    ids = []
    for unit in re.findall(pieces.UNIT, vocabulary.prepared(text)):
        ids += library.nbest_encode_as_ids(unit, 2)[0]
    return ids


def encoded(spark, rows, vocabulary, carry=("doc_id",)):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return pieces.encode(df, vocabulary, list(carry)).select("row.*", "ids")


def test_given_documents(spark, data_dir, vocabulary, library):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.encode(docs, vocabulary, ["doc_id"]).select("row.doc_id", "ids", pieces.decode(F.col("ids"), vocabulary).alias("back"))
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.back == texts[r.doc_id]
        assert r.ids == by_library(library, vocabulary, texts[r.doc_id])


def test_without_frequent_units(spark, vocabulary, library, monkeypatch):
    """All units take the join when no unit is known to every worker; many blocks."""
    monkeypatch.setattr(pieces, "HEAD_UNITS", 0)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 700)
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choices("abcdehnorst", k=rng.randrange(1, 30))) for _ in range(20))) for k in range(12)]
    for r in encoded(spark, rows, vocabulary).collect():
        assert r.ids == by_library(library, vocabulary, rows[r.doc_id][1])


def test_odd_texts(spark, vocabulary, library):
    long = "".join(random.Random(4).choices("abcdefghij", k=3000))
    rows = [
        (1, None), (2, ""), (3, " "), (4, "   two  spaces "), (5, "line\n\nfeeds\n"), (6, "中\U0001f600 กx"), (7, long),
        (8, "same text"), (8, "same text"), (None, "no id"), (9, "tab\tand nbsp"),
    ]
    got = encoded(spark, rows, vocabulary)
    back = got.select("doc_id", "ids", pieces.decode(F.col("ids"), vocabulary).alias("back")).collect()
    assert len(back) == len(rows)
    assert sorted((r.doc_id or 0, r.back) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    ids = {r.doc_id: r.ids for r in back}
    assert ids[1] == ids[2] == []
    assert ids[7] == by_library(library, vocabulary, long)
    assert ids[6] == by_library(library, vocabulary, rows[5][1])


def plain_path(vocabulary, unit):
    """Viterbi over the whole unit, in double precision."""
    table = {p: (s, i) for p, s, i in vocabulary.pieces}
    best = [(0.0, None, None)] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            found = table.get(unit[start:end]) or ((vocabulary.unknown_score, -1 - ord(unit[start])) if end - start == 1 else None)
            if found and (best[end] is None or best[start][0] + found[0] > best[end][0]):
                best[end] = (best[start][0] + found[0], start, found[1])
    ids, at = [], len(unit)
    while at:
        ids.append(best[at][2])
        at = best[at][1]
    return vocabulary.expand(ids[::-1])


def test_very_long_units(spark, vocabulary):
    """Units are cut where no piece reaches across: the parts' paths are the unit's."""
    rng = random.Random(6)
    pieces_ = {p for p, _, _ in vocabulary.pieces}
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000))
    parts = pieces._cut(letters, pieces_, vocabulary.longest)
    assert "".join(parts) == letters and max(map(len, parts)) < 300
    short = letters[:1500]
    whole = plain_path(vocabulary, pieces.SPACE + short)
    assert [i for part in pieces._cut(pieces.SPACE + short, pieces_, vocabulary.longest) for i in plain_path(vocabulary, part)] == whole
    rows = [(1, letters), (2, "a b " * 250_000), (3, short), (4, "")]
    got = encoded(spark, rows, vocabulary).select("doc_id", "ids", pieces.decode(F.col("ids"), vocabulary).alias("back")).collect()
    assert {r.doc_id: r.back for r in got} == dict(rows)
    assert {r.doc_id: r.ids for r in got}[3] == whole


def test_clashing_columns_and_empty_table(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, ids int, block string")
    row = pieces.encode(df, vocabulary, df.columns).select("row.*").first()
    assert row.asDict() == {"doc_id": 1, "text": "a b", "ids": 7, "block": "x"}
    assert pieces.encode(df.limit(0), vocabulary, ["doc_id"]).count() == 0


def test_query_and_stage_check_the_round_trip(spark, tmp_path, data_dir):
    import corpus_pipeline

    texts = {1: "two  spaces and 中\U0001f600", 2: None, 3: "a▁b", 4: " lead", 5: "", 6: "▁"}
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    assert {r.doc_id: r.round_trip for r in pieces.piece_query(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.round_trip for r in corpus_pipeline.tokens(spark, docs, data_dir).collect()} == want
    rows = pieces.piece_query(spark, data_dir).collect()
    assert rows and all(r.round_trip for r in rows)


def test_texts_are_packed_once(spark, vocabulary):
    """The blocks' distinct units come from the packed texts, not from a second pass over the table."""
    docs = spark.createDataFrame([(k, f"word{k} and other{k % 3}") for k in range(20)], "doc_id long, text string")
    got = pieces.encode(docs, vocabulary, ["doc_id"])
    assert len(got.collect()) == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "ObjectHashAggregate" not in plan


def test_fold_of_edges_in_small_lots(spark, vocabulary, monkeypatch):
    """Units whose edges come in several batches and are folded in several lots."""
    rng = random.Random(8)
    units = [pieces.SPACE, "\n\n", "中\U0001f600", *("".join(rng.choices("aeinst,中", k=rng.randrange(1, 90))) for _ in range(60))]
    units = sorted(set(units))
    edges = pieces.edges_of(spark.createDataFrame([(u, k) for k, u in enumerate(units)], "unit string, place int").coalesce(1), vocabulary).toArrow()
    for lot in (1, 500, 10**6):
        monkeypatch.setattr(pieces, "EDGES", lot)
        found = [x for t in pieces._folded(vocabulary)(edges.to_batches(max_chunksize=37)) for x in t.to_pylist()]
        assert [x["place"] for x in found] == list(range(len(units)))
        assert all(x["ids"] == plain_path(vocabulary, x["unit"]) for x in found)
    with pytest.raises(ValueError, match="follow each other"):
        list(pieces._folded(vocabulary)(edges.slice(0, edges.num_rows - 1).take(list(range(0, edges.num_rows - 1, 2))).to_batches()))


def test_units_without_the_pattern(vocabulary):
    """Texts whose blanks and line feeds stand alone are split plainly, into the same units."""
    rng = random.Random(9)
    texts = ["", " ", "\n", "a", "a b\nc", "a \n b\n", " a", "a  b", "\na", "a\n\nb ", "a▁b c"] + ["".join(rng.choices("ab \n▁", (9, 9, 4, 2, rng.random() < 0.2), k=rng.randrange(1, 12))) for _ in range(3000)]
    for bare in (vocabulary, dataclasses.replace(vocabulary, dummy_space=False)):
        units, _ = pieces._units_of(bare)
        assert all(units(t) == re.findall(pieces.UNIT, bare.prepared(t)) for t in texts)


def test_only_possible_lengths_are_looked_up(spark, vocabulary):
    lengths = {r.begin: r.lengths for r in pieces.length_table(spark, vocabulary).collect()}
    assert all(p[:3] not in lengths or len(p) in lengths[p[:3]] for p, _, _ in vocabulary.pieces)
    assert all(p[:3] in lengths for p, _, _ in vocabulary.pieces if len(p) > 2)
