"""The pipeline against the same stages in plain Python over whole tables."""

from test_contamination import brute as hits
from test_line_dedup import brute as cleaned
from test_neardup import brute as groups
from test_pieces import by_library

import corpus_pipeline
from linkloom.llm import repetition


def plain(rows, bench):
    """Rows (doc_id, text, lang, source) that each stage leaves."""
    rows = [r for r in rows if repetition.measure(r[1])[-1]]
    texts = cleaned([(r[3], r[1]) for r in rows])
    rows = [(r[0], t, r[2], r[3]) for r, t in zip(rows, texts, strict=True)]
    root = groups([(r[0], r[1]) for r in rows], corpus_pipeline.NEAR_PERCENT)[0]
    rows = [r for r in rows if root[r[0]] == r[0]]
    return [r for r in rows if not hits(r[1], bench)[1]]


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns = docs.columns
    given = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    want = {r[0]: r for r in plain(given, bench)}
    assert 0 < len(want) < len(given)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data_dir)
        assert docs.columns == columns
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: r[1] for k, r in want.items()}


def test_run(spark, data_dir):
    """The last stage's ids spell the texts that the others leave."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    import public_tokenizers
    from linkloom.llm import pieces

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = False
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    given = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, data_dir).collect()
    want = {r[0]: r for r in plain(given, bench)}
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert (r.lang, r.source, r.n_tokens) == (want[r.doc_id][2], want[r.doc_id][3], len(r.ids))
        assert r.ids == by_library(library, pieces.load_vocabulary(), want[r.doc_id][1])


def test_stages_of_odd_tables(spark, data_dir):
    """Nulls, repeats and an empty table go through every stage."""
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data_dir)
        got = sorted((r.doc_id or 0) for r in docs.collect())
        assert got == ([0, 1] if part else [])
