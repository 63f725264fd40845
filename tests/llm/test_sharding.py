"""Jump hashing against the published loop, and numbering against its law."""

from collections import Counter
import zlib

from linkloom.llm import sharding


def jump(key, shards):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def check(rows, given, shards):
    assert len(rows) == len(given)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, shards)
        assert r.grown_shard == jump(r.doc_id or 0, shards + 1)
        assert r.grown_shard in (r.shard, shards)
        slots.setdefault(r.shard, []).append(r.slot)
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))


def test_given_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    check(sharding.shard_table(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)


def test_odd_rows_many_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 10)
    monkeypatch.setattr(sharding, "REPEAT_CHUNK", 7)
    given = [(k, f"t{k}") for k in range(-60, 60)] + [(5, "same")] * 40 + [(None, None)] * 3 + [(None, ""), (2**63 - 1, "é"), (-(2**63), "x")]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS shard", "'a' AS slot", "2 AS size")
    check(sharding.shard_table(docs, 5).collect(), given, 5)
    again = sharding.shard_table(docs.repartition(3), 5)
    assert sorted(map(str, again.collect())) == sorted(map(str, sharding.shard_table(docs, 5).collect()))
    assert sharding.shard_table(docs.limit(0)).count() == 0


def test_text_keys_move_only_to_the_new_shard(spark, tmp_path):
    docs = spark.range(3000).selectExpr("concat('k', id) AS name", "id AS value")
    old = {r.name: r.shard for r in sharding.with_shard(docs, "name", 9).collect()}
    new = {r.name: r.shard for r in sharding.with_shard(docs, "name", 10).collect()}
    moved = [k for k in old if old[k] != new[k]]
    assert all(new[k] == 9 for k in moved) and 200 < len(moved) < 400
    sharding.write_shards(docs, str(tmp_path / "out"), "name", 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3000 and back.select("shard").distinct().count() == 4
