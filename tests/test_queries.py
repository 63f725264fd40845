"""Every registered query against its SQL on the smallest driver tables."""

import re

import duckdb
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.session import work_path
from linkloom.sources import feeds

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Only rows to show where no SQL can be given; some have none at this size.
MAY_BE_EMPTY = {"keyword_fuzzy", "best_window", "liveness_stream"}


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"source_id", "target_id", "confidence"} <= set(df.columns)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, data_dir, name):
    problem = compare(spark, con, data_dir, name, QUERIES[name], SQL.get(name))
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_pages_stored_twice_under_one_url(spark):
    """Alike pages of one URL are one article and still two rows, each with its own status."""
    folder = work_path(spark, "twice")
    page = "<title>A title</title><article>Some text</article>"
    rows = [(k, f"https://e.example.com/en/{u}", page + f"<!-- {k} -->") for k, u in ((1, 1), (2, 1), (6, 2), (22, 1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    for name in ("ingest", "incremental_ingest"):
        assert compare(spark, con, folder, name, QUERIES[name], SQL[name]) is None


def _odd_documents(spark, data_dir):
    """A folder whose documents are given ones and two empty ones, of both kinds of names."""
    folder = work_path(spark, "odd")
    given = spark.read.parquet(f"{data_dir}/documents.parquet")
    empty = given.limit(2).selectExpr("doc_id + 1000000 AS doc_id", "'' AS text", "lang", "source", "n_chars * 0 AS n_chars")
    rows = given.filter("doc_id < 40").unionByName(empty.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    rows.select(given.columns).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data_dir}/{name}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["embed_missing", "persist_embeddings", "upload_problems"])
def test_empty_documents(spark, data_dir, name):
    folder, con = _odd_documents(spark, data_dir)
    assert compare(spark, con, folder, name, QUERIES[name], SQL[name]) is None


def test_empty_files_are_refused(spark):
    files = spark.createDataFrame([("a.md", 0), ("b.md", 1), ("c.txt", 0), ("d.txt", 1)], "name string, length long")
    assert {r.name: r.problem for r in feeds.upload_problems(files).collect()} == {
        "a.md": 'File "a.md" is empty', "c.txt": 'File "c.txt" is empty', "d.txt": 'File "d.txt" has unsupported extension ".txt"'}


@pytest.mark.parametrize("name", ["semantic_targets", "semantic_fill"])
def test_bodies_are_shuffled_once(spark, data_dir, name):
    """F7, F8: the texts go through one exchange, not one for every join."""
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, data_dir)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)
    assert len(exchanges) > 5 and sum(bool(re.search(r"\b(text|body)#", x)) for x in exchanges) == 1
