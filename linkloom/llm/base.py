"""Shared pieces: tables, Arrow batch size, ASCII lower-casing, registration."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows handed to a Python worker at once; texts may be 100 KB and more.
BATCH_ROWS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = str.maketrans(UPPER, UPPER.lower())
#: Words between white space (space, tab, line feed, vertical tab, form feed, return).
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of letters and digits: anything but ASCII signs and controls.
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also bounds the Arrow batches of the session."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(text: str) -> str:
    return text.translate(LOWER_TABLE)


def ascii_lower_col(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``fn`` over every Arrow batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return run


def annotate(df: DataFrame, column: str, carry: list[str], fn, out: str) -> DataFrame:
    """``row`` (a struct of the columns ``carry``) and what ``fn`` makes of a text column.

    ``fn`` takes the texts of a batch (null as None) and returns a list of values
    for each field of ``out``, a DDL schema. Since the carried columns stay inside
    ``row``, no name can clash. Rows are neither moved nor keyed, so repeated rows
    and null keys need no care.
    """
    small_batches(df.sparkSession)
    fields = StructType.fromDDL(out)
    row = F.struct(*[df[f"`{c}`"] for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    given = df.select(row.alias("row"), df[f"`{column}`"].cast("string").alias("value"))
    schema = StructType([StructField("row", given.schema["row"].dataType), *fields.fields])
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    names = ["row", *fields.names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch.column("value").to_pylist())
        arrays = [pa.array(v, t) for v, t in zip(made, types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=names)

    return given.mapInArrow(by_batch(run), schema)
