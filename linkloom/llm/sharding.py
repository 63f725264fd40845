"""Sharding by jump consistent hashing, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.base import register, table
from linkloom.session import cut_lineage

#: Fixed values of the published algorithm (a 64-bit linear congruential step).
MULTIPLIER = 2862933555777941757
WORD = 18446744073709551616
HIGH_BITS = 8589934592  # 2**33: leaves the upper 31 bits
DRAW = 2147483648  # 2**31
SHARDS = 8
#: Distinct rows that one numbering group should hold.
GROUP_ROWS = 50_000
#: Rows of one repeated row that are written out by one task at a time.
REPEAT_CHUNK = 20_000


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to ``shards - 1``; null counts as key 0.

    A jump moves the key to a later shard with the chance that keeps shards
    even; the last jump before ``shards`` decides. So one more shard either takes
    a key or leaves it where it is. The state is exact: unsigned 64-bit values as
    decimals. At most ``shards`` jumps can happen, about ln(shards) do.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    whole = F.coalesce(key.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    start = F.when(whole < 0, (whole + F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(whole)
    state = F.struct(start.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        product = (s["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)).cast("decimal(38,0)")
        k = (product % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k / F.lit(str(HIGH_BITS)).cast("decimal(10,0)")).cast("bigint")
        reach = (s["j"] + 1).cast("double") * (F.lit(float(DRAW)) / (high + 1).cast("double"))
        moved = F.struct(k.alias("k"), s["j"].alias("b"), F.floor(reach).cast("bigint").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump)
    return end["b"].cast("int")


def with_shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``docs`` with a column ``name``; a column of that name is replaced.

    Integer keys are taken as they are, others by their 64-bit hash. Rows stay
    where they are: no shuffle, and a hot key is only a hot shard.
    """
    kind = dict(docs.dtypes)[key]
    value = F.col(key).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))
    return docs.withColumn(name, jump_shard(value, shards))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> None:
    """Parquet folders ``shard=0`` ..., each written by the tasks that hold its rows."""
    with_shard(docs, key, shards, name).write.partitionBy(name).parquet(path)


def numbered(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with gapless numbers from 0 within each shard.

    Order is that of a digest of the whole row, so it depends on the rows only.
    Equal rows are counted first and written out again at the end (in chunks), so
    a row that a third of the table repeats is one row on the way. The digest's
    first digits cut each shard into as many groups as the count asks for; group
    totals give where each group starts, and windows run over one group each.
    """
    columns = rows.columns
    digest = F.md5(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns if c != shard])))
    same = rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_key", digest)
    same = cut_lineage(same, "shard-rows")
    digits = 0
    while same.count() > GROUP_ROWS * 16**digits:
        digits += 1
    grouped = same.withColumn("_group", F.substring("_key", 1, digits))
    totals = grouped.groupBy(shard, "_group").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(shard, "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(shard, "_group").orderBy("_key", *[c for c in columns if c != shard])
    placed = grouped.join(starts, [shard, "_group"]).withColumn(
        "_first", F.col("_start") + F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / REPEAT_CHUNK))).alias("_chunk")
    chunks = placed.select(*columns, "_n", "_first", chunk)
    low = F.col("_chunk") * REPEAT_CHUNK
    number = F.explode(F.sequence(low, F.least(low + REPEAT_CHUNK, F.col("_n")) - 1))
    return chunks.select(*columns, "_first", number.alias("_k")).select(*columns, (F.col("_first") + F.col("_k")).alias(slot))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What each row of ``docs`` (``doc_id``, ``text``) is to its shard.

    ``size`` is UTF-8 bytes plus 1 (null text: 1), ``text_crc32`` of the UTF-8
    bytes (null as empty), ``slot`` counts from 0 in each shard, ``grown_shard``
    is the shard with one shard more: the old one or the new last one. Rows with
    a null doc_id have key 0. Repeated rows each have their own slot.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = numbered(with_shard(own, "doc_id", shards))
    return with_shard(placed, "doc_id", shards + 1, "grown_shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


@register("op7_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document."""
    return shard_table(table(spark, sf_dir, "documents"))
