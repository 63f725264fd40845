"""Session settings and shared working storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: what Python makes of one is several times as large, and each
#: core of an executor has a Python process. 10,000 pages (Spark's bound) are 40 MB.
ARROW_BATCH = "4m"


def build_session(app: str = "linkloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Cluster sizing (executors, memory, shuffle partitions) stays with the
    caller; AQE coalesces small shuffles and splits skewed joins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BATCH,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC in every operator; batches for Python are small."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where a session names none (tests, a laptop) a fresh temporary folder is
    used; a cluster must name one, since executors have to reach it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = os.environ.get("LINKLOOM_TMP")
    if not fallback:
        fallback = tempfile.mkdtemp(prefix="spark-")
        os.environ["LINKLOOM_TMP"] = fallback
    return fallback


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/linkloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs, or where an action has to
    surface a failure at a known place. A written table survives the loss of
    any executor.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
