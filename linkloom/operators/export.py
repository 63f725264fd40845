"""Report files: capped CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.functions import text as tx
from linkloom.operators.reports import recs_with_articles

# --- fixed values -----------------------------------------------------------
EXPORT_CAP = 10_000
CSV_HEADER = (
    "source_title,source_url,anchor_text,target_title,target_url,"
    "severity,confidence,matching_approach,status,recommendation_id"
)
BOM = "﻿"
# ----------------------------------------------------------------------------


class TooManyRows(ValueError):
    """An export above the cap is refused, not cut."""


def plain_number(c: Column) -> Column:
    """Shortest decimal text, without exponent or trailing ``.0``."""
    fixed = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    text = F.when(F.abs(c) < 1e-3, fixed).otherwise(c.cast("string"))
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(text)


def _quoted(c: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n]'), doubled).otherwise(c)


def csv_line(joined: DataFrame) -> Column:
    """The ten report columns of a joined recommendation as one CSV record."""
    empty = F.lit("")
    cells = [
        tx.sanitize_cell(F.col("source_title")),
        tx.sanitize_cell(F.col("source_url")),
        tx.sanitize_cell(F.coalesce("anchor_text", empty)),
        tx.sanitize_cell(F.col("target_title")),
        tx.sanitize_cell(F.col("target_url")),
        F.col("severity"),
        plain_number(F.col("confidence")),
        F.coalesce("matching_approach", empty),
        F.col("status"),
        F.col("rec_id"),
    ]
    return F.concat_ws(",", *[_quoted(c) for c in cells])


def _guarded(recs: DataFrame, cap: int) -> None:
    # Reads at most cap + 1 rows.
    if recs.limit(cap + 1).count() > cap:
        raise TooManyRows(f"export exceeds {cap} rows; narrow the filters")


def _order() -> list[Column]:
    return [
        scoring.export_weight(F.col("severity")).asc(),
        F.col("confidence").desc(),
        F.col("rec_id").asc(),
    ]


def csv_lines(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Report lines in export order, one per recommendation (any number)."""
    joined = recs_with_articles(recs, articles)
    return joined.orderBy(*_order()).select(csv_line(joined).alias("value"))


def _csv_file(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Lines with the columns that order them, the header line first."""
    joined = recs_with_articles(recs, articles)
    rows = joined.select(
        F.lit(1).alias("_part"),
        scoring.export_weight(F.col("severity")).alias("_w"),
        (-F.col("confidence")).alias("_c"),
        F.col("rec_id").alias("_id"),
        csv_line(joined).alias("value"),
    )
    header = recs.sparkSession.range(1).select(
        F.lit(0).alias("_part"),
        F.lit(0).alias("_w"),
        F.lit(0.0).alias("_c"),
        F.lit("").alias("_id"),
        F.lit(BOM + CSV_HEADER).alias("value"),
    )
    return header.unionByName(rows)


def export_csv(recs: DataFrame, articles: DataFrame, path: str, cap: int = EXPORT_CAP) -> None:
    """One CSV file with BOM and header; refused above ``cap`` rows."""
    _guarded(recs, cap)
    # At most cap + 1 rows: a single file is safe here.
    (
        _csv_file(recs, articles)
        .repartition(1)
        .sortWithinPartitions("_part", "_w", "_c", "_id")
        .select("value")
        .write.text(path)
    )


def export_csv_parts(recs: DataFrame, articles: DataFrame, path: str) -> None:
    """The same report of any length as part files: joined in the order of their
    names they are the single file (one BOM and header, at the start)."""
    _csv_file(recs, articles).orderBy("_part", "_w", "_c", "_id").select("value").write.text(path)


def export_rows(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """The fifteen fields of the JSON report."""
    return recs_with_articles(recs, articles).select(
        F.col("rec_id").alias("id"),
        F.col("source_title").alias("sourceTitle"),
        F.col("source_url").alias("sourceUrl"),
        F.col("anchor_text").alias("anchorText"),
        F.col("target_title").alias("targetTitle"),
        F.col("target_url").alias("targetUrl"),
        "severity",
        "confidence",
        F.col("matching_approach").alias("matchingApproach"),
        "status",
        "type",
        "title",
        "description",
        "suggestion",
        F.col("created_at").alias("createdAt"),
    )


def export_json(recs: DataFrame, articles: DataFrame, path: str, cap: int = EXPORT_CAP) -> None:
    """One pretty-printed JSON array; refused above ``cap`` rows."""
    _guarded(recs, cap)
    rows = export_rows(recs, articles)
    key = F.struct(
        scoring.export_weight(F.col("severity")).alias("w"),
        (-F.col("confidence")).alias("c"),
        F.col("id").alias("i"),
        F.struct(*rows.columns).alias("row"),
    )
    # Bounded by the cap checked above.
    listed = rows.agg(F.sort_array(F.collect_list(key)).alias("_rows"))
    listed.select(
        F.to_json(
            F.transform("_rows", lambda x: x["row"]),
            {"pretty": "true", "ignoreNullFields": "false"},
        ).alias("value")
    ).coalesce(1).write.text(path)


def export_json_parts(recs: DataFrame, articles: DataFrame, path: str) -> None:
    """The same report of any length: part files of one JSON object a line, in order."""
    rows = export_rows(recs, articles)
    order = [scoring.export_weight(F.col("severity")), F.col("confidence").desc(), F.col("id")]
    rows.orderBy(*order).write.option("ignoreNullFields", "false").json(path)
