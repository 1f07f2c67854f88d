"""Reports straight from the audits: newest ten, CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.functions.text import csv_escape, instant_text, quoted
from arbitrail.schema import CSV_HEADER, DEFAULT_RANGE_HOURS


def of_type(audits: DataFrame, audit_type: str, start: Column, end: Column) -> DataFrame:
    """Audits of one type with ``start <= timestamp <= end``."""
    return audits.where((F.col("audit_type") == audit_type) & F.col("timestamp").between(start, end))


def last_day(as_of: Column, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """The range asked for; what isn't given is the end at ``as_of`` and the start a day before the end."""
    end = as_of if end is None else end
    return (end - F.make_dt_interval(hours=F.lit(DEFAULT_RANGE_HOURS)) if start is None else start), end


def top(audits: DataFrame, audit_type: str, start: Column, end: Column, n: int = 10) -> DataFrame:
    """The newest ``n``; equal times by audit id. A top-k per task, then one merge."""
    return of_type(audits, audit_type, start, end).orderBy(F.desc("timestamp"), "audit_id").limit(n)


def csv_lines(audits: DataFrame, audit_type: str, start: Column, end: Column) -> DataFrame:
    """``line`` of each audit, unsorted, with ``timestamp`` and ``audit_id`` to sort by."""
    plain = [
        csv_escape(F.col("audit_id")),
        csv_escape(F.col("rule_id")),
        F.col("audit_type"),
        instant_text(F.col("timestamp")),
        quoted(F.col("reason")),
        csv_escape(F.col("source_topic")),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("partition", "offset", "parse_time_nano", "eval_time_nano", "total_time_nano")],
        quoted(F.col("source_event")),
        quoted(F.col("routed_event")),
    ]
    return of_type(audits, audit_type, start, end).select("timestamp", "audit_id", F.concat_ws(",", *plain).alias("line"))


def export_csv(audits: DataFrame, audit_type: str, start: Column, end: Column) -> DataFrame:
    """Header, then all lines newest first, as one globally sorted column.

    The sort is by range, so writing it as text gives part files whose concatenation is the export.
    """
    lines = csv_lines(audits, audit_type, start, end).withColumn("body", F.lit(1))
    header = audits.sparkSession.range(1).select(
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("audit_id"), F.lit(CSV_HEADER).alias("line"), F.lit(0).alias("body")
    )
    return header.unionByName(lines).orderBy("body", F.desc("timestamp"), "audit_id").select("line")


def export_name(audit_type: str, epoch_second: int) -> str:
    return f"audit_{audit_type.lower()}_{epoch_second}.csv"


def write_export(audits: DataFrame, audit_type: str, start: Column, end: Column, folder: str) -> None:
    export_csv(audits, audit_type, start, end).write.text(folder)
