"""Hourly rollups of audits, recomputed over whole hours and merged by replacing those hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.functions.text import hour_key
from arbitrail.schema import BACKFILL_HOURS, ERRORED, MATCHED, RECOMPUTE_HOURS, UNMATCHED


def rule_rollups(audits: DataFrame, *by: str) -> DataFrame:
    """Counts and latency sums per (hour, rule), and per further columns; one shuffle of partially aggregated rows."""
    kind = F.col("audit_type")
    return audits.groupBy(*by, hour_key(F.col("timestamp")).alias("hour"), "rule_id").agg(
        F.count_if(kind == MATCHED).alias("matched"),
        F.count_if(kind == UNMATCHED).alias("unmatched"),
        F.count_if(kind == ERRORED).alias("errored"),
        F.count("*").alias("count"),
        F.coalesce(F.sum("parse_time_nano"), F.lit(0)).alias("parse_sum"),
        F.coalesce(F.sum("eval_time_nano"), F.lit(0)).alias("eval_sum"),
        F.coalesce(F.sum("total_time_nano"), F.lit(0)).alias("total_sum"),
    )


def hour_rollups(audits: DataFrame) -> DataFrame:
    """Distinct source records per hour, in two steps so that a busy hour is spread over all tasks."""
    distinct = audits.select(hour_key(F.col("timestamp")).alias("hour"), "source_topic", "partition", "offset").distinct()
    return distinct.groupBy("hour").agg(F.count("*").alias("messages"))


#: Registers of a sketch of distinct messages, as a power of two, and three standard errors of an estimate from merged ones.
SKETCH_SIZE = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_SIZE / 2)


def message_sketch(topic: str = "source_topic") -> Column:
    """An aggregate: the sketch of the source records of its rows. Sketches of any rows can be merged, and a record in several counts once."""
    return F.hll_sketch_agg(F.xxhash64(topic, "partition", "offset"), SKETCH_SIZE)


def hour_sketches(audits: DataFrame, *by: str) -> DataFrame:
    """(hour, sketch) of the distinct source records, and by further columns; only sketches travel."""
    return audits.groupBy(*by, hour_key(F.col("timestamp")).alias("hour")).agg(message_sketch().alias("sketch"))


def distinct_messages(sketches: DataFrame, *by: str) -> DataFrame:
    """(messages): an estimate of the distinct source records of all sketches, within ``SKETCH_ERROR`` of it in 997 of 1000 cases.

    Sums of hourly counts hold a record of two hours twice; merged sketches don't. 0 without sketches; missing ones count nothing.
    """
    found = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.coalesce(found, F.lit(0)).cast("bigint").alias("messages"))


def window_start(as_of: Column, hours: int) -> Column:
    """Start of the trailing window, floored to the hour so that no bucket is recomputed in part."""
    return F.date_trunc("hour", as_of - F.make_dt_interval(hours=F.lit(hours)))


def recompute(audits: DataFrame, as_of: Column, hours: int = RECOMPUTE_HOURS) -> tuple[DataFrame, DataFrame]:
    """Both rollups of the hours from the window's start on."""
    recent = audits.where(F.col("timestamp") >= window_start(as_of, hours))
    return rule_rollups(recent), hour_rollups(recent)


def backfill(audits: DataFrame, as_of: Column, hours: int = BACKFILL_HOURS) -> tuple[DataFrame, DataFrame]:
    return recompute(audits, as_of, hours)


def merged(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """``existing`` with every bucket that ``fresh`` holds replaced, never added to.

    Buckets are matched on (hour, rule) or hour; both sides are rollups, far smaller than the audits.
    """
    keys = [c for c in ("hour", "rule_id") if c in fresh.columns]
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)
