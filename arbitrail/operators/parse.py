"""JSON text to a dynamic event root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.schema import PARSE_REASON, UNKNOWN_TOPIC, UNKNOWN_TYPE
from arbitrail.session import prepare

_BLANK = " \t\r\n"
#: A source of less than this for each task is too small for its own splits.
SPLIT_BYTES = 4 << 20


def as_raw_events(df: DataFrame) -> DataFrame:
    """Missing provenance becomes ``unknown``, 0, 0; byte values become text."""

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    known = {
        "topic": column("topic", F.lit(UNKNOWN_TOPIC)),
        "partition": column("partition", F.lit(0)).cast("int"),
        "offset": column("offset", F.lit(0)).cast("bigint"),
        "ts": column("ts", F.lit(None)).cast("timestamp"),
        "value": F.col("value").cast("string"),
    }
    return df.withColumns(known)


def spread(events: DataFrame) -> DataFrame:
    """Events over enough tasks for the fan-out: a source smaller than one split for each task is dealt out anew.

    It is dealt by time, partition and offset, so that a task meets few days and their files are time slices. A larger source keeps its
    splits, so nothing is shuffled before the fan-out. The size is the optimiser's estimate.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    order = [c for c in ("ts", "partition", "offset") if c in events.columns]
    if size >= n * SPLIT_BYTES:
        return events
    return events.repartitionByRange(n, *order) if order else events.repartition(n)


def parse_events(raw: DataFrame) -> DataFrame:
    """Adds ``root`` (VARIANT) and ``parsed``.

    ``parsed`` is false for text that is not JSON and for JSON whose top level is not an object.
    Nothing is filtered here: a filter on ``parsed`` would be pushed below and parse each text twice.
    """
    prepare(raw.sparkSession)
    rooted = as_raw_events(raw).withColumn("root", F.try_parse_json("value"))
    is_object = F.startswith(F.ltrim(F.col("value"), F.lit(_BLANK)), F.lit("{"))
    return rooted.withColumn("parsed", F.coalesce(F.col("root").isNotNull() & is_object, F.lit(False)))


def original_type(root: Column) -> Column:
    """The event's ``type`` field: ``unknown`` when absent, ``null`` when JSON null."""
    value = F.try_variant_get(root, "$.type", "variant")
    return (
        F.when(value.isNull(), F.lit(UNKNOWN_TYPE))
        .when(F.is_variant_null(value), F.lit("null"))
        .otherwise(F.coalesce(F.try_variant_get(root, "$.type", "string"), F.to_json(value)))
    )


def quarantine(raw: DataFrame) -> DataFrame:
    """The raw rows that cannot be evaluated, with the reason their audit shows."""
    return (
        parse_events(raw)
        .where(~F.col("parsed"))
        .select("topic", "partition", "offset", "ts", "value", F.lit(PARSE_REASON).alias("reason"))
    )
