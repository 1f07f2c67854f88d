"""Event sources and text sinks, batch and streaming, behind one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitrail.operators.parse import as_raw_events
from arbitrail.schema import RAW_EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw events kept as parquet files."""
    return as_raw_events(spark.read.schema(RAW_EVENTS).parquet(path))


def stream_events(spark: SparkSession, path: str, schema=RAW_EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def kafka_options(servers: str, topic: str, events_per_batch: int | None = None) -> dict[str, str]:
    """Options of the Kafka connector: from the earliest offset, committed records only."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
    }
    if events_per_batch:
        options["maxOffsetsPerTrigger"] = str(events_per_batch)
    return options


def kafka_events(spark: SparkSession, servers: str, topic: str, events_per_batch: int | None = None) -> DataFrame:
    """A Kafka topic as raw events; needs the connector on the class path."""
    records = spark.readStream.format("kafka").options(**kafka_options(servers, topic, events_per_batch)).load()
    return as_raw_events(records.withColumnRenamed("timestamp", "ts"))


def kafka_records(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed text records for a Kafka sink; equal keys reach one partition there."""
    return rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
