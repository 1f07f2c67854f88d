"""The batch operators as Structured Streaming jobs.

One micro-batch reads the rule table anew (rule changes need no restart), writes its audits to a folder of
its own, and takes the routed events from what it has just written, so nothing is evaluated twice and a
replayed batch overwrites itself in both places. The checkpoint moves on only after both writes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbitrail.functions import keys
from arbitrail.functions.keys import event_id
from arbitrail.operators.audit import audit_json, audits, read_audit_json, routed_events
from arbitrail.operators.parse import as_raw_events, quarantine, spread
from arbitrail.operators.predicates import ACCEPTED
from arbitrail.operators.rollup import rule_rollups
from arbitrail.operators.rules import Snapshot, load_errors, take_snapshot
from arbitrail.schema import AUDITS, ERRORED, MATCHED, RULE_PARSE, RULE_ROLLUPS
from arbitrail.session import folder_exists, one_writer
from arbitrail.sources.events import kafka_records
from arbitrail.sources.store import AuditStore, first_of_each


def stream_id(events: DataFrame) -> str:
    """The identity of the running stream: Spark's own, which its checkpoint keeps; ``batch`` outside a stream."""
    return events.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def process_batch(
    events: DataFrame,
    batch_id: int,
    store: AuditStore,
    load_rules: Callable[[], DataFrame],
    run_seq: int = 1,
    event_schema: str | None = None,
    narrow: bool = False,
    json_sink: bool = False,
    stream: str | None = None,
    topics: Callable[[str, DataFrame, str, int], None] | None = None,
) -> None:
    """Evaluates and stores one batch; safe to call again with the same batch id of the same stream.

    Its tables are published together, by one commit entry: a batch that stopped half way isn't seen in any of them. Rules that can't be evaluated
    as they are go to the table of load errors of their version.

    ``topics`` gets (topic, keyed text records, stream, batch id) of routed events and audits, for a topic or ``file_topics``.
    With ``narrow`` reason, source and routed text stay out of the audits; ``full_audits`` makes them again from events and
    the stored rule texts.
    """
    stream = stream or stream_id(events)
    events = as_raw_events(events).persist()  # the raw records only: read once, used for both writes
    snapshot = None
    try:
        if events.isEmpty():
            return
        rules = load_rules()
        snapshot = take_snapshot(rules, event_schema)
        if not store.knows_version(snapshot.version):
            store.write_load_errors(load_errors(rules, event_schema).where(F.col("verdict") != ACCEPTED), snapshot.version)
            store.write_rule_texts(snapshot.texts, snapshot.version)
        stamped = spread(events).withColumn("processed_at", F.lit(datetime.now(timezone.utc)))
        batch = store.begin(run_seq, batch_id, stream)
        written = batch.audits(audits(stamped, snapshot, reasons=not narrow, source=not narrow))
        batch.table("routed_events", routed_events(written))
        batch.table("quarantine", quarantine(events))
        if json_sink:
            batch.table("audit_json", audit_json(written))
        if topics:
            topics("routed_events", kafka_records(routed_events(written), "event_id", "routed_event"), stream, batch_id)
            topics("audits", kafka_records(audit_json(written), "event_id", "audit_json"), stream, batch_id)
        batch.publish()
    finally:
        events.unpersist()
        if snapshot:
            snapshot.release()


def process_or_set_aside(
    events: DataFrame,
    batch_id: int,
    store: AuditStore,
    load_rules: Callable[[], DataFrame],
    attempts: int = 3,
    most_broken: int = 20,
    run_seq: int = 1,
    event_schema: str | None = None,
    stream: str | None = None,
    **options,
) -> None:
    """``process_batch``, tried several times; then without the records that break it, which go to quarantine with their error.

    They are found by halving the batch by offset, partition and topic and evaluating the halves without storing anything. If
    the whole batch can be evaluated, or more than ``most_broken`` records can't, the fault isn't a record's: the error is raised and nothing
    is set aside.
    """
    stream = stream or stream_id(events)
    run = lambda rows: process_batch(rows, batch_id, store, load_rules, run_seq=run_seq, event_schema=event_schema, stream=stream, **options)
    fault = None
    for _ in range(attempts):
        try:
            return run(events)
        except PySparkException as error:
            fault = error
    placed = as_raw_events(events)
    snapshot = take_snapshot(load_rules(), event_schema)
    try:
        broken = _broken_records(placed, snapshot, most_broken)
    finally:
        snapshot.release()
    if not broken or len(broken) > most_broken:
        raise fault
    rows = [(t, p, o, None, None, f"Record breaks its batch: {reason}") for t, p, o, reason in broken]
    aside = events.sparkSession.createDataFrame(rows, "topic string, partition int, offset bigint, ts timestamp, value string, reason string")
    good = placed
    for topic, partition, offset, _ in broken:
        good = good.where(~((F.col("offset") == offset) & (F.col("partition") == partition) & (F.col("topic") == topic)))
    run(good)
    store.write_part("quarantine", aside, run_seq, batch_id, f"{stream}/broken")


def _broken_records(events: DataFrame, snapshot: Snapshot, enough: int) -> list[tuple[str, int, int, str]]:
    """(topic, partition, offset, error) of records that can't be evaluated, one more than ``enough`` at most."""
    found: list[tuple[str, int, int, str]] = []

    def fault(part: DataFrame) -> PySparkException | None:
        try:
            audits(part, snapshot).write.format("noop").mode("overwrite").save()
        except PySparkException as error:
            return error
        return None

    def search(part: DataFrame, within: dict[str, list], error: PySparkException) -> None:
        name = next((c for c, values in within.items() if values[0] != values[-1]), None)
        if name is None:
            found.append((within["topic"][0], within["partition"][0], within["offset"][0], str(error).split("\n")[0][:500]))
            return
        values = within[name]
        if name == "topic":
            first, second = values[: len(values) // 2], values[len(values) // 2 :]
            half = F.col(name).isin(first)
        else:
            middle = (values[0] + values[1]) // 2
            first, second = [values[0], middle], [middle + 1, values[1]]
            half = F.col(name) <= middle
        of_first = fault(part.where(half))
        if of_first:
            search(part.where(half), {**within, name: first}, of_first)
        of_second = fault(part.where(~half)) if of_first else error  # one of both halves has it
        if of_second and len(found) <= enough:
            search(part.where(~half), {**within, name: second}, of_second)

    whole = fault(events)
    if whole:
        first, last, low, high, topics = events.agg(F.min("offset"), F.max("offset"), F.min("partition"), F.max("partition"), F.collect_set("topic")).first()
        search(events, {"offset": [first, last], "partition": [low, high], "topic": sorted(topics)}, whole)
    return found


def file_topics(folder: str) -> Callable[[str, DataFrame, str, int], None]:
    """Topics as folders of keyed records; a replayed batch replaces its own."""

    def write(topic: str, records: DataFrame, stream: str, batch_id: int) -> None:
        records.write.mode("overwrite").parquet(f"{folder}/{topic}/stream={stream}/batch_id={batch_id}")

    return write


def start(
    events: DataFrame,
    store: AuditStore,
    load_rules: Callable[[], DataFrame],
    checkpoint: str,
    interval: str | None = None,
    **options,
) -> StreamingQuery:
    """Starts the evaluation; without ``interval`` it takes what is there and ends. A record that breaks its batch is set aside."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: process_or_set_aside(batch, batch_id, store, load_rules, **options)
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def start_rollups(audit_rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts and latency sums per hour and rule of a stream of audits: each batch keeps its own sums.

    No audit is too late for its hour, however the stream is cut into batches; a replayed batch replaces its sums. Deliver each
    audit once (``start_dedup``).
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        rule_rollups(batch).write.mode("overwrite").parquet(f"{folder}/stream={stream_id(batch)}/batch_id={batch_id}")

    return audit_rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


def streamed_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all batches; a row for each batch, hour and rule is read."""
    parts = spark.read.schema(RULE_ROLLUPS).parquet(folder)
    return parts.groupBy("hour", "rule_id").agg(*[F.sum(c).alias(c) for c in RULE_ROLLUPS.fieldNames() if c not in ("hour", "rule_id")])


def start_dedup(audit_rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each audit once, however often, in whatever batch and order its record comes.

    A batch leaves out what earlier batches have kept; as an audit never changes its time, only its days are compared, and
    only what names an audit is read of them. Batch and kept audits meet in one exchange. ``deduplicated`` reads the result, which leaves out the
    ids that can be made; the stream's rows may do so too (``keys.without_ids``).
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, stream_id(batch)
        mine = f"{folder}/stream={stream}/batch_id={batch_id}"
        rows = keys.without_ids(batch).withColumns({"day": F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none")), "kept": F.lit(False)})
        if folder_exists(spark, folder):
            days = [r[0] for r in rows.select("day").distinct().collect()]
            kept = spark.read.schema(_KEPT).parquet(folder).where(F.col("day").isin(days) & ~((F.col("stream") == stream) & (F.col("batch_id") == batch_id)))
            kept = kept.where(keys.has_id()).select("audit_id", "rule_id", "source_topic", "partition", "offset", keys.IDS_MADE, F.lit(True).alias("kept"))
            rows = rows.unionByName(kept, allowMissingColumns=True)
        new = first_of_each(rows, F.desc("kept"), F.desc_nulls_last("processed_at"), F.desc("rule_version"), "code").where("not kept").drop("kept")
        ordered = new.sortWithinPartitions("day", "timestamp", "source_topic", "partition", "offset")
        with one_writer(spark):
            ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(mine)

    return audit_rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


_KEPT = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in AUDITS)}, {keys.IDS_MADE} tinyint, stream string, batch_id bigint, day string"


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """The audits that ``start_dedup`` has kept."""
    return keys.with_ids(spark.read.schema(_KEPT).parquet(folder)).select(*AUDITS.fieldNames())


def start_audit_messages(messages: DataFrame, store: AuditStore, checkpoint: str, run_seq: int = 1) -> StreamingQuery:
    """A stream of audit messages (``audit_json``) into the store; unreadable ones are kept in its part ``audit_poison``.

    What a message doesn't carry follows from what it does: the event's id from topic, partition and offset, the outcome code of a match or an
    unreadable event from its type, and the number of the failed clause from an error's reason. Other codes and the rule version stay null.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        readable, poison = read_audit_json(batch)
        number = F.regexp_extract("reason", r"^CLAUSE_ERROR (\d+) ", 1)
        made = {
            "event_id": event_id(F.col("source_topic"), F.col("partition"), F.col("offset")),
            "code": F.when(F.col("audit_type") == MATCHED, 0).when(F.col("rule_id") == RULE_PARSE, -1),
            "failed_clause_no": F.when((F.col("audit_type") == ERRORED) & (number != ""), number.cast("int")),
        }
        missing = {f.name: F.lit(None).cast(f.dataType) for f in AUDITS if f.name not in readable.columns and f.name not in made}
        audits_batch = store.begin(run_seq, batch_id, stream_id(batch))
        audits_batch.audits(readable.withColumns(made | missing).select(*AUDITS.fieldNames()))
        audits_batch.table("audit_poison", poison)
        audits_batch.publish()

    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
