"""Audit rows, routed events and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail import schema as S
from arbitrail.functions import keys, text
from arbitrail.operators import evaluate as E
from arbitrail.operators.parse import as_raw_events
from arbitrail.operators.rules import Snapshot


def audits(raw: DataFrame, snapshot: Snapshot, reasons: bool = True, source: bool = True, routed: bool = True) -> DataFrame:
    """One audit per (event, active rule) with the columns of ``schema.AUDITS``.

    ``timestamp`` is the event's own time, so a repeated run gives the same rows; an event without one has that of 1970. Latencies are taken
    from the input when it has them. With ``source`` or ``reasons`` off those columns stay null and
    ``full_audits`` puts them back: at 100 rules per event the texts would be stored 100 times.
    """
    outcomes = E.evaluate(raw, snapshot, reasons=reasons, routed=routed, source=source, ids=True)
    no_text = F.lit(None).cast("string")

    def nanos(name: str) -> Column:
        given = F.col(name) if name in outcomes.columns else F.lit(None).cast("bigint")
        return F.when(F.col("code") == -1, F.lit(0)).otherwise(given).cast("bigint").alias(name)

    processed = F.col("processed_at") if "processed_at" in outcomes.columns else F.lit(None).cast("timestamp")
    return outcomes.select(
        "audit_id",
        "event_id",
        "rule_id",
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        "audit_type",
        "failed_clause_no",
        (F.col("reason") if reasons else no_text).alias("reason"),
        (F.col("value") if source else no_text).alias("source_event"),
        (F.col("routed_event") if routed else no_text).alias("routed_event"),
        F.col("topic").alias("source_topic"),
        "partition",
        "offset",
        F.coalesce("ts", F.lit(0).cast("timestamp")).alias("timestamp"),
        nanos("parse_time_nano"),
        nanos("eval_time_nano"),
        nanos("total_time_nano"),
        F.col("code").cast("int").alias("code"),
        F.lit(snapshot.version).cast("long").alias("rule_version"),
        processed.alias("processed_at"),
    )


def full_audits(stored: DataFrame, raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored audits with the texts they lack: source event, reason, and routed event of matches.

    rules: (rule_version, rule_id, expression, paths), the texts of every version that judged (``Snapshot.texts``,
    ``AuditStore.rule_texts``). Each event's text is joined once, by event id; the reason follows from the stored outcome code
    and the rule as it was then, so nothing is evaluated again.
    """
    events = as_raw_events(raw)
    events = events.select(keys.event_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("event_id"), F.col("value").alias("found_value"))
    found = stored.join(events.dropDuplicates(["event_id"]), "event_id", "left").join(rules.dropDuplicates(["rule_version", "rule_id"]), ["rule_version", "rule_id"], "left")
    source = F.coalesce("source_event", "found_value")
    code, root = F.col("code"), F.try_parse_json(source)
    reason = E.reason_text(code, F.col("expression"), F.map_entries(F.from_json(source, "map<string,string>")), F.col("paths"))
    escaped = F.regexp_extract(F.to_json(F.struct(F.col("rule_id").alias("i"))), '^.{6}(.*)"}$', 1)
    routed = F.when(code == 0, F.concat(E.routed_head(root), escaped, E.routed_tail(root)))
    return found.withColumns({"reason": F.coalesce("reason", reason), "source_event": source, "routed_event": F.coalesce("routed_event", routed)}).select(*stored.columns)


def routed_events(audit_rows: DataFrame) -> DataFrame:
    """The confirmation events of all matches, keyed by event id, with the source record's time."""
    return audit_rows.where(F.col("audit_type") == S.MATCHED).select(
        "event_id", "audit_id", "rule_id", F.col("timestamp").alias("ts"), "routed_event"
    )


def audit_json(audit_rows: DataFrame) -> DataFrame:
    """Key and JSON text of each audit: explicit nulls, ISO instants."""
    named = F.struct(
        F.col("audit_id").alias("auditId"),
        F.col("rule_id").alias("ruleId"),
        F.col("schema_version").alias("schemaVersion"),
        F.col("audit_type").alias("auditType"),
        "reason",
        F.col("source_event").alias("sourceEvent"),
        F.col("routed_event").alias("routedEvent"),
        F.col("source_topic").alias("sourceTopic"),
        "partition",
        "offset",
        text.instant_text(F.col("timestamp")).alias("timestamp"),
        F.col("parse_time_nano").alias("parseTimeNano"),
        F.col("eval_time_nano").alias("evalTimeNano"),
        F.col("total_time_nano").alias("totalTimeNano"),
    )
    return audit_rows.select("event_id", "audit_id", F.to_json(named, {"ignoreNullFields": "false"}).alias("audit_json"))


AUDIT_JSON = (
    "auditId string, ruleId string, schemaVersion int, auditType string, reason string, sourceEvent string, "
    "routedEvent string, sourceTopic string, partition int, offset bigint, timestamp timestamp, "
    "parseTimeNano bigint, evalTimeNano bigint, totalTimeNano bigint"
)


def parsed_audit_json(messages: DataFrame, column: str = "audit_json") -> DataFrame:
    """The messages with their parsed text ``a`` and whether it is ``readable``.

    A message is unreadable when it is not a JSON object of this shape or names no audit.
    """
    schema = AUDIT_JSON + ", _corrupt string"
    parsed = messages.withColumn("a", F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.withColumn("readable", F.col("a").isNotNull() & F.col("a._corrupt").isNull() & F.col("a.auditId").isNotNull())


def read_audit_json(messages: DataFrame, column: str = "audit_json") -> tuple[DataFrame, DataFrame]:
    """Audit rows of the readable messages, and the unreadable messages for quarantine; each message is parsed once for either.

    Rows are chosen by a generator: a filter would be pushed below the parsing and repeat it for each of its conditions.
    """
    parsed = parsed_audit_json(messages, column)
    rows = parsed.select(F.inline(F.filter(F.array(F.struct("a")), lambda _: F.col("readable")))).select(*_columns_of_json())
    return rows, parsed.select(F.inline(F.filter(F.array(F.struct(*messages.columns)), lambda _: ~F.col("readable"))))


def _columns_of_json() -> list[Column]:
    a = "a."
    return [
        F.col(a + "auditId").alias("audit_id"),
        F.col(a + "ruleId").alias("rule_id"),
        F.col(a + "schemaVersion").alias("schema_version"),
        F.col(a + "auditType").alias("audit_type"),
        F.col(a + "reason").alias("reason"),
        F.col(a + "sourceEvent").alias("source_event"),
        F.col(a + "routedEvent").alias("routed_event"),
        F.col(a + "sourceTopic").alias("source_topic"),
        F.col(a + "partition").alias("partition"),
        F.col(a + "offset").alias("offset"),
        F.col(a + "timestamp").alias("timestamp"),
        F.col(a + "parseTimeNano").alias("parse_time_nano"),
        F.col(a + "evalTimeNano").alias("eval_time_nano"),
        F.col(a + "totalTimeNano").alias("total_time_nano"),
    ]


def tally(audit_rows: DataFrame) -> DataFrame:
    return audit_rows.groupBy("audit_type").agg(F.count("*").alias("audits"))


def sample(audit_rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` audits by time and id, with a short id."""
    return (
        audit_rows.orderBy("timestamp", "audit_id")
        .limit(n)
        .select("audit_type", F.substring("audit_id", 1, 8).alias("short_id"), "rule_id", "source_event")
    )


def with_rules(audit_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Audits with the description of their rule; pseudo rules have none."""
    return audit_rows.join(rules.select("rule_id", "description"), "rule_id", "left")

