"""Table schemas and the fixed texts that appear in results."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and texts that results must show exactly.
MATCHED, UNMATCHED, ERRORED = "MATCHED", "UNMATCHED", "ERRORED"
RULE_PARSE, RULE_NONE, RULE_EVENT = "_parse", "_none", "_event"
UNKNOWN_TOPIC, UNKNOWN_TYPE = "unknown", "unknown"
PARSE_REASON = "JSON parse failure: Cannot parse event JSON into a Map root"
NO_RULES_REASON = "No active rules for evaluation"
UNMATCHED_PREFIX = "Condition not met: "
ROUTED_MESSAGE = "Rule matched, sending this event which confirms that the event matched"
SCHEMA_VERSION = 1
CSV_HEADER = (
    "AuditId,RuleId,Type,Timestamp,Reason,SourceTopic,Partition,Offset,"
    "ParseTimeNano,EvalTimeNano,TotalTimeNano,SourceEvent,RoutedEvent"
)
RECOMPUTE_HOURS, BACKFILL_HOURS, DEFAULT_RANGE_HOURS, PAGE_SIZE = 3, 26, 24, 10

RAW_EVENTS = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.StringType()),
        T.StructField("parse_time_nano", T.LongType()),
        T.StructField("eval_time_nano", T.LongType()),
        T.StructField("total_time_nano", T.LongType()),
    ]
)

CLAUSE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("lit_kind", T.StringType()),
        T.StructField("lit_int", T.LongType()),
        T.StructField("lit_num", T.DoubleType()),
        T.StructField("lit_str", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("expression", T.StringType()),
        T.StructField("clauses", T.ArrayType(CLAUSE)),
        T.StructField("predicate", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

AUDITS = T.StructType(
    [
        T.StructField("audit_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("audit_type", T.StringType()),
        T.StructField("failed_clause_no", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source_event", T.StringType()),
        T.StructField("routed_event", T.StringType()),
        T.StructField("source_topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("parse_time_nano", T.LongType()),
        T.StructField("eval_time_nano", T.LongType()),
        T.StructField("total_time_nano", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("rule_version", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

RULE_ROLLUPS = T.StructType(
    [
        T.StructField("hour", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("matched", T.LongType()),
        T.StructField("unmatched", T.LongType()),
        T.StructField("errored", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("parse_sum", T.LongType()),
        T.StructField("eval_sum", T.LongType()),
        T.StructField("total_sum", T.LongType()),
    ]
)

HOUR_ROLLUPS = T.StructType([T.StructField("hour", T.StringType()), T.StructField("messages", T.LongType())])
