"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.schema import RULE_EVENT


def event_key(topic: Column, partition: Column, offset: Column) -> Column:
    """The part of an audit id's input that all audits of an event share."""
    return F.concat(topic, F.lit("|"), partition.cast("string"), F.lit("|"), offset.cast("string"), F.lit("|"))


def rule_audit_id(key: Column, rule_id: Column) -> Column:
    """Lower-case hex SHA-256 of topic, partition, offset and rule id joined by pipes."""
    return F.sha2(F.concat(key, rule_id), 256)


def audit_id(topic: Column, partition: Column, offset: Column, rule_id: Column) -> Column:
    return rule_audit_id(event_key(topic, partition, offset), rule_id)


def event_id(topic: Column, partition: Column, offset: Column) -> Column:
    return audit_id(topic, partition, offset, F.lit(RULE_EVENT))


# --- stored audits without the ids that follow from their other columns ---------------------------------

#: How the ids of a stored audit are found: kept, or made of its record's place and its rule. A row without it keeps both.
IDS_MADE = "ids_made"
_PLACE = ("source_topic", "partition", "offset")
_OWN, _EVENT, _EVENT_MADE = 1, 2, 3  # the audit's id is its own or its event's; added: the event's id is made


def _made(name: str) -> Column:
    place = [F.col(c) for c in _PLACE]
    return event_id(*place) if name == "event" else audit_id(*place, F.col("rule_id"))


def _kind() -> Column:
    return F.coalesce(F.col(IDS_MADE), F.lit(0)) % _EVENT_MADE


def without_ids(rows: DataFrame) -> DataFrame:
    """Audits with an id left null where it is what ``with_ids`` makes, and how to make it; any other id stays as it is.

    A hash doesn't compress: of a narrow audit the two ids are nearly all bytes, on disk and in a shuffle.
    """
    if IDS_MADE in rows.columns:
        return rows
    made = rows.withColumns({"__event": _made("event"), "__own": _made("own")})
    of_audit = F.when(F.col("audit_id").eqNullSafe(F.col("__own")), _OWN).when(F.col("audit_id").eqNullSafe(F.col("__event")), _EVENT).otherwise(0)
    of_event = F.when(F.col("event_id").eqNullSafe(F.col("__event")), _EVENT_MADE).otherwise(0)
    marked = made.withColumn(IDS_MADE, (of_audit + of_event).cast("tinyint"))
    kept = {"audit_id": F.when(F.col(IDS_MADE) % _EVENT_MADE == 0, F.col("audit_id")), "event_id": F.when(F.col(IDS_MADE) < _EVENT_MADE, F.col("event_id"))}
    return marked.withColumns(kept).drop("__event", "__own")


def full_audit_id() -> Column:
    """The audit's id in a row without ids."""
    return F.when(_kind() == _OWN, _made("own")).when(_kind() == _EVENT, _made("event")).otherwise(F.col("audit_id"))


def with_ids(rows: DataFrame) -> DataFrame:
    """The audits as they were before ``without_ids``."""
    if IDS_MADE not in rows.columns:
        return rows
    event = F.when(F.coalesce(F.col(IDS_MADE), F.lit(0)) >= _EVENT_MADE, _made("event")).otherwise(F.col("event_id"))
    return rows.withColumns({"audit_id": full_audit_id(), "event_id": event}).drop(IDS_MADE)


def identity() -> list[Column]:
    """Columns that are equal in rows without ids if and only if their audit ids are: nothing is hashed for made ones."""
    made = _kind() > 0
    place = [F.when(made, F.col(c)).alias(f"of_{c}") for c in _PLACE]
    return [*place, _kind().alias("of_kind"), F.when(_kind() == _OWN, F.col("rule_id")).alias("of_rule"), F.col("audit_id").alias("of_id")]


def has_id() -> Column:
    """Whether the audit id of a row without ids is there."""
    place = F.col(_PLACE[0]).isNotNull() & F.col(_PLACE[1]).isNotNull() & F.col(_PLACE[2]).isNotNull()
    return F.when(_kind() == 0, F.col("audit_id").isNotNull()).when(_kind() == _OWN, place & F.col("rule_id").isNotNull()).otherwise(place)


def record_hash() -> Column:
    """The same for all rows without ids that ``identity`` finds equal; of made ids the same for all audits of a record, which lie together then."""
    return F.xxhash64(*identity()[:3], F.when(_kind() == 0, F.col("audit_id")))
