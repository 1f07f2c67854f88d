"""Every active rule on every event, as one narrow stage.

Each event is parsed once and each path the rules mention is read once. A rule snapshot of bounded size
is a constant inside the plan and decided with bitmaps (bitmaps.py): no join, no shuffle. A larger one is
cut into chunks of rule packs, each small enough to be broadcast, with the clauses folded over the typed
cells inside the event's row; each chunk is a pass over the events, which never move.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.functions import cells as C
from arbitrail.functions import keys
from arbitrail.operators import bitmaps as B
from arbitrail.operators import clauses as K
from arbitrail.operators.parse import original_type, parse_events
from arbitrail.operators.rules import InlinePass, PackPass, Snapshot
from arbitrail.schema import (
    ERRORED,
    MATCHED,
    NO_RULES_REASON,
    PARSE_REASON,
    ROUTED_MESSAGE,
    RULE_NONE,
    RULE_PARSE,
    UNMATCHED,
    UNMATCHED_PREFIX,
)

_CARRIED = ["topic", "partition", "offset", "ts"]
_TIMES = ["parse_time_nano", "eval_time_nano", "total_time_nano"]
_FIELDS = "map<string,string>"


def evaluate(
    raw: DataFrame,
    snapshot: Snapshot,
    reasons: bool = False,
    routed: bool = False,
    source: bool = False,
    matched_only: bool = False,
    ids: bool = False,
) -> DataFrame:
    """One row per (event, rule) with ``code``, ``audit_type`` and ``failed_clause_no``.

    ``ids`` adds ``event_id`` and ``audit_id``. ``reasons``, ``routed`` and ``source`` add those texts; they are off by default because they
    multiply the event's size by the number of rules. An unparseable event gives one ``_parse`` row;
    without active rules each event gives one ``_none`` row. ``matched_only`` drops everything but
    matches before the fan-out.
    """
    parsed = parse_events(raw)
    if ids:  # before the fan-out: the event's own hash is computed once, not once per rule
        provenance = [F.col(c) for c in ("topic", "partition", "offset")]
        parsed = parsed.withColumns({"event_key": keys.event_key(*provenance), "event_id": keys.event_id(*provenance)})
    branches = [
        _run_pass(parsed, p, first=i == 0, none=snapshot.count == 0, reasons=reasons, routed=routed, source=source, matched_only=matched_only)
        for i, p in enumerate(snapshot.passes)
    ]
    result = branches[0]
    for more in branches[1:]:
        result = result.unionByName(more)
    if ids:  # the two pseudo rules share the event's id
        own = keys.rule_audit_id(F.col("event_key"), F.col("rule_id"))
        result = result.withColumn("audit_id", F.when(F.col("code") < 0, F.col("event_id")).otherwise(own)).drop("event_key")
    return result


def _run_pass(parsed, step, first, none, reasons, routed, source, matched_only) -> DataFrame:
    carried = _CARRIED + [c for c in (*_TIMES, "processed_at", "event_key", "event_id") if c in parsed.columns] + (["value"] if source else [])
    if routed:  # the event's share of its routed texts, once per event
        parsed = parsed.withColumns({"routed_head": routed_head(F.col("root")), "routed_tail": routed_tail(F.col("root"))})
    pairs = (_inline_pairs if isinstance(step, InlinePass) else _pack_pairs)(parsed, step, first, none, matched_only)
    texts = {}
    if reasons:
        texts["reason"] = reason_text(F.col("code"), F.col("expression"), F.col("fields"), F.col("paths"))
    if routed:
        texts["routed_event"] = F.when(F.col("code") == 0, F.concat("routed_head", "rule_json", "routed_tail"))
    kinds = {"audit_type": K.audit_type_of(F.col("code")), "failed_clause_no": K.failed_clause_of(F.col("code"))}
    columns = [c.alias(n) for n, c in {**kinds, **texts}.items()]
    return pairs.select(*carried, "rule_id", "code", *columns)


def _with_fields(events: DataFrame) -> DataFrame:
    """The event's top-level entries in text order, for reasons; pruned when nobody reads them."""
    return events.withColumn("fields", F.map_entries(F.from_json("value", _FIELDS)))


def _marked(parsed: DataFrame, step: InlinePass) -> DataFrame:
    """Events with the bitmaps of all clauses."""
    typed = B.read_paths(_with_fields(parsed), step.slots)
    if step.predicates:
        # Conditions name the fields of the declared schema, so those stand apart from the event's columns.
        apart = typed.select(F.struct(*typed.columns).alias("__row"), F.from_json("value", step.event_schema).alias("__typed"))
        holds = [F.coalesce(F.expr(p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(step.predicates)]
        typed = apart.select("__row", "__typed.*").select("__row.*", *holds)
    return B.with_bitmaps(typed, step.layout)


def _constant(rows: list[dict], words: int) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), B.rule_type(words))


def _inline_pairs(parsed: DataFrame, step: InlinePass, first: bool, none: bool, matched_only: bool) -> DataFrame:
    plan = step.layout
    marked = _marked(parsed, step)
    lead = [B.pseudo_rule(RULE_PARSE, K.CODE_PARSE, plan.words)] if first else []
    rules = [B.pseudo_rule(RULE_NONE, K.CODE_NO_RULES, plan.words)] if none else plan.rules
    exploded = marked.withColumn("r", F.explode(F.when(F.col("parsed"), _constant(rules, plan.words)).otherwise(_constant(lead, plan.words))))
    code = F.expr(B.pair_code("r", plan.words))
    if matched_only:
        exploded, code = exploded.where(F.expr(B.pair_matches("r", plan.words))), F.lit(0)
    return exploded.select(*parsed.columns, "fields", "r.rule_id", "r.rule_json", "r.expression", "r.paths", code.alias("code"))


def _pack_pairs(parsed: DataFrame, step: PackPass, first: bool, none: bool, matched_only: bool) -> DataFrame:
    """The packs come to each event as one array; the event stays one row up to the final explode and never moves."""
    everywhere = F.pmod(F.hash("topic"), F.lit(1)).alias("at")  # 0 for each event, but not a constant, so the join is a hash join
    packs = F.broadcast(step.packs.select(F.lit(0).alias("at"), "packs"))
    joined = _with_fields(parsed).select("*", everywhere).join(packs, "at", "left")
    no_predicates = F.array().cast("array<int>")

    def pair(rule_id, expression, paths, code):
        escaped = F.regexp_extract(F.to_json(F.struct(rule_id.alias("i"))), '^.{6}(.*)"}$', 1)
        return F.struct(rule_id.alias("rule_id"), escaped.alias("rule_json"), expression.alias("expression"), paths.alias("paths"), code.alias("code"))

    def of_pack(p):
        cells = F.transform(p["slots"], lambda s: C.any_cell(F.col("root"), s["path"], s["item"]))
        judged = lambda r, cs: pair(r["rule_id"], r["expression"], F.transform(r["clauses"], lambda c: c["path"]), K.rule_code(r["clauses"], cs, no_predicates))
        return C.bind(cells, lambda cs: F.transform(p["rules"], lambda r: judged(r, cs)))

    no_text = F.lit(None).cast("string")
    failed = F.array(pair(F.lit(RULE_PARSE), no_text, F.array().cast("array<string>"), F.lit(K.CODE_PARSE)))
    if not first:
        failed = F.slice(failed, 1, 0)
    evaluated = F.flatten(F.transform("packs", of_pack))
    if matched_only:
        evaluated = F.filter(evaluated, lambda o: o["code"] == 0)
        failed = F.slice(failed, 1, 0)
    outcomes = F.when(F.col("parsed"), evaluated).otherwise(failed)
    # explode_outer: a plain explode has Catalyst test the array in a filter below, evaluating every pack twice.
    exploded = joined.select(*parsed.columns, "fields", F.explode_outer(outcomes).alias("r"))
    return exploded.where("r is not null").select(*parsed.columns, "fields", "r.*")


def reason_text(code: Column, expression: Column, fields: Column, paths: Column) -> Column:
    """The reason of an outcome code; a match has none."""
    return (
        F.when(code == K.CODE_PARSE, F.lit(PARSE_REASON))
        .when(code == K.CODE_NO_RULES, F.lit(NO_RULES_REASON))
        .when(code == 0, F.lit(None).cast("string"))
        .when(code % K.CODE_BASE == K.FALSE, unmatched_reason(expression, fields))
        .otherwise(K.error_text(code, paths))
    )


def unmatched_reason(expression: Column, fields: Column) -> Column:
    """The condition plus ``key=value`` for each top-level field whose name occurs in it."""
    named = F.filter(fields, lambda e: F.contains(expression, e["key"]))
    shown = F.array_join(F.transform(named, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")
    values = F.when(F.size(named) > 0, F.concat(F.lit(" (actual values: "), shown, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit(UNMATCHED_PREFIX), expression, values)


def routed_head(root: Column) -> Column:
    """Start of a match's confirmation event, up to the rule id that ends its ``type``."""
    named = F.struct(F.lit(ROUTED_MESSAGE).alias("message"), F.concat(original_type(root), F.lit("_")).alias("type"))
    return F.regexp_replace(F.to_json(named), '"}$', "")


def routed_tail(root: Column) -> Column:
    return F.concat(F.lit('","original_event":'), F.to_json(root), F.lit("}"))


def event_results(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One row per event: provenance, ``parsed`` and ``results``, an array of (rule_id, code, paths) of the real rules.

    Rules that fit into the plan are judged inside the event's row, without a fan-out, a shuffle or a second scan. Larger rule
    tables are joined as ever and their results gathered per event.
    """
    parsed = parse_events(raw)
    if len(snapshot.passes) == 1 and isinstance(snapshot.passes[0], InlinePass):
        step = snapshot.passes[0]
        marked = _marked(parsed, step).withColumn("__rules", _constant(step.layout.rules, step.layout.words))
        code = B.pair_code("r", step.layout.words)
        results = f"case when parsed then transform(__rules, r -> named_struct('rule_id', r.rule_id, 'code', {code}, 'paths', r.paths)) end"
        return marked.select(*parsed.columns, F.expr(results).alias("results"))
    branches = []
    for i, p in enumerate(snapshot.passes):
        make = _inline_pairs if isinstance(p, InlinePass) else _pack_pairs
        branches.append(make(parsed, p, i == 0, snapshot.count == 0, False).select(*EVENT, "parsed", "rule_id", "code", "paths"))
    pairs = branches[0]
    for more in branches[1:]:
        pairs = pairs.unionByName(more)
    real = F.when(F.col("code") >= 0, F.struct("rule_id", F.col("code").cast("int").alias("code"), "paths"))
    return pairs.groupBy(*EVENT).agg(F.first("parsed").alias("parsed"), F.collect_list(real).alias("results"))


EVENT = ["topic", "partition", "offset"]


def _has(kind: str) -> Column:
    found = F.exists("results", lambda r: K.audit_type_of(r["code"]) == kind)
    return F.coalesce(found, F.lit(False))


def event_verdicts(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One verdict per event: any match wins, else any error (a parse failure is one), else unmatched, also without rules."""
    verdict = F.when(_has(MATCHED), F.lit(MATCHED)).when(~F.col("parsed") | _has(ERRORED), F.lit(ERRORED)).otherwise(F.lit(UNMATCHED))
    return event_results(raw, snapshot).select(*EVENT, verdict.alias("verdict"))


def event_summary(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Per event: rules that matched, rules evaluated, and the reason of each error, by rule id; a parse failure is the error
    of the pseudo rule. Of rules that share an id each counts, but the errors name it once."""
    results = F.coalesce("results", F.array().cast("array<struct<rule_id:string,code:int,paths:array<string>>>"))
    ids = lambda rows: F.array_sort(F.transform(rows, lambda r: r["rule_id"]))
    failed = F.filter(results, lambda r: K.audit_type_of(r["code"]) == ERRORED)
    errors = F.transform(failed, lambda r: F.struct(r["rule_id"].alias("rule_id"), K.error_text(r["code"], r["paths"]).alias("reason")))
    errors = F.when(F.col("parsed"), F.array_sort(errors)).otherwise(F.array(F.struct(F.lit(RULE_PARSE).alias("rule_id"), F.lit(PARSE_REASON).alias("reason"))))
    names = F.array_distinct(F.transform(errors, lambda e: e["rule_id"]))
    reasons = F.transform(names, lambda n: F.element_at(F.filter(errors, lambda e: e["rule_id"] == n), 1)["reason"])
    return event_results(raw, snapshot).select(
        *EVENT,
        ids(F.filter(results, lambda r: r["code"] == 0)).alias("matched_rule_ids"),
        ids(results).alias("evaluated_rule_ids"),
        F.map_from_arrays(names, reasons).alias("errors"),
    )


def _rows_where(frame: DataFrame, keep: Column) -> DataFrame:
    """Rows of ``frame`` where ``keep`` holds. The test is made by a generator over each row: a filter would be pushed down to
    the scan with every use of the parsed event replaced by the whole parsing, once per rule and clause."""
    kept = F.filter(F.array(F.struct(*frame.columns)), lambda _: keep)
    return frame.select(F.inline(kept))


def events_with_match(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    return _rows_where(event_results(raw, snapshot), _has(MATCHED)).drop("results", "root", "parsed")


def events_without_match(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    return _rows_where(event_results(raw, snapshot), ~_has(MATCHED)).drop("results", "root", "parsed")
