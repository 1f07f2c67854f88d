"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitrail.functions import keys
from arbitrail.functions.text import hour_key
from arbitrail.operators import analytics as N
from arbitrail.operators import audit as A
from arbitrail.operators import evaluate as E
from arbitrail.operators import report, rollup
from arbitrail.operators import rules as R
from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.matching import match_pairs
from arbitrail.operators.parse import original_type, parse_events, quarantine
from arbitrail.operators.rules import rule_frame
from arbitrail.plans import fixtures as X
from arbitrail.rulesets.seed import seed_rules
from arbitrail.schema import RAW_EVENTS
from arbitrail.session import names_in, shared_dir
from arbitrail.sources.events import stream_events
from arbitrail.sources.store import AuditStore, latest_audits
from arbitrail.streaming import pipeline

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


WINDOW_AS_OF = "2024-01-10 10:30:00"
PRESET_AS_OF = "2024-01-20 12:34:56"
RANGE = ("2024-01-05 03:20:00", "2024-01-25 17:40:00")
EVENT = ["topic", "partition", "offset"]


def click_outcomes(spark, sf, **options) -> DataFrame:
    return E.evaluate(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark)), **options)


def click_audits(spark, sf, **options) -> DataFrame:
    texts = {"reasons": False, "source": False, "routed": False, **options}
    return A.audits(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark)), **texts)


def click_rollups(spark, sf) -> DataFrame:
    return rollup.rule_rollups(click_audits(spark, sf))


# --- parsing ------------------------------------------------------------------------------------------


@query
def q_parse_split(spark: SparkSession, sf: str) -> DataFrame:
    events = parse_events(X.click_events(spark, sf))
    return events.select(*EVENT, "parsed", F.when(F.col("parsed"), original_type(F.col("root"))).alias("original_type"))


@query
def q_parse_quarantine(spark, sf):
    return quarantine(X.click_events(spark, sf)).select(*EVENT, "value", "reason")


# --- rules on events ----------------------------------------------------------------------------------


@query
def q_rule_fanout(spark, sf):
    return click_outcomes(spark, sf).select(*EVENT, "rule_id", "audit_type")


@query
def q_clause_states(spark, sf):
    outcomes = click_outcomes(spark, sf)
    return outcomes.groupBy("rule_id", "audit_type", "failed_clause_no").agg(F.count("*").alias("audits"))


@query
def q_clause_errors(spark, sf):
    errors = click_outcomes(spark, sf, reasons=True).where("audit_type = 'ERRORED'")
    return errors.groupBy("rule_id", "reason").agg(F.count("*").alias("audits"))


@query
def q_clause_nulls(spark, sf):
    """Absent amounts against each comparison: null lies below every literal."""
    ops = ["gt", "ge", "lt", "le", "eq", "ne", "not_null"]
    rules = X.rule_frame(spark, [rule(f"n_{op}", op, [clause(op, "amount", None if op == "not_null" else 100)]) for op in ops])
    outcomes = E.evaluate(X.click_events(spark, sf), R.take_snapshot(rules))
    return outcomes.groupBy("rule_id").pivot("audit_type", ["MATCHED", "UNMATCHED", "ERRORED"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def q_array_selection(spark, sf):
    return E.evaluate(X.order_events(spark, sf), R.take_snapshot(X.order_rules(spark))).select(*EVENT, "rule_id", "audit_type")


@query
def q_rule_short_circuit(spark, sf):
    """The same two clauses in both orders: a false first clause hides the second one's error."""
    meta, kind = clause("ge", "metadata.priority", 3), clause("eq", "type", "click")
    rules = X.rule_frame(spark, [rule("a_first", "", [kind, meta]), rule("b_first", "", [meta, kind])])
    outcomes = E.evaluate(X.click_events(spark, sf), R.take_snapshot(rules))
    return outcomes.groupBy("rule_id", "audit_type", "failed_clause_no").agg(F.count("*").alias("audits"))


@query
def q_sql_rules(spark, sf):
    snapshot = R.take_snapshot(X.click_conditions(spark), X.CLICK_SCHEMA)
    return E.evaluate(X.click_events(spark, sf), snapshot).groupBy("rule_id", "audit_type").agg(F.count("*").alias("audits"))


@query
def q_rule_guard(spark, sf):
    """Verdict on each rule, and how many audits it gives: bad rules are errors of their own and harm no other."""
    rules = X.guarded_rules(spark)
    verdicts = R.load_errors(rules, X.CLICK_SCHEMA)
    outcomes = E.evaluate(X.click_events(spark, sf), R.take_snapshot(rules, X.CLICK_SCHEMA))
    counts = outcomes.groupBy("rule_id").agg(F.count("*").alias("audits"), F.count_if(F.col("audit_type") == "ERRORED").alias("errors"))
    zero = F.lit(0)
    return verdicts.join(counts, "rule_id", "left").select("rule_id", "verdict", F.coalesce("audits", zero).alias("audits"), F.coalesce("errors", zero).alias("errors"))


@query
def q_plans_agree(spark, sf):
    """Good and bad clause rules, some without an id, by the plan for few rules and by that for many."""
    rules = X.guarded_rules(spark).where("predicate is null").unionByName(X.click_rules(spark))
    rules = rules.withColumn("rule_id", F.when(F.col("rule_id") == "c3", F.lit("")).when(F.col("rule_id") != "c5", F.col("rule_id")))
    events = X.click_events(spark, sf)
    plans = {"few": R.take_snapshot(rules), "many": R.take_snapshot(rules, inline_rules=3, rules_per_pack=4, inline_passes=1)}
    found = [E.evaluate(events, s).groupBy("rule_id", "audit_type", "failed_clause_no").agg(F.count("*").alias("audits")).withColumn("plan", F.lit(p)) for p, s in plans.items()]
    return found[0].unionByName(found[1])


@query
def q_conditions_in_portions(spark, sf):
    """Conditions beyond the size of one pass, two of them with a blank and a null id."""
    rules = X.click_conditions(spark)
    rules = rules.withColumn("rule_id", F.when(F.col("rule_id") == "s1", F.lit("")).when(F.col("rule_id") != "s2", F.col("rule_id")))
    outcomes = E.evaluate(X.click_events(spark, sf), R.take_snapshot(rules, X.CLICK_SCHEMA, inline_rules=2))
    return outcomes.groupBy("rule_id", "audit_type").agg(F.count("*").alias("audits"))


@query
def q_unmatched_reason(spark, sf):
    return click_outcomes(spark, sf, reasons=True).where("audit_type <> 'ERRORED'").select(*EVENT, "rule_id", "reason")


@query
def q_event_verdict(spark, sf):
    events = X.click_events(spark, sf)
    rules = X.click_rules(spark).where("rule_id in ('c1', 'c2', 'c3', 'c7')")
    return E.event_verdicts(events, R.take_snapshot(rules))


@query
def q_event_no_results(spark, sf):
    """Without active rules an event has no results; its verdict is unmatched, or errored if it can't be read."""
    return E.event_verdicts(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark).where("false")))


@query
def q_event_summary(spark, sf):
    summary = E.event_summary(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark)))
    return summary.select(
        *EVENT,
        F.array_join("matched_rule_ids", ",").alias("matched_rules"),
        F.array_join("evaluated_rule_ids", ",").alias("evaluated_rules"),
        F.array_join(F.map_keys("errors"), ",").alias("errored_rules"),
    )


@query
def q_no_rules(spark, sf):
    snapshot = R.take_snapshot(X.click_rules(spark).where("false"))
    return A.audits(X.click_events(spark, sf), snapshot, source=False).select("audit_id", "rule_id", "audit_type", "reason")


@query
def q_rule_seed(spark, sf):
    """The default rules, taken because the table is empty, on every order."""
    empty = X.click_rules(spark).where("false")
    snapshot = R.take_snapshot(R.seed_if_empty(empty, seed_rules(spark)))
    outcomes = E.evaluate(X.sales_events(spark, sf), snapshot)
    return outcomes.groupBy("rule_id").agg(
        F.count_if(F.col("audit_type") == "MATCHED").alias("matched"),
        F.count_if(F.col("audit_type") == "UNMATCHED").alias("unmatched"),
        F.count_if(F.col("audit_type") == "ERRORED").alias("errored"),
    )


@query
def q_rule_packs(spark, sf):
    """The default rules again, by the join that serves rule tables too large for the plan."""
    snapshot = R.take_snapshot(seed_rules(spark), inline_rules=10, rules_per_pack=40, inline_passes=1)
    outcomes = E.evaluate(X.sales_events(spark, sf), snapshot)
    return outcomes.groupBy("rule_id", "audit_type", "failed_clause_no").agg(F.count("*").alias("audits"))


@query
def q_rule_portions(spark, sf):
    """The default rules in portions, each of which fits into a plan, as a table of thousands of rules is evaluated."""
    outcomes = E.evaluate(X.sales_events(spark, sf), R.take_snapshot(seed_rules(spark), inline_rules=30))
    return outcomes.groupBy("rule_id", "audit_type", "failed_clause_no").agg(F.count("*").alias("audits"))


def twin_rules(spark) -> DataFrame:
    """The default rules, and under the id of each third one the rule after it once more."""
    rows = seed_rules(spark).orderBy("rule_id").collect()
    twins = [{**after.asDict(), "rule_id": row["rule_id"]} for i, (row, after) in enumerate(zip(rows, rows[1:], strict=False)) if i % 3 == 0]
    return seed_rules(spark).unionByName(spark.createDataFrame(twins, seed_rules(spark).schema))


@query
def q_match_shared_ids(spark, sf):
    """Matches of rules of which some share an id, by the hash join and by full evaluation: each is a rule of its own."""
    snapshot, events = R.take_snapshot(twin_rules(spark)), X.sales_events(spark, sf)
    found = {"join": match_pairs(events, snapshot), "evaluation": E.evaluate(events, snapshot, matched_only=True)}
    counts = [df.groupBy("rule_id").agg(F.count("*").alias("matches")).withColumn("plan", F.lit(name)) for name, df in found.items()]
    return counts[0].unionByName(counts[1])


@query
def q_match_only_join(spark, sf):
    return match_pairs(X.sales_events(spark, sf), R.take_snapshot(seed_rules(spark))).select(*EVENT, "rule_id")


def range_rules(spark) -> DataFrame:
    """Rules that only bound numbers, from both sides or from one, some under one id, one that can't match and one that always does."""
    rows = []
    for k in range(80):
        cents = k % 20
        clauses = (
            [clause("ge", "amount", 5 * k), clause("lt", "amount", 5 * k + 40)],
            [clause("lt", "amount", 5 * k)],
            [clause("eq", "metadata.priority", k % 5 + 1), clause("gt", "amount", 3 * k)],
            [clause("ge", "metadata.tax_rate", cents / 100), clause("le", "metadata.tax_rate", (cents + 3) / 100)],
        )[k % 4]
        rows.append(rule(f"r{k - (k % 8 == 7)}", "Range", clauses))
    rows += [rule("r80", "Contradiction", [clause("gt", "amount", 50), clause("lt", "amount", 20)]), rule("r81", "Everything", [])]
    return rule_frame(spark, rows)


@query
def q_match_only_ranges(spark, sf):
    """Matches of rules without an equality on a text, by the interval join and by full evaluation."""
    snapshot, events = R.take_snapshot(range_rules(spark)), X.click_events(spark, sf)
    found = {"join": match_pairs(events, snapshot), "evaluation": E.evaluate(events, snapshot, matched_only=True)}
    counts = [df.groupBy("rule_id").agg(F.count("*").alias("matches"), F.sum("offset").alias("offsets")).withColumn("plan", F.lit(name)) for name, df in found.items()]
    return counts[0].unionByName(counts[1])


# --- audits and routing --------------------------------------------------------------------------------


@query
def q_audit_ids(spark, sf):
    return click_audits(spark, sf).select("audit_id", "event_id", "rule_id")


@query
def q_routed_events(spark, sf):
    routed = A.routed_events(click_audits(spark, sf, routed=True))
    part = lambda path: F.get_json_object("routed_event", path)
    return routed.select(
        "event_id",
        "rule_id",
        part("$.message").alias("message"),
        part("$.type").alias("type"),
        part("$.original_event.user_id").alias("user_id"),
        part("$.original_event.metadata.source").alias("source"),
    )


@query
def q_audit_json(spark, sf):
    text = A.audit_json(click_audits(spark, sf, reasons=True))
    part = lambda path: F.get_json_object("audit_json", path)
    return text.select(
        part("$.auditId").alias("audit_id"),
        part("$.ruleId").alias("rule_id"),
        part("$.auditType").alias("audit_type"),
        part("$.timestamp").alias("instant"),
        part("$.schemaVersion").cast("int").alias("schema_version"),
        part("$.totalTimeNano").cast("bigint").alias("total_time_nano"),
        F.contains("audit_json", F.lit('"routedEvent":null')).alias("has_null_routed"),
    )


@query
def q_events_any_match(spark, sf):
    events = X.click_events(spark, sf)
    rules = X.click_rules(spark).where("rule_id in ('c1', 'c2')")
    return E.events_with_match(events, R.take_snapshot(rules)).select(*EVENT)


@query
def q_events_no_match(spark, sf):
    events = X.click_events(spark, sf)
    rules = X.click_rules(spark).where("rule_id in ('c1', 'c2')")
    return E.events_without_match(events, R.take_snapshot(rules)).select(*EVENT)


@query
def q_audit_with_rule(spark, sf):
    named = A.with_rules(click_audits(spark, sf), X.click_rules(spark))
    return named.groupBy("rule_id", "description", "audit_type").agg(F.count("*").alias("audits"))


@query
def q_type_tally(spark, sf):
    return A.tally(click_audits(spark, sf))


@query
def q_audit_sample(spark, sf):
    return A.sample(click_audits(spark, sf, source=True))


@query
def q_audit_full(spark, sf):
    """Narrow audits of a store whose rules have changed meanwhile, with their texts put back as they were judged."""
    full = A.full_audits(*_narrow_store(spark, sf))
    routed = F.get_json_object("routed_event", "$.type")
    return full.where("audit_type <> 'ERRORED'").select("audit_id", "audit_type", "reason", "source_event", routed.alias("routed_type"))


def _narrow_store(spark, sf):
    store, events = AuditStore(spark, shared_dir(spark, "store")), X.click_columns(X.table(spark, sf, "events"))
    runs = [(1, events, X.click_rules(spark)), (2, events.where(F.col("ts") >= at("2024-01-15 00:00:00")), changed_rules(spark))]
    for run_seq, rows, rules in runs:
        snapshot = R.take_snapshot(rules)
        store.write_rule_texts(snapshot.texts, snapshot.version)
        store.write_batch(A.audits(rows, snapshot, reasons=False, source=False, routed=False), run_seq, 0)
    return store.latest(), events, store.rule_texts()


# --- rule table ----------------------------------------------------------------------------------------


@query
def q_rule_current(spark, sf):
    return R.current_rules(X.rule_changes(spark, sf)).select("rule_id", "expression", "active", "seq")


@query
def q_rule_slug(spark, sf):
    return R.with_rule_id(X.rule_changes(spark, sf)).select("seq", "rule_id")


@query
def q_rule_active(spark, sf):
    return R.current_rules(X.rule_changes(spark, sf)).where("active").select("rule_id", "description", "expression")


@query
def q_rule_lookup(spark, sf):
    rules = R.current_rules(X.rule_changes(spark, sf))
    first = rules.agg(F.min("rule_id")).first()[0]
    return R.lookup(rules, first).select("rule_id", "description", "active")


@query
def q_rule_search(spark, sf):
    rules = R.current_rules(X.rule_changes(spark, sf))
    return R.search(rules, "URGENT watch", "active").select("rule_id", "description")


@query
def q_rule_counts(spark, sf):
    return R.counts(R.current_rules(X.rule_changes(spark, sf)))


@query
def q_rule_refresh(spark, sf):
    """What two batches see before and after many rule changes."""
    changes = X.rule_changes(spark, sf)
    seen = [R.rules_as_of(changes, at(m)).select(F.lit(i).alias("batch"), "rule_id", "expression", "active") for i, m in enumerate(("1995-06-30", "1997-06-30"))]
    return seen[0].unionByName(seen[1])


# --- audit store ---------------------------------------------------------------------------------------


def changed_rules(spark) -> DataFrame:
    return X.rule_frame(spark, [rule("c1", "Amount over 50", [clause("gt", "amount", 50)]), rule("c6", "Everything", [])])


def _store_with_rerun(spark, sf, replays: int = 1) -> AuditStore:
    store = AuditStore(spark, shared_dir(spark, "store"))
    for _ in range(replays):
        store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    since = X.click_events(spark, sf).where(F.col("ts") >= at("2024-01-15 00:00:00"))
    store.write_batch(A.audits(since, R.take_snapshot(changed_rules(spark)), reasons=False, source=False, routed=False), run_seq=2, batch_id=0)
    return store


@query
def q_audit_latest(spark, sf):
    return _store_with_rerun(spark, sf).latest().select("audit_id", "rule_id", "audit_type")


@query
def q_audit_replay(spark, sf):
    return _store_with_rerun(spark, sf, replays=2).latest().groupBy("rule_id", "audit_type").agg(F.count("*").alias("audits"))


@query
def q_audit_versions(spark, sf):
    """Latest verdict over versions kept in one table, without the store's folders."""
    first = click_audits(spark, sf).withColumns({"run_seq": F.lit(1), "batch_id": F.lit(0)})
    rerun = A.audits(X.click_events(spark, sf), R.take_snapshot(changed_rules(spark)), reasons=False, source=False, routed=False)
    both = first.unionByName(rerun.withColumns({"run_seq": F.lit(2), "batch_id": F.lit(0)}))
    return latest_audits(both).groupBy("rule_id", "audit_type").agg(F.count("*").alias("audits"))


@query
def q_audit_poison(spark, sf):
    messages = A.audit_json(click_audits(spark, sf))
    offset = F.get_json_object("audit_json", "$.offset").cast("bigint")
    cut = F.when(offset % 53 == 0, F.substring("audit_json", 1, 30)).otherwise(F.col("audit_json"))
    readable, poison = A.read_audit_json(messages.select(cut.alias("audit_json")))
    good = readable.groupBy("audit_type").agg(F.count("*").alias("messages"))
    return good.unionByName(poison.agg(F.count("*").alias("messages")).select(F.lit("unreadable").alias("audit_type"), "messages"))


# --- rollups -------------------------------------------------------------------------------------------


@query
def q_rule_rollup(spark, sf):
    return click_rollups(spark, sf)


@query
def q_hour_rollup(spark, sf):
    return rollup.hour_rollups(click_audits(spark, sf))


@query
def q_messages_of_range(spark, sf):
    """Distinct messages of a range from sketches of its hours: of audits some of which came again an hour later, and of a store after a rerun.
    Given are the exact numbers, and whether the estimates are within the stated error."""
    low, high = at(RANGE[0]), at(RANGE[1])
    audits = click_audits(spark, sf)
    again = audits.where("offset % 5 = 0").withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 hour"))
    twice = audits.unionByName(again)
    found = {
        "again": (N.in_range(twice.withColumn("hour", hour_key(F.col("timestamp"))), low, high), rollup.distinct_messages(N.in_range(rollup.hour_sketches(twice), low, high))),
        "store": (N.in_range(audits.withColumn("hour", hour_key(F.col("timestamp"))), low, high), _store_with_rerun(spark, sf).messages(low, high)),
    }
    rows = []
    for name, (all_rows, estimate) in found.items():
        exact = all_rows.select("source_topic", "partition", "offset").distinct().agg(F.count("*").alias("exact"), F.lit(None).cast("long").alias("messages"))
        both = exact.unionByName(estimate.select(F.lit(None).cast("long").alias("exact"), "messages")).agg(F.max("exact").alias("exact"), F.max("messages").alias("messages"))
        within = F.abs(F.col("messages") - F.col("exact")) <= rollup.SKETCH_ERROR * F.col("exact")
        rows.append(both.select(F.lit(name).alias("name"), "exact", within.alias("within")))
    return rows[0].unionByName(rows[1])


@query
def q_rollup_window(spark, sf):
    return rollup.recompute(click_audits(spark, sf), at(WINDOW_AS_OF))[0]


@query
def q_rollup_backfill(spark, sf):
    return rollup.backfill(click_audits(spark, sf), at(WINDOW_AS_OF))[1]


@query
def q_rollup_merge(spark, sf):
    """Rollups taken at an earlier time, then the trailing window recomputed and merged."""
    audits = click_audits(spark, sf)
    earlier = rollup.rule_rollups(audits.where(F.col("timestamp") < at(WINDOW_AS_OF)))
    return rollup.merged(earlier, rollup.recompute(audits, at(WINDOW_AS_OF))[0])


@query
def q_rollup_store(spark, sf):
    """Stored audits rolled up twice: a backfill, then the periodic window over it."""
    store = _store_with_rerun(spark, sf)
    store.refresh_rollups(at("2024-02-01 00:00:00"), hours=24 * 40)
    store.refresh_rollups(at(WINDOW_AS_OF))
    return store.hour_rollups()


@query
def q_rollup_store_rules(spark, sf):
    """Rollups by rule of a store in which a second run has judged a part anew, taken before and after that run."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    since = X.click_events(spark, sf).where(F.col("ts") >= at("2024-01-15 00:00:00"))
    store.write_batch(A.audits(since, R.take_snapshot(changed_rules(spark)), reasons=False, source=False, routed=False), run_seq=2, batch_id=0)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    return store.rule_rollups().select("hour", "rule_id", "matched", "unmatched", "errored", "count")


@query
def q_rollup_late(spark, sf):
    """Audits whose event time lies weeks before the trailing window reach the rollups with the next refresh."""
    store, audits = AuditStore(spark, shared_dir(spark, "store")), click_audits(spark, sf)
    late = F.col("timestamp") < at("2024-01-10 08:20:00")
    for batch_id, rows in enumerate((audits.where(~late), audits.where(late))):
        store.write_batch(rows, run_seq=1, batch_id=batch_id)
        store.refresh_rollups(at("2024-01-31 00:00:00"))
    return store.rule_rollups()


@query
def q_audit_compacted(spark, sf):
    """The last verdicts after old versions of some days are dropped."""
    store = _store_with_rerun(spark, sf)
    store.compact(3, at("2024-01-10 00:00:00"), at("2024-01-20 12:00:00"))
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_store_two_streams(spark, sf):
    """Two streams with the same run and batch numbers in one store."""
    store, audits = AuditStore(spark, shared_dir(spark, "store")), click_audits(spark, sf)
    for name, rows in (("a", audits.where("partition < 8")), ("b", audits.where("partition >= 8"))):
        store.write_batch(rows, run_seq=1, batch_id=0, stream=name)
    return store.latest().select("audit_id", "rule_id", "audit_type")


def _since_the_15th(spark, sf) -> DataFrame:
    return X.click_events(spark, sf).where(F.col("ts") >= at("2024-01-15 00:00:00"))


def _judged_anew(spark, sf) -> DataFrame:
    return A.audits(_since_the_15th(spark, sf), R.take_snapshot(changed_rules(spark)), reasons=False, source=False, routed=False)


@query
def q_audit_repeats(spark, sf):
    """A batch in which a quarter of the records came twice holds each audit once."""
    store, audits = AuditStore(spark, shared_dir(spark, "store")), click_audits(spark, sf)
    store.write_batch(audits.unionByName(audits.where("partition < 5")), run_seq=1, batch_id=0)
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_audit_overlap(spark, sf):
    """Batches that share some records with each other and within themselves, then a rerun of a part."""
    store, audits = AuditStore(spark, shared_dir(spark, "store")), click_audits(spark, sf)
    shares = ["partition < 8", "partition between 6 and 12", "partition > 12"]
    for batch_id, share in enumerate(shares):
        rows = audits.where(share)
        store.write_batch(rows.unionByName(rows.where("partition in (0, 7, 15)")), run_seq=1, batch_id=batch_id)
    store.write_batch(_judged_anew(spark, sf), run_seq=2, batch_id=0)
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_audit_compacted_twice(spark, sf):
    """Two ranges of days compacted one after the other, under one number, and the first of them once more."""
    store = _store_with_rerun(spark, sf)
    for low, high in (("2024-01-05", "2024-01-12"), ("2024-01-12", "2024-01-20"), ("2024-01-05", "2024-01-12")):
        store.compact(7, at(f"{low} 00:00:00"), at(f"{high} 00:00:00"))
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_rerun_after_compaction(spark, sf):
    """A run that ends after the days it judges anew were compacted, with a number below the compaction's."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    store.compact(7, at("2024-01-10 00:00:00"), at("2024-01-25 00:00:00"))
    store.write_batch(_judged_anew(spark, sf), run_seq=2, batch_id=0)
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_audit_clustered(spark, sf):
    """Days clustered by id, judged anew by a run whose audits are clustered as well, and by a later small one whose aren't."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    store.compact(1, at("2024-01-10 00:00:00"), at("2024-01-25 00:00:00"), buckets=4)
    anew = _judged_anew(spark, sf)
    store.write_batch(anew, run_seq=2, batch_id=0, buckets=4)
    store.write_batch(anew.where("partition = 3"), run_seq=3, batch_id=0)
    return store.latest().select("audit_id", "rule_id", "audit_type")


def _replayed_store(spark, sf, compacted: bool) -> AuditStore:
    """Two batches, rolled up; then the second is replayed with a changed rule, its days compacted meanwhile or not."""
    store, audits = AuditStore(spark, shared_dir(spark, "store")), click_audits(spark, sf)
    early = F.col("timestamp") < at("2024-01-15 00:00:00")
    store.write_batch(audits.where(early), run_seq=1, batch_id=0)
    store.write_batch(audits.where(~early), run_seq=1, batch_id=1)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    if compacted:
        store.compact(1, at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))
        store.refresh_rollups(at("2024-02-01 00:00:00"))
    rules = X.click_rules(spark).where("rule_id <> 'c1'").unionByName(changed_rules(spark).where("rule_id = 'c1'"))
    store.write_batch(A.audits(_since_the_15th(spark, sf), R.take_snapshot(rules), reasons=False, source=False, routed=False), run_seq=1, batch_id=1)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    return store


@query
def q_rollup_replayed(spark, sf):
    """Rollups after a batch was replayed with a changed rule, all its hours long before the trailing window."""
    return _replayed_store(spark, sf, compacted=False).rule_rollups().select("hour", "rule_id", "matched", "unmatched", "errored", "count")


@query
def q_rollup_replayed_compacted(spark, sf):
    """The same after some days of the replayed batch had been compacted with another's."""
    return _replayed_store(spark, sf, compacted=True).rule_rollups().select("hour", "rule_id", "matched", "unmatched", "errored", "count")


@query
def q_store_commit(spark, sf):
    """A write that stops before it is published and a compaction that stops half way leave the state before."""
    store = _store_with_rerun(spark, sf)
    half = store.begin(run_seq=9, batch_id=0)
    half.audits(click_audits(spark, sf))

    def stop(change):
        raise InterruptedError

    stopped = AuditStore(spark, store.root)
    stopped.log.publish = stop
    try:
        stopped.compact(3, at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))
    except InterruptedError:
        pass
    return store.latest().select("audit_id", "rule_id", "audit_type")


@query
def q_store_top(spark, sf):
    """The newest ten matches of a range of weeks, by the store's counts of each hour, after a part was judged anew."""
    rows = _store_with_rerun(spark, sf).top("MATCHED", at(RANGE[1]), at(RANGE[0]), at(RANGE[1]))
    return rows.select("audit_id", "rule_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def q_load_errors_stored(spark, sf):
    """The rules a batch couldn't evaluate as they are, as the store keeps them, with their stored errors."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    pipeline.process_batch(X.click_columns(X.table(spark, sf, "events")), 0, store, lambda: X.guarded_rules(spark), event_schema=X.CLICK_SCHEMA)
    errors = store.latest().where("audit_type = 'ERRORED'").groupBy("rule_id").agg(F.count("*").alias("errors"))
    return store.load_errors().join(errors, "rule_id", "left").select("rule_id", "verdict", F.coalesce("errors", F.lit(0)).alias("errors"))


@query
def q_poison_batch(spark, sf):
    """A batch with a record that can't be read: all others are judged, and the record's place is kept with its error."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    rows = X.click_columns(X.table(spark, sf, "events"))
    broken = (F.col("partition") == 0) & (F.col("offset") == 25)
    rows = rows.withColumn("value", F.when(broken, F.raise_error(F.lit("unreadable block"))).otherwise(F.col("value")))
    rules = X.click_rules(spark).where("rule_id in ('c1', 'c6')")
    pipeline.process_or_set_aside(rows, 0, store, lambda: rules, attempts=1)
    counts = store.latest().groupBy("rule_id", "audit_type").agg(F.count("*").alias("audits"))
    aside = store.part("quarantine").where(F.contains("reason", F.lit("unreadable block"))).groupBy("partition", "offset").agg(F.count("*").alias("audits"))
    return counts.unionByName(aside.select(F.concat_ws("-", "partition", "offset").alias("rule_id"), F.lit("SET ASIDE").alias("audit_type"), "audits"))


# --- analytics -----------------------------------------------------------------------------------------


@query
def q_rule_stats(spark, sf):
    return N.sort_rules(N.rule_stats(N.in_range(click_rollups(spark, sf), at(RANGE[0]), at(RANGE[1]))))


@query
def q_time_series(spark, sf):
    return N.time_series(N.in_range(click_rollups(spark, sf), at(RANGE[0]), at(RANGE[1])))


@query
def q_totals(spark, sf):
    rules, hours = _both_rollups(spark, sf)
    totals = N.dashboard(*[N.in_range(r, at(RANGE[0]), at(RANGE[1])) for r in (rules, hours)])[0]
    return totals.select("total_messages", "total_evaluations")


def _both_rollups(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rollups by rule and by hour as a dashboard finds them: stored, after one evaluation of the events."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    return store.rule_rollups(), store.hour_rollups()


@query
def q_latency(spark, sf):
    return N.latency(N.in_range(click_rollups(spark, sf), at(RANGE[0]), at(RANGE[1])))


@query
def q_dashboard(spark, sf):
    return N.dashboard(*[N.last_hours(r, at(PRESET_AS_OF)) for r in _both_rollups(spark, sf)])[0]


@query
def q_range_presets(spark, sf):
    return N.evaluations_of_presets(click_rollups(spark, sf), at(PRESET_AS_OF))


@query
def q_series_all(spark, sf):
    return N.series_of_all(click_rollups(spark, sf))


@query
def q_series_one(spark, sf):
    return N.series_of_rule(click_rollups(spark, sf), "c3")


@query
def q_match_rate(spark, sf):
    return N.match_rates(N.rule_stats(click_rollups(spark, sf))).select("rule_id", "total", "evaluations", "match_rate")


@query
def q_cards(spark, sf):
    return N.cards(N.rule_stats(click_rollups(spark, sf)))


@query
def q_peak(spark, sf):
    return N.peak(N.series_of_all(click_rollups(spark, sf)))


# --- reports -------------------------------------------------------------------------------------------


@query
def q_top10(spark, sf):
    rows = report.top(click_audits(spark, sf), "MATCHED", at(RANGE[0]), at(RANGE[1]))
    return rows.select("audit_id", "rule_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def q_export_csv(spark, sf):
    return report.export_csv(click_audits(spark, sf, reasons=True, source=True, routed=True), "ERRORED", at(RANGE[0]), at(RANGE[1]))


@query
def q_rule_sorted(spark, sf):
    return N.sort_rules(N.match_rates(N.rule_stats(click_rollups(spark, sf))), "total", descending=False).select("rule_id", "total")


@query
def q_rule_page(spark, sf):
    """The last page of the default rules' statistics, asked for with too high a page number."""
    outcomes = A.audits(X.sales_events(spark, sf), R.take_snapshot(seed_rules(spark)), reasons=False, source=False, routed=False)
    stats = N.rule_stats(rollup.rule_rollups(outcomes))
    return N.page_of_rules(stats, 99, "unmatched").select("rule_id", "matched", "unmatched", "page", "pages")


# --- streaming -----------------------------------------------------------------------------------------


def _streamed_store(spark, sf) -> AuditStore:
    folder = shared_dir(spark, "stream")
    X.click_columns(X.table(spark, sf, "events")).select(*RAW_EVENTS.fieldNames()).repartition(6).write.parquet(f"{folder}/in")
    store = AuditStore(spark, f"{folder}/out")
    events = stream_events(spark, f"{folder}/in", files_per_batch=3)
    pipeline.start(events, store, lambda: X.click_rules(spark), f"{folder}/checkpoint").awaitTermination()
    return store


@query
def q_stream_audits(spark, sf):
    """Streamed audits as they are stored, texts and latencies included."""
    rows = _streamed_store(spark, sf).latest()
    reason = F.when(F.col("rule_id").isin("c1", "c2", "c3", "c5", "c6", "c9") & (F.col("audit_type") != "ERRORED"), F.col("reason"))
    return rows.select("audit_id", "rule_id", "audit_type", reason.alias("reason"), "source_event", "total_time_nano")


@query
def q_stream_routed(spark, sf):
    """Routed events and quarantined records of the same stream."""
    store = _streamed_store(spark, sf)
    routed = store.part("routed_events").select("event_id", "rule_id", F.get_json_object("routed_event", "$.type").alias("text"))
    return routed.unionByName(store.part("quarantine").select(F.lit(None).cast("string").alias("event_id"), F.lit("quarantine").alias("rule_id"), F.col("value").alias("text")))


@query
def q_stream_topics(spark, sf):
    """Keyed records of both topics, as a broker would get them."""
    folder = shared_dir(spark, "stream")
    X.click_columns(X.table(spark, sf, "events")).select(*RAW_EVENTS.fieldNames()).repartition(4).write.parquet(f"{folder}/in")
    stream = pipeline.start(
        stream_events(spark, f"{folder}/in", files_per_batch=2), AuditStore(spark, f"{folder}/out"), lambda: X.click_rules(spark), f"{folder}/checkpoint",
        topics=pipeline.file_topics(f"{folder}/topics"),
    )
    stream.awaitTermination()
    read = lambda topic, path: spark.read.parquet(f"{folder}/topics/{topic}").select(F.lit(topic).alias("topic"), "key", F.get_json_object("value", path).alias("name"))
    return read("routed_events", "$.type").unionByName(read("audits", "$.auditId"))


@query
def q_store_reports(spark, sf):
    """The newest matches of the day before a moment, and the totals of that day, both read from a store."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(click_audits(spark, sf), run_seq=1, batch_id=0)
    store.refresh_rollups(at("2024-02-01 00:00:00"))
    newest = store.top("MATCHED", at(PRESET_AS_OF)).select(F.col("audit_id").alias("name"), F.lit(1).cast("bigint").alias("value"))
    totals = store.dashboard(at(PRESET_AS_OF))[0]
    return newest.unionByName(totals.select(F.lit("messages").alias("name"), F.col("total_messages").alias("value"))).unionByName(
        totals.select(F.lit("evaluations").alias("name"), F.col("total_evaluations").alias("value"))
    )


@query
def q_store_new_checkpoint(spark, sf):
    """A store that goes on with a new checkpoint after the old one was lost: nothing earlier is overwritten."""
    folder = shared_dir(spark, "stream")
    rows = X.click_columns(X.table(spark, sf, "events"))
    store = AuditStore(spark, f"{folder}/out")
    for name, part in (("first", rows.where("partition < 12")), ("second", rows.where("partition >= 12"))):
        part.select(*RAW_EVENTS.fieldNames()).write.parquet(f"{folder}/{name}")
        pipeline.start(stream_events(spark, f"{folder}/{name}"), store, lambda: X.click_rules(spark), f"{folder}/checkpoint-{name}").awaitTermination()
    return store.latest().select("audit_id", "rule_id", "audit_type")


def _audit_stream(spark, sf, copies: int) -> tuple[str, DataFrame]:
    """Audits as a stream of small batches, newest first, each audit in ``copies`` of them.

    The audits are evaluated once, by all tasks, and stored; each batch's file is then cut from that copy. Cutting from the
    evaluation itself would have ``coalesce(1)`` run all of it in one task, once for each file. The files leave out the ids that can
    be made (``keys.without_ids``), and so does the stream.
    """
    folder = shared_dir(spark, "stream")
    keys.without_ids(click_audits(spark, sf)).write.option("compression", "zstd").parquet(f"{folder}/audits")
    audits = spark.read.parquet(f"{folder}/audits")
    cuts = ["2024-01-24", "2024-01-16", "2024-01-08", "2023-01-01"]
    for i, (low, high) in enumerate(zip(cuts, ["2025-01-01", *cuts])):
        part = audits.where((F.col("timestamp") >= at(low)) & (F.col("timestamp") < at(high)))
        for _ in range(copies):
            part.coalesce(1).write.option("compression", "zstd").mode("append").parquet(f"{folder}/in")
    return folder, stream_events(spark, f"{folder}/in", audits.schema, files_per_batch=1)


@query
def q_stream_rollup(spark, sf):
    folder, audits = _audit_stream(spark, sf, copies=1)
    pipeline.start_rollups(audits, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return pipeline.streamed_rollups(spark, f"{folder}/out")


@query
def q_stream_dedup(spark, sf):
    folder, audits = _audit_stream(spark, sf, copies=2)
    pipeline.start_dedup(audits, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return pipeline.deduplicated(spark, f"{folder}/out").select("audit_id", "rule_id")


@query
def q_audit_messages(spark, sf):
    """Audit messages streamed into a store, some cut off: what it holds, each with its event's id, and how many it set aside."""
    folder = shared_dir(spark, "stream")
    messages = A.audit_json(click_audits(spark, sf))
    offset = F.get_json_object("audit_json", "$.offset").cast("bigint")
    cut = F.when(offset % 53 == 0, F.substring("audit_json", 1, 30)).otherwise(F.col("audit_json"))
    # written where they are made, so that an event's messages lie side by side and compress; a third of the files is a batch
    messages.select(cut.alias("audit_json")).write.option("compression", "zstd").parquet(f"{folder}/in")
    files = len([name for name in names_in(spark, f"{folder}/in") if name.endswith(".parquet")])
    store = AuditStore(spark, f"{folder}/out")
    pipeline.start_audit_messages(stream_events(spark, f"{folder}/in", "audit_json string", -(-files // 3)), store, f"{folder}/checkpoint").awaitTermination()
    good = store.latest().groupBy("audit_type").agg(F.count("event_id").alias("messages"))
    return good.unionByName(store.part("audit_poison").agg(F.count("*").alias("messages")).select(F.lit("unreadable").alias("audit_type"), "messages"))
