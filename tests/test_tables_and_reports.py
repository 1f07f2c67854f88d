"""Rule table, audits, store, rollups, analytics, reports and streaming."""

import csv
import hashlib
import io
import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arbitrail import schema as S
from arbitrail.operators import analytics as N
from arbitrail.operators import audit as A
from arbitrail.operators import report, rollup
from arbitrail.operators import rules as R
from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.evaluate import evaluate
from arbitrail.plans import fixtures as X
from arbitrail.rulesets.seed import seed_rules
from arbitrail.session import shared_dir
from arbitrail.sources.events import kafka_options, kafka_records, stream_events
from arbitrail.sources.store import AuditStore, RuleLog
from arbitrail.streaming import pipeline
from test_rules_on_events import ODD, OVER, events


def at(text):
    return F.lit(text).cast("timestamp")


def change(rule_id, description, seq, op="put", active=True, threshold=1):
    r = rule(rule_id, description, [clause("gt", "amount", threshold)], active=active)
    return {**r, "seq": seq, "op": op}


def changes(spark, rows):
    base = R.rule_frame(spark, rows).withColumn("n", F.monotonically_increasing_id())
    extra = spark.createDataFrame([(r["rule_id"], r["description"], r["seq"], r["op"]) for r in rows], "rule_id string, description string, seq bigint, op string")
    joined = base.drop("n", "updated_at").join(extra, ["rule_id", "description"])
    return joined.withColumn("updated_at", F.timestamp_seconds(F.lit(1700000000) + F.col("seq")))


def test_rule_log_keeps_the_latest_change(spark):
    log = RuleLog(spark, shared_dir(spark, "log"))
    log.append(changes(spark, [change("c1", "first", 1), change("c2", "on", 2), change("c3", "x", 3)]))
    log.append(changes(spark, [change("c1", "second", 4, threshold=9), change("c2", "off", 5, active=False), change("c3", "gone", 6, op="delete")]))
    log.append(changes(spark, [change(" ", "High value order EU audit (Rule 46)", 7), change("", "?!", 8)]))
    got = {r["rule_id"]: (r["description"], r["active"]) for r in R.current_rules(log.changes()).collect()}
    assert got == {
        "c1": ("second", True),
        "c2": ("off", False),
        "high-value-order-eu-audit-rule-46": ("High value order EU audit (Rule 46)", True),
        "rule-8": ("?!", True),
    }
    rules = R.current_rules(log.changes())
    assert R.counts(rules).first().asDict() == {"total": 4, "active": 3, "inactive": 1}
    assert [r["rule_id"] for r in R.search(rules, "SECOND").collect()] == ["c1"]
    assert [r["rule_id"] for r in R.search(rules, "amount", "inactive").collect()] == ["c2"]
    assert R.lookup(rules, "c1").first()["description"] == "second"
    with pytest.raises(LookupError, match="Rule not found: zz"):
        R.lookup(rules, "zz")


def test_put_and_delete_one_rule(spark):
    log = RuleLog(spark, shared_dir(spark, "log"))
    log.put(OVER, 1, datetime(2024, 1, 1))
    log.put(ODD, 2, datetime(2024, 1, 2), rule_id="r1")
    log.delete("never-there", 3, datetime(2024, 1, 3))
    assert [(r["rule_id"], r["description"]) for r in R.current_rules(log.changes()).collect()] == [("r1", "odd")]
    log.delete("r1", 4, datetime(2024, 1, 4))
    assert R.current_rules(log.changes()).isEmpty()
    before = R.rules_as_of(log.changes(), at("2024-01-01 12:00:00")).collect()
    assert [r["description"] for r in before] == ["over"]


def test_seeding_only_fills_an_empty_table(spark):
    seeds = seed_rules(spark)
    some = R.rule_frame(spark, [OVER])
    assert R.seed_if_empty(some, seeds).count() == 1
    assert R.seed_if_empty(some.where("false"), seeds).select("rule_id").distinct().count() == 100


@pytest.mark.parametrize("sizes", [{}, {"inline_rules": 1}, {"inline_rules": 1, "inline_passes": 1}], ids=["inline", "portions", "packs"])
def test_snapshot_does_not_follow_the_table(spark, sizes):
    folder = shared_dir(spark, "rules")
    R.rule_frame(spark, [OVER, ODD]).write.parquet(folder)
    snapshot = R.take_snapshot(spark.read.parquet(folder), **sizes)
    R.rule_frame(spark, [rule("r9", "", [])]).write.mode("append").parquet(folder)
    assert {r["rule_id"] for r in A.audits(events(spark, ['{"amount":1}']), snapshot).collect()} == {"r1", "r2"}


def test_audit_rows(spark):
    rows = A.audits(events(spark, ['{"amount":5000}', "nope"]), R.take_snapshot(R.rule_frame(spark, [OVER, ODD]))).collect()
    assert [f for f in S.AUDITS.fieldNames()] == list(rows[0].asDict())
    by = {(r["offset"], r["rule_id"]): r for r in rows}
    assert len({r["audit_id"] for r in rows}) == len(rows) == 3
    assert by[0, "r1"]["audit_id"] == hashlib.sha256(b"t|0|0|r1").hexdigest()
    assert by[1, "_parse"]["audit_id"] == by[1, "_parse"]["event_id"] == hashlib.sha256(b"t|1|1|_event").hexdigest()
    assert (by[1, "_parse"]["source_event"], by[1, "_parse"]["total_time_nano"]) == ("nope", 0)
    text = {r["audit_id"]: json.loads(r["audit_json"]) for r in A.audit_json(A.audits(events(spark, ["nope"]), R.take_snapshot(R.rule_frame(spark, [OVER])))).collect()}
    (only,) = text.values()
    assert only["routedEvent"] is None and "routedEvent" in only and only["timestamp"] == "2023-11-14T22:13:20Z"


def test_partitioning_does_not_change_results(spark, sf):
    snapshot = R.take_snapshot(X.click_rules(spark))
    rows = X.click_columns(X.table(spark, sf, "events"))
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("audit_id", "audit_type", "reason")), F.count_distinct("audit_id")).first()
    one, other = digest(A.audits(rows.coalesce(1), snapshot)), digest(A.audits(rows.repartition(7), snapshot))
    assert one == other and one[0] == one[2] == 971 * 8 + 29


def test_narrow_and_full_audits_agree(spark):
    source, snapshot = events(spark, ['{"amount":1}', '{"amount":5000}', "x"]), R.take_snapshot(R.rule_frame(spark, [OVER, ODD]))
    full = A.audits(source, snapshot)
    narrow = A.audits(source, snapshot, reasons=False, source=False, routed=False)
    assert Counter(map(str, A.full_audits(narrow, source, snapshot.texts).collect())) == Counter(map(str, full.collect()))


def test_store_replay_rerun_and_compaction(spark, sf):
    source = X.click_columns(X.table(spark, sf, "events"))
    store = AuditStore(spark, shared_dir(spark, "store"))
    first = A.audits(source, R.take_snapshot(X.click_rules(spark)), reasons=False, source=False)
    store.write_batch(first, 1, 0)
    before = store.latest().count()
    store.write_batch(first, 1, 0)
    assert store.all_versions().count() == store.latest().count() == before
    changed = R.rule_frame(spark, [rule("c1", "", [clause("gt", "amount", 0)])])
    store.write_batch(A.audits(source, R.take_snapshot(changed), reasons=False, source=False), 2, 0)
    kinds = lambda: {tuple(r) for r in store.latest().where("rule_id = 'c1'").groupBy("audit_type").count().collect()}
    won = kinds()
    assert store.latest().count() == before and dict(won)["MATCHED"] > 125
    store.compact(3, at("2024-01-10 00:00:00"), at("2024-01-12 12:00:00"))
    assert kinds() == won and store.latest().count() == before
    of_days = store.all_versions().where("day between '2024-01-10' and '2024-01-11'")
    assert of_days.select("part").distinct().count() == 1 and of_days.count() == of_days.select("audit_id").distinct().count()
    assert store.touched().groupBy("hour").agg(F.sum("audits")).count() == store.latest().select(F.date_trunc("hour", "timestamp")).distinct().count()
    window = store.latest(at("2024-01-10 06:00:00"), at("2024-01-11 07:00:00")).agg(F.min("timestamp"), F.max("timestamp")).first()
    assert str(window[0]) >= "2024-01-10 06:00:00" and str(window[1]) <= "2024-01-11 07:00:00"


def test_rollup_window_never_shrinks_a_bucket(spark, sf):
    audits = A.audits(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark)), reasons=False, source=False, routed=False)
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(audits, 1, 0)
    everything = sorted(rollup.rule_rollups(audits).collect())
    store.refresh_rollups(at("2024-02-01 00:00:00"), hours=24 * 40)
    assert sorted(store.rule_rollups().collect()) == everything
    for minute in ("2024-01-10 10:30:00", "2024-01-10 10:59:00", "2024-01-10 11:00:00"):
        store.refresh_rollups(at(minute))
    store.refresh_rollups(at("2024-01-10 11:01:00"), enabled=False)
    assert sorted(store.rule_rollups().collect()) == everything
    assert store.hour_rollups().agg(F.sum("messages")).first()[0] == 1000
    hours = [r[0] for r in rollup.recompute(audits, at("2024-01-10 10:30:00"))[1].orderBy("hour").limit(1).collect()]
    assert hours[0] >= "2024-01-10T07:00:00Z"


def test_analytics_on_small_rollups(spark):
    rows = [("2024-01-01T00:00:00Z", "a", 1, 2, 0, 3, 10, 20, 30), ("2024-01-01T01:00:00Z", "a", 4, 0, 1, 5, 1, 1, 2), ("2024-01-01T01:00:00Z", "_parse", 0, 0, 2, 2, 0, 0, 0)]
    rr = spark.createDataFrame(rows, S.RULE_ROLLUPS)
    hr = spark.createDataFrame([("2024-01-01T00:00:00Z", 3), ("2024-01-01T01:00:00Z", 2)], S.HOUR_ROLLUPS)
    totals, stats, series = N.dashboard(rr, hr)
    assert totals.first().asDict() == {"total_messages": 5, "total_evaluations": 10, "avg_parse_time": 1, "avg_eval_time": 2, "avg_total_time": 3}
    assert [(r["rule_id"], r["matched"], r["is_pseudo"]) for r in stats.collect()] == [("a", 5, False), ("_parse", 0, True)]
    assert [r["timestamp"] for r in series.collect()] == sorted(r[0] for r in rows)
    empty = N.dashboard(rr.where("false"), hr.where("false"))[0].first()
    assert list(empty) == [0, 0, 0, 0, 0]
    rates = {r["rule_id"]: r["match_rate"] for r in N.match_rates(N.rule_stats(rr)).collect()}
    assert rates == {"a": 62.5, "_parse": 0.0}
    assert N.cards(N.rule_stats(rr)).first().asDict() == {"total_matched": 5, "total_errored": 3}
    assert N.peak(N.series_of_all(rr)).first()[0] == 4 and N.peak(rr.where("false")).first()[0] == 1
    # both ends are rounded down to the hour and included
    assert N.total_evaluations(N.in_range(rr, at("2024-01-01 00:59:00"), at("2024-01-01 01:00:01"))).first()[0] == 10
    assert N.total_evaluations(N.last_hours(rr, at("2024-01-01 02:10:00"), 1)).first()[0] == 7


def test_pages_are_clamped(spark):
    rows = [("2024-01-01T00:00:00Z", f"r{i:02}", i, 30 - i, 0, 30, 0, 0, 0) for i in range(23)]
    stats = N.rule_stats(spark.createDataFrame(rows, S.RULE_ROLLUPS))
    page = lambda n, **k: [r["rule_id"] for r in N.page_of_rules(stats, n, **k).collect()]
    assert page(1) == [f"r{i:02}" for i in range(22, 12, -1)]
    assert page(9) == page(3) == ["r02", "r01", "r00"]
    assert page(0, descending=False)[0] == "r00" and page(1, key="unmatched")[0] == "r00" and page(1, key="total")[0] == "r00"
    assert page(5, key="matched") == page(3) and N.page_of_rules(stats.where("false"), 4).count() == 0


def test_csv_export_round_trip(spark):
    audits = A.audits(events(spark, ['{"amount":1,"t":"a \\"quoted\\" word"}', '{"amount":2}']), R.take_snapshot(R.rule_frame(spark, [OVER])))
    folder = shared_dir(spark, "csv")
    report.write_export(audits, "UNMATCHED", at("2023-01-01"), at("2024-01-01"), folder)
    lines = [r[0] for r in report.export_csv(audits, "UNMATCHED", at("2023-01-01"), at("2024-01-01")).collect()]
    assert lines[0] == S.CSV_HEADER and len(lines) == 3 == spark.read.text(folder).count()
    parsed = list(csv.DictReader(io.StringIO("\n".join(lines))))
    assert [p["SourceEvent"] for p in parsed] == ['{"amount":2}', '{"amount":1,"t":"a \\"quoted\\" word"}']
    assert parsed[0]["RoutedEvent"] == "" and parsed[0]["Timestamp"] == "2023-11-14T22:13:21Z"
    assert report.export_name("MATCHED", 5) == "audit_matched_5.csv"
    assert [r["offset"] for r in report.top(audits, "UNMATCHED", at("2023-01-01"), at("2024-01-01"), 1).collect()] == [1]


def test_poison_messages_are_set_aside(spark):
    audits = A.audits(events(spark, ['{"amount":1}']), R.take_snapshot(R.rule_frame(spark, [OVER])))
    good = A.audit_json(audits).select("audit_json")
    bad = spark.createDataFrame([("{oops",), ("[1]",), ("{}",), (None,)], "audit_json string")
    rows, poison = A.read_audit_json(good.unionByName(bad))
    assert rows.select(*[c for c in audits.columns if c in rows.columns]).collect() == audits.select(*[c for c in audits.columns if c in rows.columns]).collect()
    assert poison.count() == 4


def test_stream_equals_batch_and_follows_rule_changes(spark, sf):
    folder = shared_dir(spark, "stream")
    source = X.click_columns(X.table(spark, sf, "events")).select(*S.RAW_EVENTS.fieldNames())
    source.repartition(2).write.parquet(f"{folder}/in")
    log = RuleLog(spark, folder)
    log.append(changes(spark, [change("c1", "over", 1, threshold=100)]))
    store = AuditStore(spark, f"{folder}/out")
    run = lambda: pipeline.start(
        stream_events(spark, f"{folder}/in", files_per_batch=1), store, lambda: R.current_rules(log.changes()), f"{folder}/checkpoint", json_sink=True
    ).awaitTermination()
    run()
    kinds = lambda df: {tuple(r) for r in df.groupBy("rule_id", "audit_type").count().collect()}
    batch = A.audits(source, R.take_snapshot(R.current_rules(log.changes())))
    assert kinds(store.latest()) == kinds(batch) and store.all_versions().select("batch_id").distinct().count() == 2
    assert store.part("routed_events").count() == batch.where("audit_type = 'MATCHED'").count()
    assert store.part("quarantine").count() == 29 and store.part("audit_json").count() == 1000
    run()  # nothing new
    pipeline.process_batch(spark.read.parquet(f"{folder}/in").limit(0), 9, store, lambda: None)  # an empty batch writes nothing
    assert store.all_versions().count() == 1000
    log.append(changes(spark, [change("c2", "all", 9, threshold=-1)]))
    source.limit(50).coalesce(1).withColumn("offset", F.col("offset") + 100000).write.mode("append").parquet(f"{folder}/in")
    run()
    late = store.latest().where("offset >= 100000").select("rule_id").distinct().collect()
    assert {"c1", "c2"} <= {r[0] for r in late}


def test_plan_is_one_narrow_stage(spark, sf):
    """No join, no cross product, no shuffle, and one parse between scan and audits."""
    source = X.click_columns(X.table(spark, sf, "events"))
    plan = A.audits(source, R.take_snapshot(seed_rules(spark)), reasons=False, source=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Exchange" not in plan
    assert plan.count("parseJson(") == 1 and plan.count("Generate explode") == 1
    matched = evaluate(source, R.take_snapshot(seed_rules(spark)), matched_only=True)
    assert matched._jdf.queryExecution().executedPlan().toString().count("parseJson(") == 1


def test_scan_reads_only_needed_columns(spark, sf):
    folder = shared_dir(spark, "prune")
    store = AuditStore(spark, folder)
    store.write_batch(A.audits(X.click_events(spark, sf), R.take_snapshot(X.click_rules(spark)), reasons=False, source=False), 1, 0)
    recent = store.batch(1, 0).where((F.col("day") >= "2024-01-20") & (F.col("timestamp") >= at("2024-01-20 00:00:00")))
    plan = rollup.hour_rollups(recent)._jdf.queryExecution().executedPlan().toString()
    assert "audit_id" not in plan.split("ReadSchema")[1] and "day" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan


def test_kafka_settings_and_records(spark):
    options = kafka_options("host:9092", "source-events", 500)
    assert options["startingOffsets"] == "earliest" and options["kafka.isolation.level"] == "read_committed" and options["maxOffsetsPerTrigger"] == "500"
    assert kafka_records(spark.range(1).select(F.lit("k").alias("event_id"), F.lit("v").alias("body")), "event_id", "body").first().asDict() == {"key": "k", "value": "v"}
