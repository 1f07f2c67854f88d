"""The audit store: parts, commits, overlaps, rollups of replays."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arbitrail.operators import audit as A
from arbitrail.operators import rollup
from arbitrail.operators import rules as R
from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.parse import spread
from arbitrail.session import folder_exists, names_in, one_writer, read_text, shared_dir, write_text_once
from arbitrail.sources.commits import KEPT, CommitLog
from arbitrail.sources.events import stream_events
from arbitrail.sources.store import AuditStore
from arbitrail.streaming import pipeline


def at(text):
    return F.lit(text).cast("timestamp")


def records(spark, offsets, amount=5, day="2024-03-01", partition=0):
    rows = [("t", partition, i, json.dumps({"amount": amount})) for i in offsets]
    raw = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")
    return raw.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(at(f"{day} 00:00:00")) + F.col("offset") * 60))


def judged(spark, raw, limit=3):
    rules = R.rule_frame(spark, [rule("a", "", [clause("gt", "amount", limit)]), rule("b", "", [])])
    return A.audits(raw, R.take_snapshot(rules), reasons=False, source=False, routed=False)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def kinds(df):
    return Counter((r.offset, r.rule_id, r.audit_type) for r in df.collect())


def test_disjoint_batches_of_a_day_are_only_scanned(spark):
    store = AuditStore(spark, shared_dir(spark, "store"))
    for i in range(6):
        store.write_batch(judged(spark, records(spark, range(10 * i, 10 * i + 10))), 1, i)
    alone = store.latest()
    assert "Exchange" not in plan(alone) and "Join" not in plan(alone) and alone.count() == 120
    store.write_batch(judged(spark, records(spark, range(25, 28)), limit=9), 2, 0)
    both = store.latest()
    assert both.count() == 120 and kinds(both)[26, "a", "UNMATCHED"] == 1 and kinds(both)[24, "a", "MATCHED"] == 1
    shared, stretches = store._shared(store._parts(), {"2024-03-01"})
    assert len(shared) == 2 and [(r.low, r.high) for r in stretches.collect()] == [(25, 27)]
    assert "hashpartitioning(id_bytes" in plan(both)
    assert AuditStore(spark, shared_dir(spark, "store")).latest().isEmpty()


def test_repeats_within_a_batch_and_rules_of_one_id(spark):
    store, raw = AuditStore(spark, shared_dir(spark, "store")), records(spark, range(5))
    store.write_batch(judged(spark, raw.unionByName(raw.where("offset < 2"))), 1, 0)
    assert kinds(store.latest()) == {(i, r, "MATCHED"): 1 for i in range(5) for r in "ab"}
    twins = R.rule_frame(spark, [rule("a", "", [clause("gt", "amount", 9)]), rule("a", "", [])])
    store.write_batch(A.audits(raw, R.take_snapshot(twins), reasons=False, source=False), 2, 0)
    assert store.latest().where("rule_id = 'a'").count() == 5
    missing = judged(spark, raw).where("rule_id = 'a' or offset > 2")  # fewer audits than rules, but no repeats
    store.write_batch(missing, 3, 0)
    assert store.batch(3, 0).count() == 7


def test_facts_follow_nulls(spark):
    store = AuditStore(spark, shared_dir(spark, "store"))
    rows = judged(spark, records(spark, range(2))).withColumns({"partition": F.lit(None).cast("int"), "source_topic": F.lit(None).cast("string")})
    for run in (1, 2):
        store.write_batch(rows, run, 0)
    assert store.latest().count() == 4 and {r.run_seq for r in store.latest().collect()} == {2}


def test_entries_are_published_once_and_in_order(spark):
    folder = shared_dir(spark, "log")
    log, other = CommitLog(spark, folder), CommitLog(spark, folder)
    assert log.read()["commit"] == 0
    seen = []

    def slow(entry):
        seen.append(entry["commit"])
        if len(seen) == 1:  # another writer is faster
            other.publish(lambda e: {**e, "stale": ["theirs"]})
        return {**entry, "stale": [*entry["stale"], "ours"]}

    assert log.publish(slow)["stale"] == ["theirs", "ours"] and seen == [0, 1]
    file = f"{folder}/commits/000000000002.json"
    assert not write_text_once(spark, file, "x") and json.loads(read_text(spark, file))["commit"] == 2
    for _ in range(KEPT + 3):
        log.publish(lambda e: e)
    assert len([n for n in names_in(spark, f"{folder}/commits") if n.endswith(".json")]) == KEPT
    assert not [n for n in names_in(spark, f"{folder}/commits") if "tmp" in n]


def test_replaced_folders_stay_for_a_while(spark):
    store, raw = AuditStore(spark, shared_dir(spark, "store")), records(spark, range(3))
    old = store.write_batch(judged(spark, raw), 1, 0)
    new = store.write_batch(judged(spark, raw, limit=9), 1, 0)
    assert old != new and folder_exists(spark, old) and store.all_versions().count() == 6
    for _ in range(KEPT + 1):
        store.log.publish(lambda e: e)
    assert not folder_exists(spark, old) and folder_exists(spark, new)
    assert kinds(store.latest())[1, "a", "UNMATCHED"] == 1


def test_replays_of_other_tables_leave_audits(spark):
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(judged(spark, records(spark, range(3))), 1, 0)
    for n in (2, 1):
        store.write_part("quarantine", spark.range(n), 1, 0)
    assert store.part("quarantine").count() == 1 and store.latest().count() == 6


@pytest.mark.parametrize("compacted", [False, True])
def test_rollups_equal_the_audits_after_each_step(spark, compacted):
    store = AuditStore(spark, shared_dir(spark, "store"))

    def check():
        store.refresh_rollups(at("2024-04-01 00:00:00"))
        want, rows = store.latest(), lambda df: Counter(map(tuple, df.collect()))
        assert rows(store.rule_rollups()) == rows(rollup.rule_rollups(want)) and rows(store.hour_rollups()) == rows(rollup.hour_rollups(want))

    for batch_id, offsets in enumerate((range(0, 90), range(90, 150))):
        store.write_batch(judged(spark, records(spark, offsets)), 1, batch_id)
    check()
    if compacted:
        store.compact(5, at("2024-03-01 00:00:00"), at("2024-03-02 00:00:00"))
        check()
    store.write_batch(judged(spark, records(spark, range(0, 70)), limit=9), 1, 0)  # a replay with another rule and fewer events
    assert store.latest().count() == 260
    check()
    store.write_batch(judged(spark, records(spark, range(60, 100)), limit=1), 2, 0)  # a later run over parts of both
    check()
    store.compact(6, at("2024-03-01 00:00:00"), at("2024-03-03 00:00:00"))
    check()
    store.write_batch(judged(spark, records(spark, range(0, 70)), limit=2), 1, 0)
    check()
    assert len(store._parts()) == 2 and kinds(store.latest())[65, "a", "MATCHED"] == 1


def test_compaction_keeps_who_judged(spark):
    store = AuditStore(spark, shared_dir(spark, "store"))
    store.write_batch(judged(spark, records(spark, range(4))), 3, 0, stream="s")
    store.write_batch(judged(spark, records(spark, range(2)), limit=9), 4, 7, stream="s")
    store.compact(1, at("2024-03-01 00:00:00"), at("2024-03-02 00:00:00"))
    assert Counter((r.stream, r.run_seq, r.batch_id) for r in store.all_versions().collect()) == {("s", 3, 0): 4, ("s", 4, 7): 4}
    store.write_batch(judged(spark, records(spark, range(4)), limit=1), 2, 0, stream="s")  # an older run comes late and loses
    assert kinds(store.latest())[1, "a", "UNMATCHED"] == 1
    store.compact(1, at("2024-05-01 00:00:00"), at("2024-05-02 00:00:00"))  # nothing there


def test_clustered_days_are_merged_in_their_buckets(spark):
    root = shared_dir(spark, "store")
    store = AuditStore(spark, root)
    store.write_batch(judged(spark, records(spark, range(40))), 1, 0)
    store.compact(1, at("2024-03-01 00:00:00"), at("2024-03-02 00:00:00"), buckets=2)
    store.write_batch(judged(spark, records(spark, range(10, 20)), limit=9), 2, 0, buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = store.latest()
        assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
        assert both.count() == 80 and kinds(both)[15, "a", "UNMATCHED"] == 1 and kinds(both)[25, "a", "MATCHED"] == 1
        for part in store._parts():
            spark.sql(f"DROP TABLE audits_part_{part['name']}")
        assert kinds(AuditStore(spark, root).latest()) == kinds(both)  # as another session finds it
        store.write_batch(judged(spark, records(spark, range(12, 14)), limit=1), 3, 0)
        assert store.latest().count() == 80 and kinds(store.latest())[13, "a", "MATCHED"] == 1
        store.write_batch(judged(spark, records(spark, range(5)), limit=9), 1, 0)  # a replay of what was compacted
        assert store.latest().count() == 10 + 20 and kinds(store.latest())[4, "a", "UNMATCHED"] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_newest_audits_read_the_newest_day_only(spark):
    store = AuditStore(spark, shared_dir(spark, "store"))
    for i, day in enumerate(("2024-03-01", "2024-03-02", "2024-03-03")):
        store.write_batch(judged(spark, records(spark, range(100 * i, 100 * i + 50), day=day)), 1, i)
    rows = store.top("MATCHED", at("2024-03-04 12:00:00"), at("2024-03-01 00:00:00"))
    assert {r.offset for r in rows.collect()} == set(range(245, 250)) and len(rows.inputFiles()) > 0
    assert all("day=2024-03-0" in f and "day=2024-03-01" not in f for f in rows.inputFiles())
    assert store.top("ERRORED", at("2024-03-04 12:00:00"), at("2024-03-01 00:00:00")).isEmpty()
    assert store.top("MATCHED", at("2024-03-04 12:00:00"), at("2024-03-01 00:00:00"), n=1000).count() == 300


def test_a_task_of_a_small_source_meets_few_days(spark):
    raw = spark.range(4000).select(
        F.lit("t").alias("topic"), (F.col("id") % 20).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.timestamp_seconds(F.col("id") * 650).alias("ts"), F.lit("{}").alias("value"),
    )
    met = spread(raw.repartition(3)).groupBy(F.spark_partition_id()).agg(F.count_distinct(F.to_date("ts")).alias("days")).collect()
    assert len(met) == 4 and max(r.days for r in met) <= 12  # of 31


def test_a_stopped_batch_is_seen_in_no_table(spark, monkeypatch):
    store, raw = AuditStore(spark, shared_dir(spark, "store")), records(spark, range(3))
    rules = lambda: R.rule_frame(spark, [rule("a", "", [clause("gt", "amount", 3)]), rule("bad", "", [clause("gt", "", 3)])])
    with monkeypatch.context() as m:
        m.setattr(pipeline, "quarantine", lambda events: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.process_batch(raw, 0, store, rules, stream="s")
    assert store.latest().isEmpty() and store.log.read()["parts"] == []
    pipeline.process_batch(raw, 0, store, rules, stream="s")
    assert store.latest().count() == 6 and store.part("routed_events").count() == 3
    assert [tuple(r) for r in store.load_errors().select("rule_id", "verdict").collect()] == [("bad", "bad_clause")]


def test_a_fault_that_is_no_records_is_raised(spark, monkeypatch):
    store, raw = AuditStore(spark, shared_dir(spark, "store")), records(spark, range(6))
    rules = lambda: R.rule_frame(spark, [rule("a", "", [clause("gt", "amount", 3)])])
    broken = lambda condition: raw.withColumn("value", F.when(F.expr(condition), F.raise_error(F.lit("torn"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException, match="torn"):
        pipeline.process_or_set_aside(broken("offset > 1"), 0, store, rules, attempts=1, most_broken=2, stream="s")
    assert store.log.read()["parts"] == []
    with monkeypatch.context() as m:
        m.setattr(pipeline, "quarantine", lambda events: spark.sql("select assert_true(false, 'disk gone')"))
        with pytest.raises(PySparkException, match="disk gone"):
            pipeline.process_or_set_aside(raw, 0, store, rules, attempts=2, stream="s")
    pipeline.process_or_set_aside(broken("offset in (1, 4)"), 0, store, rules, attempts=1, stream="s")
    assert {r.offset for r in store.latest().collect()} == {0, 2, 3, 5}
    aside = store.part("quarantine").collect()
    assert {r.offset for r in aside} == {1, 4} and all("torn" in r.reason for r in aside)


def test_an_audit_stream_evaluates_the_audits_once(spark, sf, monkeypatch):
    """The batches' files are cut from one stored evaluation, not from one single-task evaluation for each file."""
    from arbitrail.plans import catalog

    seen = spark.sparkContext.accumulator(0)
    real = catalog.click_audits

    def counted(spark, sf, **options):
        audits = real(spark, sf, **options)

        @F.udf("boolean")
        def count(_):
            seen.add(1)
            return True

        return audits.where(count("audit_id"))

    monkeypatch.setattr(catalog, "click_audits", counted)
    folder, _ = catalog._audit_stream(spark, sf, copies=2)
    assert seen.value == spark.read.parquet(f"{folder}/audits").count()


def test_a_batch_written_again_without_repeats_leaves_one_copy_on_disk(spark):
    store, raw = AuditStore(spark, shared_dir(spark, "store")), records(spark, range(5))
    store.write_batch(judged(spark, raw.unionByName(raw.where("offset < 2"))), 1, 0)
    on_disk = spark.read.parquet(f"{store.root}/audits")
    assert on_disk.count() == store.latest().count() == 10 and len(names_in(spark, f"{store.root}/audits")) == 1


def test_a_clustered_batch_is_written_by_more_tasks_than_it_has_buckets(spark, tmp_path):
    """Each writing task holds its ids' share of every bucket, not a whole bucket of the batch."""
    import glob

    root = shared_dir(spark, "store")
    store = AuditStore(spark, root)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_batch(judged(spark, records(spark, range(400))), 1, 0, buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{root.removeprefix('file:')}/audits/part=*/day=2024-03-01/*.parquet")
    assert len(files) > 2
    assert sorted(int(f.rsplit("_", 1)[1].split(".")[0]) for f in files)[-1] == 1  # still two buckets
    assert store.latest().count() == 800 and kinds(store.latest())[399, "a", "MATCHED"] == 1


def _foreign(rows):
    """Some audits with ids of another system, some without."""
    own = F.when(F.col("offset") % 3 == 1, F.concat(F.lit("x-"), "rule_id", F.col("offset").cast("string"))).when(F.col("offset") % 3 == 0, F.col("audit_id"))
    return rows.withColumns({"audit_id": own, "event_id": F.when(F.col("offset") < 4, F.col("event_id"))})


@pytest.mark.parametrize("buckets", [0, 2])
def test_ids_that_can_be_made_are_not_stored(spark, buckets):
    """the stored files hold only ids that don't follow from place and rule, and every reader gets them all."""
    ids = lambda df: Counter((r.offset, r.rule_id, r.audit_id, r.event_id) for r in df.collect())
    broken = spark.createDataFrame([("t", 0, 90, "{bad")], "topic string, partition int, offset bigint, value string").withColumn("ts", at("2024-03-01 09:00:00"))
    rows = judged(spark, records(spark, range(9)).unionByName(broken))
    store, other = (AuditStore(spark, shared_dir(spark, "store")) for _ in range(2))
    folder = store.write_batch(rows, 1, 0, buckets=buckets)
    stored = spark.read.parquet(folder)
    assert stored.count() == 19 and stored.where("audit_id is not null or event_id is not null").isEmpty()
    assert ids(store.latest()) == ids(store.all_versions()) == ids(rows) and ids(store.batch(1, 0)) == ids(rows)
    named = _foreign(rows).where("audit_id is not null")
    other.write_batch(named, 1, 0, buckets=buckets)
    other.write_batch(named, 2, 0, buckets=buckets)
    assert ids(other.latest()) == ids(named) and {r.run_seq for r in other.latest().collect()} == {2}
    other.compact(3, at("2024-03-01 00:00:00"), at("2024-03-02 00:00:00"), buckets=buckets)
    assert ids(other.all_versions()) == ids(named)


def test_audits_meet_without_their_ids_and_stay_where_no_other_part_has_them(spark):
    """one exchange, by the record, that carries no id; the stretches come to the rows, not the rows to them."""
    store = AuditStore(spark, shared_dir(spark, "store"))
    for run, offsets in ((1, range(30)), (2, range(20, 40))):
        store.write_batch(judged(spark, records(spark, offsets)), run, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = plan(store.latest())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    compared = [line for line in both.splitlines() if "LeftAnti" in line]
    assert compared and all("BroadcastHashJoin" in line for line in compared)
    assert "sha2(" in both and "sha2(" not in both[both.index("hashpartitioning(id_bytes") :]


def test_messages_are_parsed_once(spark):
    """F4, F8: the rows are chosen after the parsing, not by filters that repeat it."""
    texts = A.audit_json(judged(spark, records(spark, range(4)))).select("audit_json")
    bad = spark.createDataFrame([("{",), (None,), ('{"auditId": null}',), ("[]",), ('{"auditId": "a", "offset": "x"}',)], "audit_json string")
    folder = shared_dir(spark, "messages")
    texts.unionByName(bad).write.parquet(folder)
    readable, poison = A.read_audit_json(spark.read.parquet(folder))
    assert "Filter (" not in plan(readable) + plan(poison) and plan(readable).count("from_json(") == plan(poison).count("from_json(") == 1
    assert readable.count() == 8 and Counter(r.audit_json for r in poison.collect()) == Counter(r.audit_json for r in bad.collect())


def test_a_stream_keeps_each_audit_once_without_its_ids(spark):
    """ids that can be made are neither kept nor moved; ids of another system count as they are, and null ones are all kept."""
    folder, rows = shared_dir(spark, "stream"), _foreign(judged(spark, records(spark, range(9))))
    for part in (rows, rows.where("offset < 7"), rows):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = stream_events(spark, f"{folder}/in", rows.schema, files_per_batch=1)
    pipeline.start_dedup(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    kept = Counter((r.offset, r.rule_id, r.audit_id, r.event_id) for r in pipeline.deduplicated(spark, f"{folder}/out").collect())
    once = Counter((r.offset, r.rule_id, r.audit_id, r.event_id) for r in rows.where("audit_id is not null").collect())
    assert {k: n for k, n in kept.items() if k[2]} == once and {k[0] for k in kept if not k[2]} <= {2, 5, 8}
    on_disk = spark.read.parquet(f"{folder}/out")
    assert {r.offset % 3 for r in on_disk.where("audit_id is not null").collect()} == {1}


def test_one_writer_is_only_for_a_while(spark):
    """a batch's days come in order, so that a task doesn't hold the files of many days open."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), one_writer(spark):
        assert spark.conf.get(name) == "0"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before
