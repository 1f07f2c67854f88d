"""Outcome of rules on small events: known cases, edge inputs, and brute force over random ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

import brute
from arbitrail.operators import clauses as K
from arbitrail.operators.audit import audits, routed_events
from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.evaluate import evaluate, event_summary, event_verdicts
from arbitrail.operators import matching
from arbitrail.operators.matching import Line, match_pairs
from arbitrail.operators.rules import PackPass, rule_frame, take_snapshot
from arbitrail.plans import fixtures as X
from arbitrail.rulesets.seed import seed_rules
from arbitrail.schema import RAW_EVENTS
from arbitrail.session import shared_dir

OVER = rule("r1", "over", [clause("gt", "amount", 1000)])
ODD = rule("r2", "odd", [clause("nonexistentMethod", "amount")])


def events(spark, texts):
    rows = [("t", i % 3, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("offset")))


def run(spark, texts, rules, **options):
    out = evaluate(events(spark, texts), take_snapshot(rule_frame(spark, rules)), **options)
    return {(r["offset"], r["rule_id"]): r for r in out.collect()}


def test_match_no_match_and_reasons(spark):
    got = run(spark, ['{"amount":5000}', '{"amount":10}', '{"amount":"not-a-number"}'], [OVER, ODD], reasons=True)
    assert (got[0, "r1"]["audit_type"], got[0, "r1"]["reason"]) == ("MATCHED", None)
    assert got[1, "r1"]["audit_type"] == "UNMATCHED"
    assert got[1, "r1"]["reason"] == "Condition not met: ['amount'] > 1000 (actual values: amount=10)"
    assert got[2, "r1"]["audit_type"] == "ERRORED" and got[2, "r1"]["reason"].startswith("CLAUSE_ERROR 1 amount")
    assert {got[i, "r2"]["audit_type"] for i in range(3)} == {"ERRORED"}


def test_verdict_precedence_and_missing_results(spark):
    source = events(spark, ['{"amount":5000}', '{"amount":10}', "{bad json"])
    verdicts = lambda rules, **sizes: {r["offset"]: r["verdict"] for r in event_verdicts(source, take_snapshot(rule_frame(spark, rules), **sizes)).collect()}
    for sizes in ({}, {"inline_rules": 0}):
        assert verdicts([OVER, ODD], **sizes) == {0: "MATCHED", 1: "ERRORED", 2: "ERRORED"}
        assert verdicts([OVER], **sizes) == {0: "MATCHED", 1: "UNMATCHED", 2: "ERRORED"}
        assert verdicts([{**OVER, "active": False}], **sizes) == {0: "UNMATCHED", 1: "UNMATCHED", 2: "ERRORED"}


def test_verdicts_need_no_shuffle(spark, sf):
    source = spark.read.schema(RAW_EVENTS).parquet(_stored_events(spark, sf))
    plan = event_verdicts(source, take_snapshot(rule_frame(spark, [OVER, ODD])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "Generate" not in plan


def _stored_events(spark, sf):
    folder = shared_dir(spark, "events")
    X.click_columns(X.table(spark, sf, "events")).write.parquet(f"{folder}/in")
    return f"{folder}/in"


def test_summary_lists_rules_and_errors(spark):
    source = events(spark, ['{"amount":5000}'])
    for sizes in ({}, {"inline_rules": 0}):
        row = event_summary(source, take_snapshot(rule_frame(spark, [OVER, ODD, ODD]), **sizes)).first()
        assert (row["matched_rule_ids"], row["evaluated_rule_ids"], list(row["errors"])) == (["r1"], ["r1", "r2", "r2"], ["r2"])


def test_no_active_rules_gives_one_row_per_event(spark):
    got = run(spark, ['{"amount":1}', "42"], [{**OVER, "active": False}], reasons=True)
    assert {k: (r["audit_type"], r["reason"]) for k, r in got.items()} == {
        (0, "_none"): ("UNMATCHED", "No active rules for evaluation"),
        (1, "_parse"): ("ERRORED", "JSON parse failure: Cannot parse event JSON into a Map root"),
    }


def test_parse_edges(spark):
    texts = ["", None, "null", "[1,2,3]", "42", "{not json", '  \n{"a":1}', '{"a":1} trailing', '{"a":1,"a":2}', '{"tags":["a","b"]}']
    got = run(spark, texts, [rule("two", "", [clause("eq", "a", 2)])])
    assert [i for i in range(len(texts)) if (i, "_parse") in got] == [0, 1, 2, 3, 4, 5]
    assert [i for i in range(6, 10) if got[i, "two"]["audit_type"] == "MATCHED"] == [8]  # the last of repeated keys counts


def test_array_selection(spark):
    text = json.dumps({"order": {"items": [{"price": 600}, {"price": 400}]}})
    mixed = json.dumps({"order": {"items": [{"price": 600}, 7]}})
    rules = [rule(f"over{n}", "", [clause("any_gt", "order.items", n, item="price")]) for n in (500, 1000)]
    got = run(spark, [text, '{"order":{"items":[]}}', '{"order":{}}', '{"order":"x"}', mixed], rules)
    assert [got[i, "over500"]["audit_type"] for i in range(5)] == ["MATCHED", "UNMATCHED", "ERRORED", "ERRORED", "ERRORED"]
    assert got[0, "over1000"]["audit_type"] == "UNMATCHED"


def test_integers_beyond_double_precision(spark):
    big = 2**53 + 1
    rules = [rule("eq", "", [clause("eq", "n", big)]), rule("gt", "", [clause("gt", "n", big - 1)]), rule("lt", "", [clause("lt", "n", big)])]
    got = run(spark, [f'{{"n":{big}}}', f'{{"n":{big - 1}}}'], rules)
    assert [got[0, r]["audit_type"] for r in ("eq", "gt", "lt")] == ["MATCHED", "MATCHED", "UNMATCHED"]
    assert [got[1, r]["audit_type"] for r in ("eq", "gt", "lt")] == ["UNMATCHED", "UNMATCHED", "MATCHED"]


def test_text_is_never_read_as_a_number(spark):
    got = run(spark, ['{"amount":"5000"}'], [OVER, rule("eq", "", [clause("eq", "amount", 5000)]), rule("txt", "", [clause("eq", "amount", "5000")])])
    assert [got[0, r]["audit_type"] for r in ("r1", "eq", "txt")] == ["ERRORED", "UNMATCHED", "MATCHED"]


def test_earlier_false_hides_later_error(spark):
    no, bad = clause("eq", "type", "x"), clause("gt", "a.b", 1)
    got = run(spark, ['{"type":"y"}'], [rule("f", "", [no, bad]), rule("e", "", [bad, no])])
    assert (got[0, "f"]["audit_type"], got[0, "f"]["failed_clause_no"]) == ("UNMATCHED", 1)
    assert (got[0, "e"]["audit_type"], got[0, "e"]["failed_clause_no"]) == ("ERRORED", 1)


def test_routed_event_belongs_to_its_own_rule(spark):
    rules = rule_frame(spark, [rule("a", "", []), rule("x_a", "", [])])
    source = events(spark, ['{"type":"t","v":[1,{"w":null}]}', '{"type":null}', '{"v":1}'])
    routed = routed_events(audits(source, take_snapshot(rules))).collect()
    types = {(r["rule_id"], json.loads(r["routed_event"])["type"]) for r in routed}
    assert types == {("a", "t_a"), ("x_a", "t_x_a"), ("a", "null_a"), ("x_a", "null_x_a"), ("a", "unknown_a"), ("x_a", "unknown_x_a")}
    assert {"type": "t", "v": [1, {"w": None}]} in [json.loads(r["routed_event"])["original_event"] for r in routed]


@pytest.mark.parametrize("sizes", [{}, {"inline_rules": 1}, {"inline_rules": 1, "inline_passes": 1}], ids=["inline", "portions", "packs"])
def test_routed_event_escapes_its_parts(spark, sizes):
    rules = rule_frame(spark, [rule('q"\\é', "", []), rule("z", "", [])])
    rows = routed_events(audits(events(spark, ['{"type":"a\\"b","v":"\\u00e9\\n"}']), take_snapshot(rules, **sizes))).collect()
    assert {json.loads(r["routed_event"])["type"] for r in rows} == {'a"b_q"\\é', 'a"b_z'}
    assert json.loads(rows[0]["routed_event"])["original_event"] == {"type": 'a"b', "v": "é\n"}


def random_rules(rng, n):
    def one():
        op = rng.choice(["gt", "ge", "lt", "le", "eq", "ne", "not_null", "starts_with", "any_gt", "any_le", "any_eq", "odd"])
        path = rng.choice(["a", "b", "m.x", "m.y", "deep.m.x"])
        literal = rng.choice([1, 2.5, 3, -1, "u", "uv", True, False])
        if op == "not_null":
            return clause(op, path)
        if op == "starts_with":
            return clause(op, path, rng.choice(["u", "uv"]))
        return clause(op, "l" if op.startswith("any_") else path, literal, item="p" if op.startswith("any_") else None)

    return [rule(f"r{i:03}", "", [one() for _ in range(rng.randint(0, 4))], active=rng.random() < 0.9) for i in range(n)]


def random_texts(rng, n):
    def scalar():
        return rng.choice([None, 1, 2, 3, 2.5, -1, "u", "uvw", "", True, False])

    def one():
        root = {k: scalar() for k in ("a", "b") if rng.random() < 0.8}
        if rng.random() < 0.8:
            root["m"] = rng.choice([{"x": scalar(), "y": scalar()}, {"y": [1]}, 5, None])
        if rng.random() < 0.5:
            root["deep"] = rng.choice([{"m": {"x": scalar()}}, {"m": None}, {}])
        if rng.random() < 0.8:
            root["l"] = rng.choice([[{"p": scalar()} for _ in range(rng.randint(0, 3))], [{"p": 1}, {}], [1], "no", [{"p": 1}, {"p": 9}]])
        return rng.choice([json.dumps(root)] * 9 + ["{oops"])

    return [one() for _ in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [{}, {"inline_passes": 1, "inline_rules": 5, "rules_per_pack": 20}, {"inline_passes": 1, "inline_rules": 5, "rules_per_pack": 20, "broadcast_bytes": 1}],
    ids=["inline", "broadcast packs", "salted packs"],
)
def test_every_plan_agrees_with_brute_force(spark, sizes):
    rng = random.Random(7)
    rules, texts = random_rules(rng, 90), random_texts(rng, 200)
    snapshot = take_snapshot(rule_frame(spark, rules), **sizes)
    assert isinstance(snapshot.passes[0], PackPass) == bool(sizes)
    got = {(r["offset"], r["rule_id"]): r["code"] for r in evaluate(events(spark, texts), snapshot).collect()}
    want = {(i, rid): c for i, t in enumerate(texts) for rid, c in brute.evaluate(t, rules).items()}
    assert got == want
    matched = evaluate(events(spark, texts), snapshot, matched_only=True).select("offset", "rule_id").collect()
    assert {tuple(r) for r in matched} == {k for k, c in want.items() if c == 0}
    pairs = match_pairs(events(spark, texts), snapshot).select("offset", "rule_id").collect()
    assert sorted(tuple(r) for r in pairs) == sorted(k for k, c in want.items() if c == 0)


@pytest.mark.parametrize("thresholds", [1, 2, 3, 8, 9])
def test_intervals_are_covered_once(thresholds):
    line = Line([float(x) for x in range(thresholds)])
    for low in range(2 * thresholds + 1):
        for high in range(low, 2 * thresholds + 1):
            nodes = line.nodes(low, high)
            assert len(nodes) <= 2 * line.depth
            for place in range(2 * thresholds + 1):
                above = {(place + (1 << line.depth)) >> level for level in range(line.depth + 1)}
                assert len(above & set(nodes)) == (low <= place <= high)
    assert line.nodes(*line.interval([{"lit_num": 0.0, "accepted": K.ACCEPTED[op]} for op in ("lt", "gt")])) == []


def test_matches_of_bounded_rules_and_few_signatures(spark, monkeypatch):
    monkeypatch.setattr(matching, "MAX_SIGNATURES", 1)
    big = 2**60 + 1
    rules = [rule(f"{op}{x}", op, [clause(op, "a", x)]) for op in ("gt", "ge", "lt", "le", "eq", "ne") for x in (-1, 0, 2.5, 7, big)]
    rules += [rule("in", "in", [clause("ge", "a", 0), clause("lt", "a", 7), clause("gt", "b.c", 1)]), rule("out", "out", [clause("lt", "a", 0), clause("gt", "a", 7)])]
    rules += [rule("in", "in", [clause("eq", "a", 7)]), rule("all", "all", []), rule("t", "t", [clause("eq", "s", "x")]), rule("u", "u", [clause("eq", "b.s", "x"), clause("le", "a", 2.5)])]
    values = ["-2", "-1", "-0.0", "0", "2", "2.5", "7", "7.0", "8e300", str(big), str(big - 1), "null", '"7"', "true", "[7]", "{}"]
    texts = [f'{{"a":{a},"s":"x","b":{{"c":{c},"s":"x"}}}}' for a in values for c in (1, 2)] + ["{}", '{"b":1}', "[]", "null", "", None, '{"s":"x"}']
    snapshot = take_snapshot(rule_frame(spark, rules))
    pairs = [df.select("offset", "rule_id").collect() for df in (match_pairs(events(spark, texts), snapshot), evaluate(events(spark, texts), snapshot, matched_only=True))]
    assert len(pairs[0]) > 100 and sorted(map(tuple, pairs[0])) == sorted(map(tuple, pairs[1]))
    assert match_pairs(events(spark, texts), take_snapshot(rule_frame(spark, rules[-5:-4]))).isEmpty()


# The demo event formula and the tallies it must give with the default rules.
GOLDEN = {
    25: {"compliance-check-for-account-in-emea-region-rule-16": 3},
    1000: {
        "compliance-check-for-account-in-emea-region-rule-16": 180,
        "transaction-monitor-session-type-for-us-tier-rule-13": 106,
        "high-value-order-apac-audit-rule-30": 80,
        "high-value-order-eu-audit-rule-46": 64,
        "high-value-account-latam-audit-rule-45": 40,
    },
}


def demo_event(i):
    k = i % 5
    if i % 2 == 0:
        items = [{"id": f"it-{i}", "price": 500 + i * 10 % 1000, "tags": ["high-value"]}, {"id": f"it-{i + 1}", "price": 600 + i * 5 % 1000, "tags": ["promo"]}]
    else:
        items = [{"id": f"it-{i}", "price": 100 + i * 2 % 500, "tags": ["standard"]}]
    return json.dumps(
        {
            "type": "order_event",
            "amount": 500 + i * 500 % 50000,
            "region": ["US", "EU", "APAC", "LATAM", "EMEA"][k],
            "tier": ["premium", "gold", "vip", "standard", "basic"][k],
            "flagged": i % 3 == 0,
            "metadata": {"source": ["web", "mobile", "api", "legacy", "partner"][k], "priority": k + 1, "tax_rate": round(0.05 + i % 20 * 0.01, 2)},
            "order": {"items": items, "total_items": i % 3 + 1},
            "timestamp": f"2026-06-17T{i % 24:02}:{i * 7 % 60:02}:{i * 13 % 60:02}Z",
        }
    )


@pytest.mark.parametrize("n", sorted(GOLDEN))
def test_default_rules_on_demo_events(spark, n):
    outcomes = evaluate(events(spark, [demo_event(i) for i in range(n)]), take_snapshot(seed_rules(spark)))
    tally = {(r["rule_id"], r["audit_type"]): r["count"] for r in outcomes.groupBy("rule_id", "audit_type").count().collect()}
    assert {k[0]: v for k, v in tally.items() if k[1] == "MATCHED"} == GOLDEN[n]
    assert sum(tally.values()) == 100 * n and not [k for k in tally if k[1] == "ERRORED"]


def test_condition_rules_in_portions(spark):
    schema = "a double, b string"
    rules = [rule(f"s{i}", "", predicate=f"a > {i}D OR b = 'x'") for i in range(5)] + [OVER, rule("bad", "", predicate="a >"), rule("evil", "", predicate="java_method('java.lang.System', 'exit', 1) = 'x'")]
    source = events(spark, ['{"a":2.5,"topic":"shadow"}', '{"b":"x"}', "nope"])
    one = evaluate(source, take_snapshot(rule_frame(spark, rules), schema))
    many = evaluate(source, take_snapshot(rule_frame(spark, rules), schema, inline_rules=3))
    rows = lambda df: sorted((r["offset"], r["rule_id"], r["audit_type"]) for r in df.collect())
    assert rows(one) == rows(many)
    assert {r[1] for r in rows(one) if r[0] == 0} == {"s0", "s1", "s2", "s3", "s4", "r1", "evil"}
    assert [r for r in rows(one) if r[0] == 2] == [(2, "_parse", "ERRORED")]
    assert {r[1] for r in rows(one) if r[0] == 0 and r[2] == "MATCHED"} == {"s0", "s1", "s2"}
    assert {r[2] for r in rows(one) if r[1] == "evil"} == {"ERRORED"}


def test_codes_name_their_outcome():
    assert K.CODE_BASE > max(K.CAUSES)


def test_events_with_and_without_match_parse_each_event_once(spark, sf):
    from arbitrail.operators.evaluate import events_with_match, events_without_match

    raw, snapshot = X.click_events(spark, sf), take_snapshot(X.click_rules(spark).where("rule_id in ('c1', 'c2')"))
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    verdicts = event_verdicts(raw, snapshot)
    for split, kept in ((events_with_match, "verdict = 'MATCHED'"), (events_without_match, "verdict <> 'MATCHED'")):
        out = split(raw, snapshot).select("topic", "partition", "offset")
        assert parses(out) <= parses(verdicts)
        assert sorted(out.collect()) == sorted(verdicts.where(kept).select("topic", "partition", "offset").collect())
