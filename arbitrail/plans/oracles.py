"""DuckDB SQL for the registered queries, computed from the columns rather than from JSON."""

from __future__ import annotations

from arbitrail.plans.catalog import PRESET_AS_OF, RANGE, WINDOW_AS_OF
from arbitrail.rulesets.seed import seed_rows
from arbitrail.schema import CSV_HEADER, NO_RULES_REASON, PARSE_REASON, ROUTED_MESSAGE

EVENT = 'topic, "partition", "offset"'
HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00Z')"

EV = """
ev AS (
  SELECT event_id, ts, user_id, event_type AS type, value AS amount, 'source-events' AS topic,
    CAST(event_id % 20 AS INTEGER) AS "partition", event_id // 20 AS "offset",
    (event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0) AS bad,
    CASE WHEN event_id % 29 = 0 THEN 'text' WHEN event_id % 31 = 0 THEN 'null' ELSE 'num' END AS akind,
    event_id % 37 <> 0 AS has_meta,
    (['web','mobile','api','legacy','partner'])[CAST(user_id % 5 + 1 AS INTEGER)] AS source,
    CAST(json_extract(props, '$.k') AS INTEGER) % 5 + 1 AS priority,
    (CAST(json_extract(props, '$.k') AS INTEGER) % 20) / 100.0 AS tax_rate,
    event_id % 41 = 0 AS ts_num,
    CASE WHEN event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 THEN 0 ELSE (event_id * 37) % 1000 END AS parse_nano,
    CASE WHEN event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 THEN 0 ELSE (event_id * 53) % 5000 END AS eval_nano
  FROM events),
txt AS (
  SELECT *,
    CASE akind WHEN 'text' THEN '"amount":"not-a-number",' WHEN 'null' THEN '' ELSE '"amount":' || CAST(amount AS VARCHAR) || ',' END AS amount_part,
    '{"source":"' || source || '","priority":' || priority || ',"tax_rate":' || CAST(CAST(tax_rate AS DOUBLE) AS VARCHAR) || '}' AS meta_text,
    CASE WHEN ts_num THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) ELSE '"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"' END AS ts_part
  FROM ev),
raw AS (
  SELECT *,
    CASE WHEN event_id % 97 = 0 THEN '{bad json' WHEN event_id % 101 = 0 THEN '[1,2,3]' WHEN event_id % 103 = 0 THEN 'null'
      ELSE '{"type":"' || type || '",' || amount_part || '"user_id":' || user_id || ',' ||
        CASE WHEN has_meta THEN '"metadata":' || meta_text || ',' ELSE '' END || '"timestamp":' || ts_part || '}' END AS val
  FROM txt),
"""

# One state per (event, rule): M, or U/E with the number of the deciding clause.
PAIRS = """
names(rule_id, expr) AS (VALUES
  ('c1', '[''amount''] > 100'), ('c2', '[''type''] == ''purchase'' and [''metadata''][''source''] == ''web'''),
  ('c3', '[''metadata''][''priority''] <= 2'), ('c4', ''), ('c5', '[''amount''] > 100 and [''metadata''][''tax_rate''] >= 0.1'),
  ('c6', 'true'), ('c7', ''), ('c9', '[''flagged''] == true')),
pairs AS (
  SELECT r.*, n.rule_id, n.expr, CASE n.rule_id
    WHEN 'c1' THEN CASE WHEN akind = 'text' THEN 'E1' WHEN akind = 'num' AND amount > 100 THEN 'M0' ELSE 'U1' END
    WHEN 'c2' THEN CASE WHEN type <> 'purchase' THEN 'U1' WHEN NOT has_meta THEN 'E2' WHEN source = 'web' THEN 'M0' ELSE 'U2' END
    WHEN 'c3' THEN CASE WHEN NOT has_meta THEN 'E1' WHEN priority <= 2 THEN 'M0' ELSE 'U1' END
    WHEN 'c4' THEN CASE WHEN ts_num THEN 'E2' WHEN year(ts) = 2024 THEN 'M0' ELSE 'U2' END
    WHEN 'c5' THEN CASE WHEN akind = 'text' THEN 'E1' WHEN akind = 'null' OR amount <= 100 THEN 'U1'
        WHEN NOT has_meta THEN 'E2' WHEN tax_rate >= 0.10 THEN 'M0' ELSE 'U2' END
    WHEN 'c6' THEN 'M0' WHEN 'c7' THEN 'E1' ELSE 'U1' END AS st
  FROM raw r CROSS JOIN names n WHERE NOT bad),
audits AS (
  SELECT *, CASE left(st, 1) WHEN 'M' THEN 'MATCHED' WHEN 'U' THEN 'UNMATCHED' ELSE 'ERRORED' END AS audit_type,
    CASE WHEN st <> 'M0' THEN CAST(right(st, 1) AS INTEGER) END AS failed_clause_no,
    sha256(concat_ws('|', topic, "partition", "offset", rule_id)) AS audit_id,
    sha256(concat_ws('|', topic, "partition", "offset", '_event')) AS event_hash
  FROM pairs
  UNION ALL
  SELECT *, '_parse', '', 'E0', 'ERRORED', NULL, sha256(concat_ws('|', topic, "partition", "offset", '_event')),
    sha256(concat_ws('|', topic, "partition", "offset", '_event'))
  FROM raw WHERE bad)
"""

WITH = "WITH " + EV + PAIRS

ROLL = (
    WITH
    + f""", rr AS (
  SELECT {HOUR} AS hour, rule_id, count(*) FILTER (audit_type = 'MATCHED') AS matched,
    count(*) FILTER (audit_type = 'UNMATCHED') AS unmatched, count(*) FILTER (audit_type = 'ERRORED') AS errored,
    count(*) AS "count", CAST(sum(parse_nano) AS BIGINT) AS parse_sum, CAST(sum(eval_nano) AS BIGINT) AS eval_sum,
    CAST(sum(parse_nano + eval_nano) AS BIGINT) AS total_sum
  FROM audits GROUP BY 1, 2),
hr AS (SELECT {HOUR} AS hour, count(DISTINCT (topic, "partition", "offset")) AS messages FROM audits GROUP BY 1)
"""
)

INSTANT = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
  WHEN epoch_us(ts) % 1000 = 0 THEN '.' || strftime(ts, '%g') ELSE '.' || strftime(ts, '%f') END || 'Z'"""

PATHS = """CASE rule_id || failed_clause_no WHEN 'c11' THEN 'amount' WHEN 'c21' THEN 'type' WHEN 'c22' THEN 'metadata.source'
  WHEN 'c31' THEN 'metadata.priority' WHEN 'c42' THEN 'timestamp' WHEN 'c51' THEN 'amount' WHEN 'c52' THEN 'metadata.tax_rate'
  WHEN 'c71' THEN 'amount' END"""
CAUSES = """CASE rule_id || failed_clause_no WHEN 'c11' THEN 'the value cannot be compared with the literal'
  WHEN 'c22' THEN 'the enclosing object is absent' WHEN 'c31' THEN 'the enclosing object is absent'
  WHEN 'c42' THEN 'the value is not a text' WHEN 'c51' THEN 'the value cannot be compared with the literal'
  WHEN 'c52' THEN 'the enclosing object is absent' WHEN 'c71' THEN 'the operation is not known' END"""
ERROR_REASON = f"CASE WHEN rule_id = '_parse' THEN '{PARSE_REASON}' ELSE 'CLAUSE_ERROR ' || failed_clause_no || ' ' || {PATHS} || ': ' || {CAUSES} END"

SHOWN = """concat_ws(', ',
    CASE WHEN contains(expr, 'type') THEN 'type=' || type END,
    CASE WHEN contains(expr, 'amount') AND akind <> 'null' THEN 'amount=' || CASE akind WHEN 'text' THEN 'not-a-number' ELSE CAST(amount AS VARCHAR) END END,
    CASE WHEN contains(expr, 'user_id') THEN 'user_id=' || user_id END,
    CASE WHEN contains(expr, 'metadata') AND has_meta THEN 'metadata=' || meta_text END)"""
REASON = f"CASE WHEN audit_type = 'MATCHED' THEN NULL ELSE 'Condition not met: ' || expr || CASE WHEN {SHOWN} = '' THEN '' ELSE ' (actual values: ' || {SHOWN} || ')' END END"

CHANGES = """
WITH ch AS (
  SELECT o_orderkey AS seq, o_orderdate AS updated_at, o_orderstatus <> 'F' AS active,
    CASE WHEN o_orderkey % 13 = 0 THEN 'delete' ELSE 'put' END AS op,
    CASE WHEN o_orderkey % 17 = 0 THEN '!!!' ELSE 'Order ' || o_orderpriority || ' watch (Customer ' || o_custkey || ')' END AS description,
    '[''amount''] > ' || CAST(floor(o_totalprice) AS BIGINT) AS expression,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'cust-' || o_custkey END AS given
  FROM orders),
named AS (
  SELECT *, CASE WHEN given <> '' THEN given ELSE coalesce(nullif(
    regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'rule-' || seq) END AS rule_id
  FROM ch),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY updated_at DESC, seq DESC) AS rn FROM named) WHERE rn = 1 AND op <> 'delete')
"""


def _seed_values() -> str:
    rows = []
    for i, r in enumerate(seed_rows()):
        c = {(x["op"], x["path"]): x for x in r["clauses"]}
        rate = c.get(("ge", "metadata.tax_rate"), {}).get("lit_num")
        price = c.get(("any_gt", "order.items"), {}).get("lit_int")
        prefix = c.get(("starts_with", "timestamp"), {}).get("lit_str")
        opt = lambda v: "NULL" if v is None else repr(v)
        rows.append(
            f"('{r['description']}', {c['gt', 'amount']['lit_int']}, '{c['eq', 'region']['lit_str']}', '{c['eq', 'metadata.source']['lit_str']}', "
            f"{c['le', 'metadata.priority']['lit_int']}, '{c['eq', 'tier']['lit_str']}', {opt(rate)}, {opt(price)}, {opt(prefix)})"
        )
    return ",\n".join(rows)


def _sales() -> str:
    return f"""
WITH seeds(description, amount, region, source, priority, tier, rate, price, prefix) AS (VALUES {_seed_values()}),
rules AS (SELECT *, regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS rule_id FROM seeds),
items AS (SELECT l_orderkey, max(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS hi FROM lineitem GROUP BY 1),
sales AS (
  SELECT o_orderkey, 'source-events' AS topic, CAST(o_orderkey % 20 AS INTEGER) AS "partition", o_orderkey // 20 AS "offset",
    CAST(floor(o_totalprice / 10) AS BIGINT) AS amount,
    CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'EU' WHEN 'ASIA' THEN 'APAC' WHEN 'AFRICA' THEN 'LATAM' WHEN 'MIDDLE EAST' THEN 'EMEA' END AS region,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'premium' WHEN 'BUILDING' THEN 'gold' WHEN 'FURNITURE' THEN 'vip' WHEN 'HOUSEHOLD' THEN 'standard' WHEN 'MACHINERY' THEN 'basic' END AS tier,
    (['web','mobile','api','legacy','partner'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS source,
    CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, CAST((o_orderkey % 20 + 5) / 100.0 AS DOUBLE) AS rate,
    hi, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN items ON l_orderkey = o_orderkey),
judged AS (
  SELECT e.*, r.rule_id, CASE
    WHEN NOT e.amount > r.amount THEN 1 WHEN e.region IS DISTINCT FROM r.region THEN 2 WHEN e.source <> r.source THEN 3
    WHEN NOT e.priority <= r.priority THEN 4 WHEN e.tier IS DISTINCT FROM r.tier THEN 5
    WHEN r.rate IS NOT NULL THEN CASE WHEN e.rate >= r.rate THEN 0 ELSE 6 END
    WHEN r.price IS NOT NULL THEN CASE WHEN coalesce(e.hi, 0) > r.price THEN 0 ELSE 7 END
    ELSE CASE WHEN starts_with(e.stamp, r.prefix) THEN 0 ELSE 7 END END AS failed
  FROM sales e CROSS JOIN rules r)
"""


def _range(column: str = "hour") -> str:
    return f"{column} BETWEEN strftime(date_trunc('hour', TIMESTAMP '{RANGE[0]}'), '%Y-%m-%dT%H:00:00Z') AND strftime(date_trunc('hour', TIMESTAMP '{RANGE[1]}'), '%Y-%m-%dT%H:00:00Z')"


def _last(hours: int) -> str:
    return f"hour BETWEEN strftime(date_trunc('hour', TIMESTAMP '{PRESET_AS_OF}' - INTERVAL {hours} HOUR), '%Y-%m-%dT%H:00:00Z') AND strftime(date_trunc('hour', TIMESTAMP '{PRESET_AS_OF}'), '%Y-%m-%dT%H:00:00Z')"


def _since(hours: int) -> str:
    return f"hour >= strftime(date_trunc('hour', TIMESTAMP '{WINDOW_AS_OF}' - INTERVAL {hours} HOUR), '%Y-%m-%dT%H:00:00Z')"


def _verdict(rules: str) -> str:
    return f"""SELECT {EVENT}, CASE WHEN bool_or(audit_type = 'MATCHED' AND rule_id IN ({rules})) THEN 'MATCHED'
      WHEN bool_or(audit_type = 'ERRORED' AND rule_id IN ({rules}, '_parse')) THEN 'ERRORED' ELSE 'UNMATCHED' END AS verdict FROM audits GROUP BY ALL"""


FOUR = "'c1', 'c2', 'c3', 'c7'"

RERUN = (
    WITH
    + """, latest AS (
  SELECT audit_id, rule_id, CASE
    WHEN rule_id = 'c1' AND ts >= TIMESTAMP '{since}' THEN CASE WHEN akind = 'text' THEN 'ERRORED' WHEN akind = 'num' AND amount > 50 THEN 'MATCHED' ELSE 'UNMATCHED' END
    ELSE audit_type END AS audit_type
  FROM audits)
"""
)

LATENCY = """coalesce(CAST(trunc(sum(parse_sum) / sum("count")) AS BIGINT), 0) AS avg_parse_time,
  coalesce(CAST(trunc(sum(eval_sum) / sum("count")) AS BIGINT), 0) AS avg_eval_time,
  coalesce(CAST(trunc(sum(total_sum) / sum("count")) AS BIGINT), 0) AS avg_total_time"""
SUMS = "CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(unmatched) AS BIGINT) AS unmatched, CAST(sum(errored) AS BIGINT) AS errored"


def oracles() -> dict[str, str]:
    amount = "CASE WHEN akind = 'num' THEN amount END"
    s_cond = {  # a field of another type than declared reads as null; a null condition does not match
        "s1": f"coalesce(({amount}) > 100, false) OR (has_meta AND source = 'web')",
        "s2": "NOT (type = 'click' OR type = 'view')",
        "s3": f"coalesce(has_meta AND ({amount}) + tax_rate * 100 > 60, false)",
        "s4": "NOT ts_num AND regexp_matches(strftime(ts, '%Y-%m-%d'), '^2024-01-0[1-9]') AND type IN ('purchase', 'signup')",
        "s5": f"coalesce(CASE WHEN has_meta AND priority >= 4 THEN ({amount}) > 50 ELSE ({amount}) > 150 END, false)",
    }
    sql_rules = " UNION ALL ".join(
        [f"SELECT '{k}' AS rule_id, CASE WHEN {c} THEN 'MATCHED' ELSE 'UNMATCHED' END AS audit_type FROM raw WHERE NOT bad" for k, c in s_cond.items()]
        + [f"SELECT '{k}', 'ERRORED' FROM raw WHERE NOT bad" for k in ("s6", "s7", "s9")]
        + ["SELECT '_parse', 'ERRORED' FROM raw WHERE bad"]
    )
    good = "(SELECT count(*) FROM raw WHERE NOT bad)"
    null_rows = " UNION ALL ".join(
        f"""SELECT 'n_{op}' AS rule_id, count(*) FILTER (NOT bad AND {m}) AS "MATCHED", count(*) FILTER (NOT bad AND {u}) AS "UNMATCHED",
        count(*) FILTER (NOT bad AND {e}) AS "ERRORED" FROM ev"""
        for op, m, u, e in [
            *[
                (op, f"(akind = 'num' AND amount {sign} 100)", f"((akind = 'num' AND NOT amount {sign} 100) OR akind = 'null')", "akind = 'text'")
                for op, sign in (("gt", ">"), ("ge", ">="))
            ],
            *[
                (op, f"((akind = 'num' AND amount {sign} 100) OR akind = 'null')", f"(akind = 'num' AND NOT amount {sign} 100)", "akind = 'text'")
                for op, sign in (("lt", "<"), ("le", "<="))
            ],
            ("eq", "(akind = 'num' AND amount = 100)", "NOT (akind = 'num' AND amount = 100)", "false"),
            ("ne", "NOT (akind = 'num' AND amount = 100)", "(akind = 'num' AND amount = 100)", "false"),
            ("not_null", "akind <> 'null'", "akind = 'null'", "false"),
        ]
    ) + """ UNION ALL SELECT '_parse', 0, 0, count(*) FROM ev WHERE bad"""
    sales = _sales()
    return {
        "q_parse_split": f"WITH {EV} x AS (SELECT 1) SELECT {EVENT}, NOT bad AS parsed, CASE WHEN NOT bad THEN type END AS original_type FROM ev",
        "q_parse_quarantine": f"WITH {EV} x AS (SELECT 1) SELECT {EVENT}, val AS value, '{PARSE_REASON}' AS reason FROM raw WHERE bad",
        "q_rule_fanout": f"{WITH} SELECT {EVENT}, rule_id, audit_type FROM audits",
        "q_clause_states": f"{WITH} SELECT rule_id, audit_type, failed_clause_no, count(*) AS audits FROM audits GROUP BY ALL",
        "q_clause_errors": f"{WITH} SELECT rule_id, {ERROR_REASON} AS reason, count(*) AS audits FROM audits WHERE audit_type = 'ERRORED' GROUP BY ALL",
        "q_clause_nulls": f"WITH {EV} x AS (SELECT 1) {null_rows}",
        "q_array_selection": f"""WITH it AS (SELECT l_orderkey, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
          o AS (SELECT *, 'order-events' AS topic, CAST(o_orderkey % 20 AS INTEGER) AS "partition", o_orderkey // 20 AS "offset",
            o_orderkey % 43 = 0 AS gone FROM orders LEFT JOIN it ON l_orderkey = o_orderkey)
          SELECT {EVENT}, rule_id, CASE rule_id
            WHEN 'o1' THEN CASE WHEN NOT gone AND coalesce(hi, 0) > 100000 THEN 'MATCHED' ELSE 'UNMATCHED' END
            WHEN 'o2' THEN CASE WHEN gone THEN 'ERRORED' WHEN coalesce(hi, 0) > 100000 THEN 'MATCHED' ELSE 'UNMATCHED' END
            ELSE CASE WHEN o_orderkey % 3 = 0 AND CAST(left(o_orderpriority, 1) AS INTEGER) <= 2 THEN 'MATCHED' ELSE 'UNMATCHED' END END AS audit_type
          FROM o CROSS JOIN (VALUES ('o1'), ('o2'), ('o3')) AS r(rule_id)""",
        "q_rule_short_circuit": f"""WITH {EV} st AS (
            SELECT 'a_first' AS rule_id, CASE WHEN type <> 'click' THEN 'U1' WHEN NOT has_meta THEN 'E2' WHEN priority >= 3 THEN 'M' ELSE 'U2' END AS st FROM ev WHERE NOT bad
            UNION ALL SELECT 'b_first', CASE WHEN NOT has_meta THEN 'E1' WHEN priority < 3 THEN 'U1' WHEN type = 'click' THEN 'M' ELSE 'U2' END FROM ev WHERE NOT bad
            UNION ALL SELECT '_parse', 'E' FROM ev WHERE bad)
          SELECT rule_id, CASE left(st, 1) WHEN 'M' THEN 'MATCHED' WHEN 'U' THEN 'UNMATCHED' ELSE 'ERRORED' END AS audit_type,
            CASE WHEN length(st) = 2 THEN CAST(right(st, 1) AS INTEGER) END AS failed_clause_no, count(*) AS audits FROM st GROUP BY ALL""",
        "q_sql_rules": f"WITH {EV} st AS ({sql_rules}) SELECT rule_id, audit_type, count(*) AS audits FROM st GROUP BY ALL",
        "q_rule_guard": f"""WITH {EV} x AS (SELECT 1) SELECT rule_id, verdict, CASE WHEN verdict = 'unparseable' THEN 0 ELSE {good} END AS audits,
          CASE WHEN verdict IN ('refused', 'not_boolean', 'bad_clause') THEN {good} ELSE 0 END AS errors FROM (VALUES
          ('s1', 'accepted'), ('s2', 'accepted'), ('s3', 'accepted'), ('s4', 'accepted'), ('s5', 'accepted'), ('s6', 'refused'),
          ('s7', 'not_boolean'), ('s8', 'unparseable'), ('s9', 'refused'), ('t1', 'accepted'), ('t2', 'refused'), ('t3', 'refused'),
          ('t4', 'refused'), ('t5', 'refused'), ('t6', 'accepted'), ('u1', 'bad_clause'), ('u2', 'bad_clause'), ('u3', 'bad_clause'),
          ('u4', 'bad_clause'), ('u5', 'bad_clause')) AS v(rule_id, verdict)""",
        "q_plans_agree": f"""{WITH}, named AS (SELECT CASE rule_id WHEN 'c3' THEN '' WHEN 'c5' THEN '' ELSE rule_id END AS rule_id, audit_type, failed_clause_no FROM audits),
          bad AS (SELECT rule_id, 'ERRORED' AS audit_type, 1 AS failed_clause_no FROM raw, (VALUES ('u1'), ('u2'), ('u3'), ('u4'), ('u5')) AS u(rule_id) WHERE NOT bad),
          counted AS (SELECT rule_id, audit_type, failed_clause_no, count(*) AS audits FROM (SELECT * FROM named UNION ALL SELECT * FROM bad) GROUP BY ALL)
          SELECT counted.*, plan FROM counted CROSS JOIN (VALUES ('few'), ('many')) AS p(plan)""",
        "q_conditions_in_portions": f"""WITH {EV} st AS ({sql_rules}) SELECT CASE WHEN rule_id IN ('s1', 's2') THEN '' ELSE rule_id END AS rule_id, audit_type, count(*) AS audits
          FROM st GROUP BY ALL""",
        "q_event_no_results": f"""WITH {EV} x AS (SELECT 1) SELECT {EVENT}, CASE WHEN bad THEN 'ERRORED' ELSE 'UNMATCHED' END AS verdict FROM raw""",
        "q_unmatched_reason": f"{WITH} SELECT {EVENT}, rule_id, {REASON} AS reason FROM audits WHERE audit_type <> 'ERRORED'",
        "q_event_verdict": f"{WITH} {_verdict(FOUR)}",
        "q_event_summary": f"""{WITH} SELECT {EVENT},
          coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (audit_type = 'MATCHED'), '') AS matched_rules,
          coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (rule_id <> '_parse'), '') AS evaluated_rules,
          coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (audit_type = 'ERRORED'), '') AS errored_rules FROM audits GROUP BY ALL""",
        "q_no_rules": f"""{WITH} SELECT DISTINCT event_hash AS audit_id, CASE WHEN bad THEN '_parse' ELSE '_none' END AS rule_id,
          CASE WHEN bad THEN 'ERRORED' ELSE 'UNMATCHED' END AS audit_type, CASE WHEN bad THEN '{PARSE_REASON}' ELSE '{NO_RULES_REASON}' END AS reason FROM audits""",
        "q_rule_seed": f"""{sales} SELECT rule_id, count(*) FILTER (failed = 0) AS matched, count(*) FILTER (failed > 0) AS unmatched, 0::BIGINT AS errored FROM judged GROUP BY 1""",
        "q_rule_packs": f"""{sales} SELECT rule_id, CASE WHEN failed = 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS audit_type,
          CASE WHEN failed > 0 THEN failed END AS failed_clause_no, count(*) AS audits FROM judged GROUP BY ALL""",
        "q_rule_portions": f"""{sales} SELECT rule_id, CASE WHEN failed = 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS audit_type,
          CASE WHEN failed > 0 THEN failed END AS failed_clause_no, count(*) AS audits FROM judged GROUP BY ALL""",
        "q_match_shared_ids": f"""{sales}, ranked AS (SELECT rule_id, lag(rule_id) OVER (ORDER BY rule_id) AS before, row_number() OVER (ORDER BY rule_id) AS k FROM rules),
          named AS (SELECT j.rule_id AS judged_id, j.rule_id FROM ranked j UNION ALL SELECT rule_id, before FROM ranked WHERE (k - 2) % 3 = 0 AND before IS NOT NULL)
          SELECT n.rule_id, count(*) AS matches, plan FROM judged j JOIN named n ON n.judged_id = j.rule_id CROSS JOIN (VALUES ('join'), ('evaluation')) AS p(plan)
          WHERE failed = 0 GROUP BY ALL""",
        "q_match_only_ranges": f"""WITH {EV.strip().removesuffix(',')}, rules AS (SELECT CAST(k AS INTEGER) AS k FROM range(82) AS t(k)),
          met AS (SELECT 'r' || (k - CASE WHEN k < 80 AND k % 8 = 7 THEN 1 ELSE 0 END) AS rule_id, "offset" FROM ev, rules WHERE NOT bad AND CASE
            WHEN k = 80 THEN false WHEN k = 81 THEN true
            WHEN k % 4 = 0 THEN akind = 'num' AND amount >= 5 * k AND amount < 5 * k + 40
            WHEN k % 4 = 1 THEN akind = 'null' OR (akind = 'num' AND amount < 5 * k)
            WHEN k % 4 = 2 THEN has_meta AND priority = k % 5 + 1 AND akind = 'num' AND amount > 3 * k
            ELSE has_meta AND round(tax_rate * 100) BETWEEN k % 20 AND k % 20 + 3 END)
          SELECT rule_id, count(*) AS matches, CAST(sum("offset") AS BIGINT) AS offsets, plan FROM met CROSS JOIN (VALUES ('join'), ('evaluation')) AS p(plan) GROUP BY ALL""",
        "q_match_only_join": f"{sales} SELECT {EVENT}, rule_id FROM judged WHERE failed = 0",
        "q_audit_ids": f"{WITH} SELECT audit_id, event_hash AS event_id, rule_id FROM audits",
        "q_routed_events": f"""{WITH} SELECT event_hash AS event_id, rule_id, '{ROUTED_MESSAGE}' AS message, type || '_' || rule_id AS type,
          CAST(user_id AS VARCHAR) AS user_id, CASE WHEN has_meta THEN source END AS source FROM audits WHERE audit_type = 'MATCHED'""",
        "q_audit_json": f"""{WITH} SELECT audit_id, rule_id, audit_type, {INSTANT} AS instant, 1 AS schema_version,
          parse_nano + eval_nano AS total_time_nano, true AS has_null_routed FROM audits""",
        "q_events_any_match": f"{WITH} SELECT DISTINCT {EVENT} FROM audits WHERE audit_type = 'MATCHED' AND rule_id IN ('c1', 'c2')",
        "q_events_no_match": f"""{WITH} SELECT {EVENT} FROM ev e WHERE NOT EXISTS (SELECT 1 FROM audits a
          WHERE a.event_id = e.event_id AND a.audit_type = 'MATCHED' AND a.rule_id IN ('c1', 'c2'))""",
        "q_audit_with_rule": f"""{WITH} SELECT a.rule_id, d.description, audit_type, count(*) AS audits FROM audits a LEFT JOIN (VALUES
          ('c1', 'Amount over 100'), ('c2', 'Web purchase'), ('c3', 'Low priority'), ('c4', 'Dated 2024'), ('c5', 'Taxed amount'),
          ('c6', 'Everything'), ('c7', 'Unknown method'), ('c9', 'Flagged')) AS d(rule_id, description) ON a.rule_id = d.rule_id GROUP BY ALL""",
        "q_type_tally": f"{WITH} SELECT audit_type, count(*) AS audits FROM audits GROUP BY ALL",
        "q_audit_sample": f"{WITH} SELECT audit_type, left(audit_id, 8) AS short_id, rule_id, val AS source_event FROM audits ORDER BY ts, audit_id LIMIT 5",
        "q_audit_full": f"""{WITH}, again AS (SELECT * REPLACE (
            CASE WHEN newer THEN CASE WHEN akind = 'text' THEN 'ERRORED' WHEN akind = 'num' AND amount > 50 THEN 'MATCHED' ELSE 'UNMATCHED' END ELSE audit_type END AS audit_type,
            CASE WHEN newer THEN '[''amount''] > 50' ELSE CASE rule_id WHEN 'c4' THEN '[''timestamp''] != null and [''timestamp''].startsWith(''2024'')' ELSE expr END END AS expr)
          FROM (SELECT *, rule_id = 'c1' AND ts >= TIMESTAMP '2024-01-15' AS newer FROM audits))
          SELECT audit_id, audit_type, CASE WHEN rule_id = 'c4' AND audit_type <> 'MATCHED' THEN NULL ELSE {REASON} END AS reason, val AS source_event,
            CASE WHEN audit_type = 'MATCHED' THEN type || '_' || rule_id END AS routed_type FROM again WHERE audit_type <> 'ERRORED'""",
        "q_rule_current": f"{CHANGES} SELECT rule_id, expression, active, seq FROM cur",
        "q_rule_slug": f"{CHANGES} SELECT seq, rule_id FROM named",
        "q_rule_active": f"{CHANGES} SELECT rule_id, description, expression FROM cur WHERE active",
        "q_rule_lookup": f"{CHANGES} SELECT rule_id, description, active FROM cur WHERE rule_id = (SELECT min(rule_id) FROM cur)",
        "q_rule_search": f"""{CHANGES} SELECT rule_id, description FROM cur WHERE active
          AND (contains(lower(description), 'urgent watch') OR contains(lower(expression), 'urgent watch'))""",
        "q_rule_counts": f"{CHANGES} SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive FROM cur",
        "q_rule_refresh": CHANGES
        + " UNION ALL ".join(
            f"""SELECT {i}::INTEGER AS batch, rule_id, expression, active FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY updated_at DESC, seq DESC) AS rn
          FROM named WHERE updated_at <= TIMESTAMP '{m}') WHERE rn = 1 AND op <> 'delete'"""
            for i, m in enumerate(("1995-06-30", "1997-06-30"))
        ),
        "q_audit_latest": RERUN.replace('{since}', "2024-01-15 00:00:00") + "SELECT * FROM latest",
        **dict.fromkeys(
            ("q_audit_overlap", "q_audit_compacted_twice", "q_audit_clustered", "q_rerun_after_compaction", "q_store_commit"), RERUN.replace("{since}", "2024-01-15 00:00:00") + "SELECT * FROM latest"
        ),
        "q_poison_batch": f"""{WITH} SELECT rule_id, audit_type, count(*) AS audits FROM audits WHERE event_id <> 500 AND rule_id IN ('c1', 'c6', '_parse') GROUP BY ALL
          UNION ALL SELECT "partition" || '-' || "offset", 'SET ASIDE', count(*) FROM raw WHERE event_id = 500 GROUP BY ALL""",
        "q_audit_repeats": f"{WITH} SELECT audit_id, rule_id, audit_type FROM audits",
        **dict.fromkeys(
            ("q_rollup_replayed", "q_rollup_replayed_compacted"),
            RERUN.replace("{since}", "2024-01-15 00:00:00").replace("SELECT audit_id, rule_id, CASE", "SELECT ts, audit_id, rule_id, CASE")
            + f"""SELECT {HOUR} AS hour, rule_id, count(*) FILTER (audit_type = 'MATCHED') AS matched, count(*) FILTER (audit_type = 'UNMATCHED') AS unmatched,
              count(*) FILTER (audit_type = 'ERRORED') AS errored, count(*) AS "count" FROM latest GROUP BY 1, 2""",
        ),
        "q_store_top": RERUN.replace("{since}", "2024-01-15 00:00:00").replace("SELECT audit_id, rule_id, CASE", "SELECT ts, audit_id, rule_id, CASE")
        + f"""SELECT audit_id, rule_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM latest WHERE audit_type = 'MATCHED'
          AND ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}' ORDER BY ts DESC, audit_id LIMIT 10""",
        "q_load_errors_stored": f"""WITH {EV} x AS (SELECT 1) SELECT rule_id, verdict, CASE WHEN verdict = 'unparseable' THEN 0 ELSE {good} END AS errors FROM (VALUES
          ('s6', 'refused'), ('s7', 'not_boolean'), ('s8', 'unparseable'), ('s9', 'refused'), ('t2', 'refused'), ('t3', 'refused'), ('t4', 'refused'),
          ('t5', 'refused'), ('u1', 'bad_clause'), ('u2', 'bad_clause'), ('u3', 'bad_clause'), ('u4', 'bad_clause'), ('u5', 'bad_clause')) AS v(rule_id, verdict)""",
        "q_audit_replay": RERUN.replace('{since}', "2024-01-15 00:00:00") + "SELECT rule_id, audit_type, count(*) AS audits FROM latest GROUP BY ALL",
        "q_audit_versions": RERUN.replace('{since}', "1970-01-01") + "SELECT rule_id, audit_type, count(*) AS audits FROM latest GROUP BY ALL",
        "q_audit_poison": f"""{WITH} SELECT CASE WHEN "offset" % 53 = 0 THEN 'unreadable' ELSE audit_type END AS audit_type, count(*) AS messages FROM audits GROUP BY 1""",
        "q_rule_rollup": f"{ROLL} SELECT * FROM rr",
        "q_hour_rollup": f"{ROLL} SELECT * FROM hr",
        "q_messages_of_range": f"""{WITH}, met AS (SELECT 'store' AS name, event_hash, ts FROM audits UNION ALL SELECT 'again', event_hash, ts FROM audits
            UNION ALL SELECT 'again', event_hash, ts + INTERVAL 1 HOUR FROM audits WHERE "offset" % 5 = 0)
          SELECT name, count(DISTINCT event_hash) AS exact, true AS within FROM met
          WHERE date_trunc('hour', ts) BETWEEN date_trunc('hour', TIMESTAMP '{RANGE[0]}') AND date_trunc('hour', TIMESTAMP '{RANGE[1]}') GROUP BY name""",
        "q_rollup_window": f"{ROLL} SELECT * FROM rr WHERE {_since(3)}",
        "q_rollup_backfill": f"{ROLL} SELECT * FROM hr WHERE {_since(26)}",
        "q_rollup_merge": f"{ROLL} SELECT * FROM rr",
        "q_rollup_store": f"{ROLL} SELECT * FROM hr",
        "q_rollup_store_rules": RERUN.replace("{since}", "2024-01-15 00:00:00").replace("SELECT audit_id, rule_id, CASE", "SELECT ts, audit_id, rule_id, CASE")
        + f"""SELECT {HOUR} AS hour, rule_id, count(*) FILTER (audit_type = 'MATCHED') AS matched, count(*) FILTER (audit_type = 'UNMATCHED') AS unmatched,
          count(*) FILTER (audit_type = 'ERRORED') AS errored, count(*) AS "count" FROM latest GROUP BY 1, 2""",
        "q_rollup_late": f"{ROLL} SELECT * FROM rr",
        "q_audit_compacted": RERUN.replace("{since}", "2024-01-15 00:00:00") + "SELECT * FROM latest",
        "q_store_two_streams": f"{WITH} SELECT audit_id, rule_id, audit_type FROM audits",
        "q_stream_topics": f"""{WITH} SELECT 'audits' AS topic, event_hash AS key, audit_id AS name FROM audits
          UNION ALL SELECT 'routed_events', event_hash, type || '_' || rule_id FROM audits WHERE audit_type = 'MATCHED'""",
        "q_store_reports": f"""{ROLL} SELECT * FROM (SELECT audit_id AS name, 1::BIGINT AS value FROM audits WHERE audit_type = 'MATCHED'
            AND ts BETWEEN TIMESTAMP '{PRESET_AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{PRESET_AS_OF}' ORDER BY ts DESC, audit_id LIMIT 10)
          UNION ALL SELECT 'messages', CAST(coalesce(sum(messages), 0) AS BIGINT) FROM hr WHERE {_last(24)}
          UNION ALL SELECT 'evaluations', CAST(coalesce(sum("count"), 0) AS BIGINT) FROM rr WHERE {_last(24)}""",
        "q_store_new_checkpoint": f"{WITH} SELECT audit_id, rule_id, audit_type FROM audits",
        "q_rule_stats": f"{ROLL} SELECT rule_id, {SUMS}, rule_id IN ('_parse', '_none') AS is_pseudo FROM rr WHERE {_range()} GROUP BY rule_id",
        "q_time_series": f'{ROLL} SELECT hour AS "timestamp", rule_id, matched, unmatched, errored FROM rr WHERE {_range()}',
        "q_totals": f"""{ROLL} SELECT (SELECT CAST(coalesce(sum(messages), 0) AS BIGINT) FROM hr WHERE {_range()}) AS total_messages,
          (SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) FROM rr WHERE {_range()}) AS total_evaluations""",
        "q_latency": f"{ROLL} SELECT {LATENCY} FROM rr WHERE {_range()}",
        "q_dashboard": f"""{ROLL} SELECT (SELECT CAST(coalesce(sum(messages), 0) AS BIGINT) FROM hr WHERE {_last(24)}) AS total_messages,
          CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_evaluations, {LATENCY} FROM rr WHERE {_last(24)}""",
        "q_range_presets": ROLL
        + " UNION ALL ".join(f'SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_evaluations, {h} AS hours FROM rr WHERE {_last(h)}' for h in (1, 6, 24)),
        "q_series_all": f'{ROLL} SELECT hour AS "timestamp", {SUMS} FROM rr GROUP BY 1',
        "q_series_one": f"""{ROLL} SELECT hour AS "timestamp", rule_id, matched, unmatched, errored FROM rr WHERE rule_id = 'c3'""",
        "q_match_rate": f"""{ROLL} SELECT rule_id, CAST(sum(matched + unmatched) AS BIGINT) AS total, CAST(sum("count") AS BIGINT) AS evaluations,
          round(CAST(sum(matched) * 100 AS DOUBLE) / sum("count"), 1) AS match_rate FROM rr GROUP BY 1""",
        "q_cards": f"{ROLL} SELECT CAST(sum(matched) AS BIGINT) AS total_matched, CAST(sum(errored) AS BIGINT) AS total_errored FROM rr",
        "q_peak": f"""{ROLL}, s AS (SELECT hour, {SUMS} FROM rr GROUP BY 1) SELECT greatest(max(matched), max(unmatched), max(errored), 1) AS peak FROM s""",
        "q_top10": f"""{WITH} SELECT audit_id, rule_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM audits WHERE audit_type = 'MATCHED'
          AND ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}' ORDER BY ts DESC, audit_id LIMIT 10""",
        "q_export_csv": f"""{WITH} SELECT '{CSV_HEADER}' AS line UNION ALL SELECT audit_id || ',' || rule_id || ',' || audit_type || ',' || {INSTANT} || ',"' ||
          {ERROR_REASON} || '",' || topic || ',' || "partition" || ',' || "offset" || ',' || parse_nano || ',' || eval_nano || ',' || (parse_nano + eval_nano)
          || ',"' || replace(val, '"', '""') || '",""' FROM audits WHERE audit_type = 'ERRORED' AND ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'""",
        "q_rule_sorted": f"{ROLL} SELECT rule_id, CAST(sum(matched + unmatched) AS BIGINT) AS total FROM rr GROUP BY 1",
        "q_rule_page": f"""{sales}, st AS (SELECT rule_id, count(*) FILTER (failed = 0) AS matched, count(*) FILTER (failed > 0) AS unmatched FROM judged GROUP BY 1)
          SELECT rule_id, matched, unmatched, CAST(10 AS INTEGER) AS page, CAST(10 AS INTEGER) AS pages FROM st ORDER BY unmatched DESC, rule_id LIMIT 10 OFFSET 90""",
        "q_stream_audits": f"""{WITH} SELECT audit_id, rule_id, audit_type,
          CASE WHEN rule_id IN ('c1', 'c2', 'c3', 'c5', 'c6', 'c9') AND audit_type <> 'ERRORED' THEN {REASON} END AS reason, val AS source_event,
          CAST(parse_nano + eval_nano AS BIGINT) AS total_time_nano FROM audits""",
        "q_stream_routed": f"""{WITH} SELECT event_hash AS event_id, rule_id, type || '_' || rule_id AS text FROM audits WHERE audit_type = 'MATCHED'
          UNION ALL SELECT NULL, 'quarantine', val FROM raw WHERE bad""",
        "q_audit_messages": f"""{WITH} SELECT CASE WHEN "offset" % 53 = 0 THEN 'unreadable' ELSE audit_type END AS audit_type, count(*) AS messages FROM audits GROUP BY 1""",
        "q_stream_rollup": f"{ROLL} SELECT * FROM rr",
        "q_stream_dedup": f"{WITH} SELECT audit_id, rule_id FROM audits",
    }
