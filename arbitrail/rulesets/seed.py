"""The default rules, loaded into an empty rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.rules import rule_frame, with_rule_id

# Description | amount above | region | source | priority at most | tier | last condition.
SEED_RULES = """
Security alert for session access from US (Rule 1) | 43618 | US | web | 5 | standard | item_price 678
System transfer verification for APAC channel (Rule 2) | 38620 | APAC | mobile | 4 | gold | tax_rate 0.16
System customer verification for LATAM channel (Rule 3) | 18508 | LATAM | partner | 5 | premium | timestamp 202
System account verification for EU channel (Rule 4) | 40598 | EU | mobile | 4 | premium | timestamp 202
System account verification for EMEA channel (Rule 5) | 6780 | EMEA | partner | 2 | gold | timestamp 202
High value transfer US audit (Rule 6) | 44670 | US | legacy | 5 | basic | timestamp 202
Transaction monitor: transfer type for LATAM tier (Rule 7) | 14640 | LATAM | partner | 5 | gold | item_price 667
Transaction monitor: payment type for EMEA tier (Rule 8) | 3654 | EMEA | api | 3 | basic | tax_rate 0.09
System customer verification for APAC channel (Rule 9) | 29568 | APAC | web | 1 | premium | timestamp 202
Compliance check for payment in EMEA region (Rule 10) | 25127 | EMEA | legacy | 1 | premium | tax_rate 0.13
Compliance check for transfer in APAC region (Rule 11) | 44816 | APAC | mobile | 1 | basic | item_price 678
Compliance check for user in LATAM region (Rule 12) | 25595 | LATAM | partner | 1 | standard | item_price 272
Transaction monitor: session type for US tier (Rule 13) | 22973 | US | web | 2 | premium | item_price 142
System user verification for EMEA channel (Rule 14) | 24146 | EMEA | api | 1 | basic | timestamp 202
Security alert for user access from EMEA (Rule 15) | 5042 | EMEA | api | 3 | gold | tax_rate 0.15
Compliance check for account in EMEA region (Rule 16) | 7122 | EMEA | partner | 5 | basic | timestamp 202
High value invoice EU audit (Rule 17) | 42965 | EU | partner | 4 | premium | tax_rate 0.06
System order verification for EMEA channel (Rule 18) | 1493 | EMEA | legacy | 3 | standard | item_price 397
Security alert for customer access from US (Rule 19) | 9245 | US | legacy | 2 | standard | timestamp 202
Transaction monitor: account type for EMEA tier (Rule 20) | 37249 | EMEA | api | 3 | vip | timestamp 202
Security alert for customer access from US (Rule 21) | 28554 | US | mobile | 1 | vip | tax_rate 0.2
High value order APAC audit (Rule 22) | 2700 | APAC | api | 1 | premium | tax_rate 0.2
Transaction monitor: payment type for LATAM tier (Rule 23) | 49054 | LATAM | api | 4 | standard | item_price 841
High value order EMEA audit (Rule 24) | 29519 | EMEA | api | 2 | standard | timestamp 202
Transaction monitor: payment type for LATAM tier (Rule 25) | 3708 | LATAM | mobile | 1 | gold | timestamp 202
High value payment LATAM audit (Rule 26) | 37310 | LATAM | api | 3 | vip | timestamp 202
High value user US audit (Rule 27) | 23378 | US | api | 1 | basic | item_price 107
System transfer verification for APAC channel (Rule 28) | 19673 | APAC | legacy | 2 | basic | tax_rate 0.18
Security alert for customer access from APAC (Rule 29) | 44216 | APAC | mobile | 4 | gold | tax_rate 0.18
High value order APAC audit (Rule 30) | 12488 | APAC | api | 3 | vip | tax_rate 0.14
System transfer verification for APAC channel (Rule 31) | 7030 | APAC | legacy | 4 | basic | item_price 503
High value session EMEA audit (Rule 32) | 5235 | EMEA | partner | 1 | vip | timestamp 202
High value account EU audit (Rule 33) | 38545 | EU | web | 4 | basic | item_price 792
High value account US audit (Rule 34) | 49224 | US | api | 4 | vip | tax_rate 0.05
High value transfer LATAM audit (Rule 35) | 17308 | LATAM | api | 5 | basic | tax_rate 0.17
Compliance check for invoice in APAC region (Rule 36) | 26323 | APAC | partner | 3 | basic | tax_rate 0.12
Compliance check for transfer in EU region (Rule 37) | 40339 | EU | web | 4 | premium | tax_rate 0.21
System customer verification for EMEA channel (Rule 38) | 45405 | EMEA | partner | 2 | basic | item_price 294
Security alert for order access from APAC (Rule 39) | 44066 | APAC | legacy | 3 | vip | tax_rate 0.13
Compliance check for session in EMEA region (Rule 40) | 17344 | EMEA | web | 1 | premium | item_price 196
High value order US audit (Rule 41) | 48911 | US | web | 3 | basic | timestamp 202
Compliance check for transfer in US region (Rule 42) | 44641 | US | api | 1 | gold | timestamp 202
Security alert for transfer access from EMEA (Rule 43) | 29072 | EMEA | web | 2 | vip | timestamp 202
Compliance check for payment in EU region (Rule 44) | 39850 | EU | partner | 3 | basic | timestamp 202
High value account LATAM audit (Rule 45) | 41981 | LATAM | legacy | 4 | standard | timestamp 202
High value order EU audit (Rule 46) | 31393 | EU | mobile | 4 | gold | item_price 202
High value order APAC audit (Rule 47) | 14312 | APAC | api | 2 | premium | tax_rate 0.21
Security alert for session access from APAC (Rule 48) | 47538 | APAC | partner | 4 | gold | item_price 237
Security alert for user access from US (Rule 49) | 32599 | US | mobile | 5 | basic | tax_rate 0.24
High value session US audit (Rule 50) | 4100 | US | web | 3 | gold | timestamp 202
Compliance check for order in US region (Rule 51) | 6677 | US | web | 2 | vip | tax_rate 0.08
High value payment LATAM audit (Rule 52) | 21693 | LATAM | api | 2 | premium | tax_rate 0.16
High value invoice APAC audit (Rule 53) | 11577 | APAC | legacy | 2 | gold | item_price 161
Compliance check for payment in EU region (Rule 54) | 2460 | EU | api | 3 | premium | tax_rate 0.16
Security alert for payment access from US (Rule 55) | 35263 | US | legacy | 2 | vip | tax_rate 0.11
Compliance check for user in EMEA region (Rule 56) | 25176 | EMEA | mobile | 2 | premium | tax_rate 0.16
High value invoice EU audit (Rule 57) | 20854 | EU | api | 2 | standard | item_price 105
High value transfer LATAM audit (Rule 58) | 3102 | LATAM | partner | 3 | standard | timestamp 202
Transaction monitor: payment type for US tier (Rule 59) | 36552 | US | web | 5 | gold | item_price 487
High value user LATAM audit (Rule 60) | 1325 | LATAM | legacy | 3 | premium | timestamp 202
Security alert for customer access from LATAM (Rule 61) | 27274 | LATAM | web | 1 | vip | tax_rate 0.1
Transaction monitor: customer type for US tier (Rule 62) | 4137 | US | legacy | 3 | standard | timestamp 202
High value transfer LATAM audit (Rule 63) | 11653 | LATAM | mobile | 2 | gold | tax_rate 0.11
High value transfer APAC audit (Rule 64) | 4896 | APAC | legacy | 1 | basic | item_price 732
System transfer verification for LATAM channel (Rule 65) | 20673 | LATAM | api | 4 | standard | timestamp 202
System invoice verification for EU channel (Rule 66) | 32202 | EU | legacy | 5 | gold | item_price 319
Security alert for payment access from LATAM (Rule 67) | 30701 | LATAM | partner | 2 | gold | item_price 803
High value order APAC audit (Rule 68) | 42285 | APAC | api | 5 | standard | item_price 926
Security alert for user access from EU (Rule 69) | 9722 | EU | api | 3 | basic | item_price 539
System session verification for US channel (Rule 70) | 14752 | US | legacy | 2 | premium | tax_rate 0.2
Compliance check for session in US region (Rule 71) | 44965 | US | web | 5 | basic | tax_rate 0.21
Transaction monitor: payment type for US tier (Rule 72) | 6479 | US | partner | 1 | vip | timestamp 202
Transaction monitor: user type for US tier (Rule 73) | 7110 | US | api | 1 | standard | item_price 550
High value order US audit (Rule 74) | 8370 | US | mobile | 3 | standard | tax_rate 0.11
Transaction monitor: invoice type for EMEA tier (Rule 75) | 24126 | EMEA | api | 5 | gold | tax_rate 0.15
High value session EU audit (Rule 76) | 15196 | EU | legacy | 4 | vip | item_price 663
System order verification for LATAM channel (Rule 77) | 15773 | LATAM | api | 3 | premium | item_price 966
Security alert for customer access from APAC (Rule 78) | 5016 | APAC | legacy | 2 | vip | timestamp 202
High value transfer EMEA audit (Rule 79) | 23576 | EMEA | legacy | 1 | basic | tax_rate 0.09
Compliance check for payment in EU region (Rule 80) | 46750 | EU | api | 4 | gold | item_price 306
High value invoice EU audit (Rule 81) | 13460 | EU | legacy | 1 | vip | tax_rate 0.19
Security alert for account access from APAC (Rule 82) | 15495 | APAC | legacy | 3 | standard | tax_rate 0.15
Compliance check for customer in EMEA region (Rule 83) | 22690 | EMEA | partner | 5 | vip | timestamp 202
Security alert for user access from US (Rule 84) | 16665 | US | mobile | 3 | gold | tax_rate 0.18
Security alert for user access from APAC (Rule 85) | 30136 | APAC | web | 4 | vip | timestamp 202
Security alert for customer access from APAC (Rule 86) | 23633 | APAC | api | 4 | gold | timestamp 202
System transfer verification for LATAM channel (Rule 87) | 7864 | LATAM | legacy | 5 | basic | tax_rate 0.12
Security alert for customer access from APAC (Rule 88) | 4036 | APAC | web | 2 | standard | tax_rate 0.19
Security alert for customer access from EMEA (Rule 89) | 46075 | EMEA | web | 2 | standard | item_price 775
Security alert for invoice access from US (Rule 90) | 3201 | US | web | 1 | gold | item_price 501
High value invoice APAC audit (Rule 91) | 14486 | APAC | mobile | 2 | basic | tax_rate 0.09
System order verification for LATAM channel (Rule 92) | 18308 | LATAM | mobile | 5 | premium | timestamp 202
High value account LATAM audit (Rule 93) | 9950 | LATAM | mobile | 5 | gold | timestamp 202
High value order APAC audit (Rule 94) | 35316 | APAC | mobile | 3 | gold | timestamp 202
System user verification for EU channel (Rule 95) | 47395 | EU | mobile | 1 | basic | timestamp 202
Security alert for customer access from EU (Rule 96) | 7246 | EU | legacy | 3 | basic | timestamp 202
High value session LATAM audit (Rule 97) | 13679 | LATAM | web | 5 | standard | tax_rate 0.13
System invoice verification for US channel (Rule 98) | 5323 | US | partner | 5 | premium | item_price 862
High value session EMEA audit (Rule 99) | 24530 | EMEA | mobile | 4 | gold | tax_rate 0.18
System customer verification for EMEA channel (Rule 100) | 5234 | EMEA | web | 4 | gold | timestamp 202
"""


def _last_condition(text: str) -> list[dict]:
    kind, value = text.split()
    if kind == "tax_rate":
        return [clause("ge", "metadata.tax_rate", float(value))]
    if kind == "item_price":
        return [clause("not_null", "order"), clause("any_gt", "order.items", int(value), item="price")]
    return [clause("not_null", "timestamp"), clause("starts_with", "timestamp", value)]


def seed_rows() -> list[dict]:
    rows = []
    for line in SEED_RULES.strip().splitlines():
        description, amount, region, source, priority, tier, last = [p.strip() for p in line.split("|")]
        conditions = [
            clause("gt", "amount", int(amount)),
            clause("eq", "region", region),
            clause("eq", "metadata.source", source),
            clause("le", "metadata.priority", int(priority)),
            clause("eq", "tier", tier),
            *_last_condition(last),
        ]
        rows.append(rule(None, description, conditions))
    return rows


def seed_rules(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    return with_rule_id(rule_frame(spark, seed_rows()).withColumn("seq", F.lit(0))).drop("seq")
