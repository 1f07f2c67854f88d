"""Event, rule and audit frames derived from the given tables.

``click_events`` turns the ``events`` table into JSON events with every kind of defect;
``order_events`` and ``sales_events`` turn orders with their line items into nested ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitrail.operators.clauses import clause, rule
from arbitrail.operators.parse import spread
from arbitrail.operators.rules import rule_frame
from arbitrail.session import prepare

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- click events --------------------------------------------------------------------------------


def click_value() -> F.Column:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.element_at(F.array(*[F.lit(x) for x in ("web", "mobile", "api", "legacy", "partner")]), (F.col("user_id") % 5 + 1).cast("int"))
    amount = (
        F.when(e % 29 == 0, F.lit('"amount":"not-a-number",'))
        .when(e % 31 == 0, F.lit(""))
        .otherwise(F.concat(F.lit('"amount":'), F.col("value").cast("string"), F.lit(",")))
    )
    metadata = F.when(e % 37 == 0, F.lit("")).otherwise(
        F.concat(
            F.lit('"metadata":{"source":"'), source,
            F.lit('","priority":'), (k % 5 + 1).cast("string"),
            F.lit(',"tax_rate":'), ((k % 20) / 100).cast("string"), F.lit("},"),
        )
    )
    stamp = F.when(e % 41 == 0, F.unix_timestamp("ts").cast("string")).otherwise(
        F.concat(F.lit('"'), F.date_format("ts", ISO), F.lit('"'))
    )
    good = F.concat(
        F.lit('{"type":"'), F.col("event_type"), F.lit('",'), amount,
        F.lit('"user_id":'), F.col("user_id").cast("string"), F.lit(","),
        metadata, F.lit('"timestamp":'), stamp, F.lit("}"),
    )
    return (
        F.when(e % 97 == 0, F.lit("{bad json"))
        .when(e % 101 == 0, F.lit("[1,2,3]"))
        .when(e % 103 == 0, F.lit("null"))
        .otherwise(good)
    )


def click_columns(events: DataFrame) -> DataFrame:
    """Raw event rows with the latencies a producer would have measured."""
    e = F.col("event_id")
    bad = (e % 97 == 0) | (e % 101 == 0) | (e % 103 == 0)
    parse, evaluation = F.when(bad, 0).otherwise((e * 37) % 1000), F.when(bad, 0).otherwise((e * 53) % 5000)
    return events.select(
        F.lit("source-events").alias("topic"),
        (e % 20).cast("int").alias("partition"),
        F.expr("event_id div 20").alias("offset"),
        F.col("ts").cast("timestamp").alias("ts"),
        click_value().alias("value"),
        parse.cast("bigint").alias("parse_time_nano"),
        evaluation.cast("bigint").alias("eval_time_nano"),
        (parse + evaluation).cast("bigint").alias("total_time_nano"),
    )


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(click_columns(table(spark, sf_dir, "events")))


def click_rules(spark: SparkSession) -> DataFrame:
    return rule_frame(
        spark,
        [
            rule("c1", "Amount over 100", [clause("gt", "amount", 100)]),
            rule("c2", "Web purchase", [clause("eq", "type", "purchase"), clause("eq", "metadata.source", "web")]),
            rule("c3", "Low priority", [clause("le", "metadata.priority", 2)]),
            rule("c4", "Dated 2024", [clause("not_null", "timestamp"), clause("starts_with", "timestamp", "2024")]),
            rule("c5", "Taxed amount", [clause("gt", "amount", 100), clause("ge", "metadata.tax_rate", 0.10)]),
            rule("c6", "Everything", []),
            rule("c7", "Unknown method", [clause("looksOdd", "amount")]),
            rule("c8", "Switched off", [clause("gt", "amount", 0)], active=False),
            rule("c9", "Flagged", [clause("eq", "flagged", True)]),
        ],
    )


# Conditions in SQL over a declared schema, with those the guard turns away.
CLICK_SCHEMA = (
    "type string, amount double, user_id bigint, timestamp string, "
    "metadata struct<source:string,priority:int,tax_rate:double>"
)


def click_conditions(spark: SparkSession) -> DataFrame:
    return rule_frame(
        spark,
        [
            rule("s1", "Either", predicate="amount > 100 OR metadata.source = 'web'"),
            rule("s2", "Neither", predicate="NOT (type = 'click' OR type = 'view')"),
            rule("s3", "Arithmetic", predicate="amount + metadata.tax_rate * 100D > 60D"),
            rule("s4", "Pattern", predicate="timestamp RLIKE '^2024-01-0[1-9]' AND type IN ('purchase', 'signup')"),
            rule("s5", "Choice", predicate="CASE WHEN metadata.priority >= 4 THEN amount > 50 ELSE amount > 150 END"),
            rule("s6", "Reaches outside", predicate="reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL"),
            rule("s7", "Not a truth value", predicate="amount + 1D"),
            rule("s8", "Does not parse", predicate="amount > > 3"),
            rule("s9", "Text against number", predicate="type > 5"),
        ],
    )


def guarded_rules(spark: SparkSession) -> DataFrame:
    """The conditions above, more that must not end a job, and clauses that can't be evaluated."""
    more = [
        rule("t1", "Distance", predicate="abs(amount - 100D) > 50D"),
        rule("t2", "Overflows on the smallest number", predicate="abs(user_id) > 5"),
        rule("t3", "Pattern that doesn't compile", predicate="type RLIKE '('"),
        rule("t4", "Escape at the end", predicate="type LIKE 'x\\\\'"),
        rule("t5", "Pattern from the data", predicate="type RLIKE type"),
        rule("t6", "Wildcards", predicate="type LIKE 'pur%'"),
        rule("u1", "Empty name in the path", [clause("gt", "metadata..priority", 1)]),
        rule("u2", "Empty path", [clause("eq", "", "x")]),
        rule("u3", "No path", [clause("gt", None, 1)]),
        rule("u4", "List without item", [clause("any_gt", "items", 1)]),
        rule("u5", "No literal", [clause("gt", "amount", None)]),
    ]
    return click_conditions(spark).unionByName(rule_frame(spark, more))


# --- order events ----------------------------------------------------------------------------------


def _orders_with_items(spark: SparkSession, sf_dir: str, price: F.Column) -> DataFrame:
    """Orders with customer, region and the array of their items.

    Items are grouped per order: a group is one order's lines, never more.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.collect_list(F.struct(F.col("l_linenumber").alias("id"), price.alias("price"))).alias("items"),
            F.max("l_tax").alias("max_tax"),
        )
    )
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    buyers = customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", "c_mktsegment", "r_name")
    return orders.join(buyers, orders.o_custkey == buyers.c_custkey).join(items, "o_orderkey", "left")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    items = F.coalesce("items", F.array().cast("array<struct<id:int,price:double>>"))
    value = F.to_json(
        F.struct(
            F.lit("order_event").alias("type"),
            F.col("o_totalprice").alias("amount"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("tier"),
            (o % 3 == 0).alias("flagged"),
            F.struct(
                F.col("o_orderstatus").alias("source"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
                F.coalesce("max_tax", F.lit(0.0)).alias("tax_rate"),
            ).alias("metadata"),
            F.when(o % 43 != 0, F.struct(items.alias("items"), F.size(items).alias("total_items"))).alias("order"),
            F.date_format("o_orderdate", ISO).alias("timestamp"),
        )
    )
    return spread(
        _orders_with_items(spark, sf_dir, F.col("l_extendedprice")).select(
            F.lit("order-events").alias("topic"),
            (o % 20).cast("int").alias("partition"),
            F.expr("o_orderkey div 20").alias("offset"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            value.alias("value"),
        )
    )


def order_rules(spark: SparkSession) -> DataFrame:
    dear = clause("any_gt", "order.items", 100000, item="price")
    return rule_frame(
        spark,
        [
            rule("o1", "Dear item", [clause("not_null", "order"), dear]),
            rule("o2", "Dear item, no guard", [dear]),
            rule("o3", "Urgent and flagged", [clause("eq", "flagged", True), clause("le", "metadata.priority", 2)]),
        ],
    )


# --- sales events, in the vocabulary of the default rules --------------------------------------------

REGIONS = {"AMERICA": "US", "EUROPE": "EU", "ASIA": "APAC", "AFRICA": "LATAM", "MIDDLE EAST": "EMEA"}
TIERS = {"AUTOMOBILE": "premium", "BUILDING": "gold", "FURNITURE": "vip", "HOUSEHOLD": "standard", "MACHINERY": "basic"}
SOURCES = ["web", "mobile", "api", "legacy", "partner"]


def _mapped(mapping: dict[str, str], column: str) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(column))


def sales_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose region, tier and channel use the names the default rules test, arriving 17 seconds apart."""
    o = F.col("o_orderkey")
    items = F.coalesce("items", F.array().cast("array<struct<id:int,price:bigint>>"))
    value = F.to_json(
        F.struct(
            F.lit("order_event").alias("type"),
            F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("amount"),
            _mapped(REGIONS, "r_name").alias("region"),
            _mapped(TIERS, "c_mktsegment").alias("tier"),
            (o % 3 == 0).alias("flagged"),
            F.struct(
                F.element_at(F.array(*[F.lit(x) for x in SOURCES]), (o % 5 + 1).cast("int")).alias("source"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
                ((o % 20 + 5) / 100).alias("tax_rate"),
            ).alias("metadata"),
            F.struct(items.alias("items"), F.size(items).alias("total_items")).alias("order"),
            F.date_format("o_orderdate", ISO).alias("timestamp"),
        )
    )
    return spread(
        _orders_with_items(spark, sf_dir, F.floor(F.col("l_extendedprice") / 100).cast("bigint")).select(
            F.lit("source-events").alias("topic"),
            (o % 20).cast("int").alias("partition"),
            F.expr("o_orderkey div 20").alias("offset"),
            F.timestamp_seconds(F.lit(1704067200) + o * 17).alias("ts"),
            value.alias("value"),
        )
    )


# --- rule change log ----------------------------------------------------------------------------------


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log in which each order edits the rule of its customer.

    Some changes carry no id (it comes from the description), some delete, some switch the rule off.
    """
    o = F.col("o_orderkey")
    described = (
        F.when(o % 17 == 0, F.lit("!!!"))
        .otherwise(F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" watch (Customer "), F.col("o_custkey").cast("string"), F.lit(")")))
    )
    threshold = F.floor("o_totalprice").cast("bigint")
    one = F.struct(
        F.lit("gt").alias("op"),
        F.lit("amount").alias("path"),
        F.lit(None).cast("string").alias("item"),
        F.lit("num").alias("lit_kind"),
        threshold.alias("lit_int"),
        threshold.cast("double").alias("lit_num"),
        F.lit(None).cast("string").alias("lit_str"),
    )
    return table(spark, sf_dir, "orders").select(
        F.when(o % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("rule_id"),
        described.alias("description"),
        F.concat(F.lit("['amount'] > "), threshold.cast("string")).alias("expression"),
        F.array(one).alias("clauses"),
        F.lit(None).cast("string").alias("predicate"),
        (F.col("o_orderstatus") != "F").alias("active"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        o.alias("seq"),
        F.when(o % 13 == 0, F.lit("delete")).otherwise(F.lit("put")).alias("op"),
    )
