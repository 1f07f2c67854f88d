"""Dashboard answers, read from the rollups only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitrail.functions.text import hour_key
from arbitrail.schema import DEFAULT_RANGE_HOURS, PAGE_SIZE, RULE_NONE, RULE_PARSE


def in_range(rollups: DataFrame, start: Column, end: Column) -> DataFrame:
    """Buckets of the hours of ``start`` to ``end``, both included."""
    return rollups.where(F.col("hour").between(hour_key(start), hour_key(end)))


def last_hours(rollups: DataFrame, as_of: Column, hours: int = DEFAULT_RANGE_HOURS) -> DataFrame:
    """The presets: 1, 6 or 24 hours before ``as_of``."""
    return in_range(rollups, as_of - F.make_dt_interval(hours=F.lit(hours)), as_of)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("matched", "unmatched", "errored")]


def rule_stats(rule_rollups: DataFrame) -> DataFrame:
    """Totals per rule; ``sort_rules`` gives the order."""
    pseudo = F.col("rule_id").isin(RULE_PARSE, RULE_NONE)
    return rule_rollups.groupBy("rule_id").agg(*_sums()).withColumn("is_pseudo", pseudo)


def sort_rules(stats: DataFrame, key: str = "matched", descending: bool = True) -> DataFrame:
    """By matched, unmatched or total (matched + unmatched); equal rules by id."""
    value = F.col("matched") + F.col("unmatched") if key == "total" else F.col(key)
    return stats.orderBy(value.desc() if descending else value.asc(), "rule_id")


def page_of_rules(stats: DataFrame, page: int, key: str = "matched", descending: bool = True, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the sorted rules; the page number is kept within 1 and the last page.

    Places and the number of pages come from one window over the statistics, a row for each rule.
    """
    value = F.col("matched") + F.col("unmatched") if key == "total" else F.col(key)
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(value.desc() if descending else value.asc(), "rule_id"))
    numbered = stats.withColumns({"__place": place, "pages": F.greatest(F.lit(1), F.ceil(F.count("*").over(everything) / size)).cast("int")})
    shown = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages"))
    return numbered.withColumn("page", shown).where(F.ceil(F.col("__place") / size) == F.col("page")).orderBy("__place").drop("__place")


def time_series(rule_rollups: DataFrame) -> DataFrame:
    return rule_rollups.select(F.col("hour").alias("timestamp"), "rule_id", "matched", "unmatched", "errored").orderBy("timestamp", "rule_id")


def series_of_all(rule_rollups: DataFrame) -> DataFrame:
    return rule_rollups.groupBy(F.col("hour").alias("timestamp")).agg(*_sums()).orderBy("timestamp")


def series_of_rule(rule_rollups: DataFrame, rule_id: str) -> DataFrame:
    return time_series(rule_rollups.where(F.col("rule_id") == rule_id))


def total_evaluations(rule_rollups: DataFrame) -> DataFrame:
    return rule_rollups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_evaluations"))


def evaluations_of_presets(rule_rollups: DataFrame, as_of: Column, presets: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """(hours, total_evaluations) of each preset, from one pass over the rollups."""
    start = lambda h: hour_key(as_of - F.make_dt_interval(hours=F.lit(h)))
    sums = [F.coalesce(F.sum(F.when(F.col("hour") >= start(h), F.col("count"))), F.lit(0)).alias(f"h{h}") for h in presets]
    one = rule_rollups.where(F.col("hour") <= hour_key(as_of)).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"h{h}").alias("total_evaluations")) for h in presets])
    return one.select(F.explode(pairs).alias("p")).select("p.total_evaluations", "p.hours")


def total_messages(hour_rollups: DataFrame) -> DataFrame:
    """Sum of the hourly distinct counts."""
    return hour_rollups.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"))


_MEANS = {"avg_parse_time": "parse_sum", "avg_eval_time": "eval_sum", "avg_total_time": "total_sum"}


def _means() -> list[Column]:
    n = F.sum("count")
    return [F.coalesce(F.when(n > 0, (F.sum(c) / n).cast("bigint")), F.lit(0)).alias(name) for name, c in _MEANS.items()]


def latency(rule_rollups: DataFrame) -> DataFrame:
    """Mean nanoseconds, cut to whole numbers; 0 without evaluations."""
    return rule_rollups.agg(*_means())


def dashboard(rule_rollups: DataFrame, hour_rollups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-row totals, the rule statistics and the time series.

    The totals come from two one-row aggregates stacked and added up, so there is no join.
    """
    names = ["total_messages", "total_evaluations", *_MEANS]
    zero = F.lit(0).cast("bigint")
    of_rules = rule_rollups.agg(zero.alias(names[0]), F.coalesce(F.sum("count"), F.lit(0)).alias(names[1]), *_means())
    of_hours = total_messages(hour_rollups).select(names[0], *[zero.alias(n) for n in names[1:]])
    totals = of_rules.unionByName(of_hours).agg(*[F.sum(n).alias(n) for n in names])
    return totals, sort_rules(rule_stats(rule_rollups)), time_series(rule_rollups)


def match_rates(stats: DataFrame) -> DataFrame:
    """``match_rate`` in percent of all evaluations, one decimal; ``total`` is what the list shows."""
    everything = F.col("matched") + F.col("unmatched") + F.col("errored")
    rate = F.when(everything > 0, F.round(F.col("matched") * 100 / everything, 1)).otherwise(F.lit(0.0))
    return stats.withColumns({"total": F.col("matched") + F.col("unmatched"), "evaluations": everything, "match_rate": rate})


def cards(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("total_matched"), F.coalesce(F.sum("errored"), F.lit(0)).alias("total_errored"))


def peak(series: DataFrame, shown: tuple[str, ...] = ("matched", "unmatched", "errored")) -> DataFrame:
    """Highest value of the shown series, at least 1."""
    return series.agg(F.greatest(*[F.coalesce(F.max(c), F.lit(0)) for c in shown], F.lit(1)).alias("peak"))
