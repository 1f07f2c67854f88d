"""URL rules by a sort-merge range join.

Reversed host labels turn "this host and all its subdomains" into a prefix, so every rule is an interval of keys and two
intervals are nested or apart. One sorted sweep over rule starts and points keeps the stack of rules that are open:

* a rule carries its stack, itself and the rules around it, from when it is pushed;
* at a point, the last rule that started before it has the whole stack; the ones that ended meanwhile are popped, which
  for prefixes means: those that aren't a prefix of the point's key.

The sweep runs twice, over hosts and then over the paths of each host that has rules. It is range-partitioned, ties split
by row, and the last rule of each range is handed to the next ranges that have none of their own. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitrail.llm.common import numbered_runs, stored

#: The two sorts of rows of a sweep; a rule comes before a point with its key.
START, POINT = 0, 1


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://``, its A-Z lower-cased; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it: a rule's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(starts: DataFrame, points: DataFrame, purpose: str) -> DataFrame:
    """(space, key, carry, open): the stack of rules open at each point, outermost first; only points where one is.

    starts: (space, key, stack), a row for each rule key, the stack an array of keys with the rule's own as its last.
    points: (space, key, carry); carry comes back as it is. Keys of different spaces have nothing to do with each other.
    """
    rules = starts.select("space", "key", F.lit(START).alias("kind"), F.lit("").alias("carry"), "stack")
    marks = points.select("space", "key", F.lit(POINT).alias("kind"), "carry", F.lit(None).cast("array<string>").alias("stack"))
    order = ["space", "key", "kind", "carry"]
    ranged = numbered_runs(rules.unionByName(marks), order, purpose)
    top = F.when(F.col("kind") == START, F.struct("space", "key", "stack"))
    # a row for each range: its last rule; from these, what the ranges before hand on
    lasts = ranged.groupBy("run").agg(F.max(top).alias("top"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("run", F.last("top", True).over(before).alias("handed"))
    so_far = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("top", F.last(top, True).over(so_far)).where(F.col("kind") == POINT)
    seen = seen.join(F.broadcast(carried), "run", "left").withColumn("top", F.coalesce("top", "handed"))
    still_open = F.filter("top.stack", lambda k: F.startswith("key", k))
    return seen.where(F.col("top.space") == F.col("space")).select("space", "key", "carry", still_open.alias("open")).where(F.size("open") > 0)


def with_stacks(keys: DataFrame, prefixes: Column) -> DataFrame:
    """(space, key, stack) of distinct rule keys (space, key): the rules that are prefixes of each key, itself the last.

    A join of the rules' own prefixes with the rules, so bounded by the length of a rule.
    """
    around = keys.select("space", "key", F.explode(prefixes).alias("outer"))
    found = around.join(keys.select("space", F.col("key").alias("outer")), ["space", "outer"])
    ordered = F.array_sort(F.collect_list(F.struct(F.length("outer").alias("size"), "outer")))
    return found.groupBy("space", "key").agg(ordered.alias("found")).select("space", "key", F.col("found.outer").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    rules: (host, path, verdict). A rule fits its host and all subdomains when the url's path starts with the rule's;
    the longest (host and path together, then the longer host) wins; of equal rules with different verdicts ``block``
    does. Rules with a null host or path are left out. Urls that no rule fits, null ones too, get ``default``.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select("*", host_key(F.col("host")).alias("host_key"))
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    distinct = stored(urls.select("host", "path").distinct(), "urls")

    nowhere = F.lit("").alias("space")
    labels = F.split(F.left(F.col("key"), F.length("key") - 1), r"\.")
    outer_hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    host_starts = with_stacks(rules.select(nowhere, F.col("host_key").alias("key")).distinct(), outer_hosts)
    hosts = distinct.select("host").distinct()
    open_hosts = sweep(host_starts, hosts.select(nowhere, host_key(F.col("host")).alias("key"), F.col("host").alias("carry")), "hosts")

    # the empty prefix too: a rule may have an empty path
    outer_paths = F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.left(F.col("key"), n))
    path_starts = with_stacks(rules.select(F.col("host_key").alias("space"), F.col("path").alias("key")), outer_paths)
    points = distinct.join(open_hosts.select(F.col("carry").alias("host"), F.explode("open").alias("space")), "host")
    open_paths = sweep(path_starts, points.select("space", F.col("path").alias("key"), F.col("host").alias("carry")), "paths")
    deepest = open_paths.select(F.col("carry").alias("host"), F.col("key").alias("path"), F.col("space").alias("host_key"), F.element_at("open", -1).alias("rule_path"))
    size = F.length("host_key") + F.length("rule_path")
    best = deepest.groupBy("host", "path").agg(F.max_by(F.struct("host_key", "rule_path"), F.struct(size, F.length("host_key"))).alias("best"))
    best = best.select("host", "path", F.col("best.host_key").alias("host_key"), F.col("best.rule_path").alias("rule_path"))
    named = rules.select("host_key", F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    found = best.join(named, ["host_key", "rule_path"]).select("host", "path", "rule", "verdict")
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
