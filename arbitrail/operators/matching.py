"""Matches only, by joining each rule at its most selective clauses.

When nobody asks for the unmatched audits, an event need not meet every rule. A rule stands at the key of its
equality conditions on texts: the fields compared are its signature, and an event carries one key per
signature. A rule without such conditions stands at an interval of one number: the thresholds all rules have
for a path cut its line into places, a rule's interval is covered by few nodes of a binary tree over these
places, and an event carries its place and the nodes above it, so it meets such a rule once, and only inside the
interval. Rules with neither meet every event. The bitmaps then check the rest of each rule. The rule side is a
snapshot of bounded size (``rules.INLINE_RULES``, each with two nodes for each level at most), so broadcasting it is safe.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.functions import cells as C
from arbitrail.operators import bitmaps as B
from arbitrail.operators import clauses as K
from arbitrail.operators.evaluate import evaluate
from arbitrail.operators.parse import parse_events
from arbitrail.operators.rules import InlinePass, Snapshot

MAX_SIGNATURES = 16
_SEPARATOR = "\u0001"
#: Kinds of keys: texts of some slots, and a node over the places of a slot's number.
TEXTS, NUMBER = range(2)


def match_pairs(raw: DataFrame, snapshot: Snapshot) -> DataFrame:
    """topic, partition, offset, ts, rule_id of every match."""
    columns = ["topic", "partition", "offset", "ts", "rule_id"]
    parts = []
    for step in snapshot.passes:
        if not isinstance(step, InlinePass) or step.predicates:
            one = Snapshot(snapshot.spark, snapshot.count, [step])
            parts.append(evaluate(raw, one, matched_only=True).select(*columns))
        elif step.layout.coded:
            parts.append(_join(raw, step).select(*columns))
    result = parts[0] if parts else evaluate(raw, snapshot, matched_only=True).select(*columns)
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def _texts(clauses: list[dict]) -> dict[int, str]:
    """The slots a rule compares with a text for equality, each with the text."""
    return {c["slot"]: c["lit_str"] for c in clauses if c["family"] == K.COMPARE and c["accepted"] == K.ACCEPTED["eq"] and c["lit_kind"] == C.TEXT}


def _bounds(clauses: list[dict]) -> list[dict]:
    """The clauses that bound a number that a double holds exactly."""
    orders = [K.ACCEPTED[op] for op in ("gt", "ge", "lt", "le", "eq")]
    return [c for c in clauses if c["family"] == K.COMPARE and c["lit_kind"] == C.INTEGER and c["accepted"] in orders and not B.is_big(c)]


@dataclass(frozen=True)
class Line:
    """The places of one path's numbers: below all thresholds (and null), at the first, between it and the next, and so on."""

    thresholds: list[float]

    @property
    def depth(self) -> int:
        return (2 * len(self.thresholds)).bit_length()

    def interval(self, bounds: list[dict]) -> tuple[int, int]:
        """First and last place at which all bounds hold; none if the first is behind the last."""
        low, high = 0, 2 * len(self.thresholds)
        for c in bounds:
            at = 2 * self.thresholds.index(c["lit_num"]) + 1
            if not c["accepted"] & K.BELOW:
                low = max(low, at if c["accepted"] & K.EQUAL else at + 1)
            if not c["accepted"] & K.ABOVE:
                high = min(high, at if c["accepted"] & K.EQUAL else at - 1)
        return low, high

    def nodes(self, low: int, high: int) -> list[int]:
        """The fewest nodes that hold these places and no others; the root is 1, the children of n are 2 n and 2 n + 1."""
        out, left, right = [], low + (1 << self.depth), high + 1 + (1 << self.depth)
        while left < right:
            if left & 1:
                out.append(left)
                left += 1
            if right & 1:
                right -= 1
                out.append(right)
            left, right = left >> 1, right >> 1
        return out

    def leaf(self, slot: int) -> str:
        """The node of an event's place, null where the path has no number and isn't null, as SQL."""
        values, n = B.sql_array(self.thresholds), f"n{slot}"
        place = f"size(filter({values}, x -> {n} > x)) + size(filter({values}, x -> {n} >= x))"
        return f"{1 << self.depth} + case when k{slot} = {C.NULL} then 0 when {n} is not null then {place} end"


def _keyed(rules: list[dict]) -> tuple[list[list[tuple[tuple, str]]], dict[int, Line]]:
    """Per rule, in the order given, the (kind of key, key) at which it stands, and the lines of the paths that are bounded.

    Only the ``MAX_SIGNATURES`` signatures most rules have are used; others stand at a number or meet every event. Rules that share
    an id are rules of their own. A rule whose bounds exclude each other stands nowhere.
    """
    signatures = [tuple(sorted(_texts(r["clauses"]))) for r in rules]
    often = [s for s, _ in sorted(Counter(s for s in signatures if s).items(), key=lambda x: (-x[1], x[0]))[:MAX_SIGNATURES]]
    thresholds: dict[int, set[float]] = {}
    for r in rules:
        for c in _bounds(r["clauses"]):
            thresholds.setdefault(c["slot"], set()).add(c["lit_num"])
    lines = {slot: Line(sorted(found)) for slot, found in thresholds.items()}
    out, used = [], set()
    for r, signature in zip(rules, signatures, strict=True):
        if signature in often:
            texts = _texts(r["clauses"])
            out.append([((TEXTS, *signature), _SEPARATOR.join(texts[s] for s in signature))])
            continue
        bounded: dict[int, list[dict]] = {}
        for c in _bounds(r["clauses"]):
            bounded.setdefault(c["slot"], []).append(c)
        places = {slot: lines[slot].interval(bounds) for slot, bounds in bounded.items()}
        if not places:
            out.append([((TEXTS,), "")])
            continue
        share = {slot: (high - low + 1) / (2 * len(lines[slot].thresholds) + 1) for slot, (low, high) in places.items()}
        slot = min(places, key=lambda s: (share[s], s))
        used.add(slot)
        out.append([((NUMBER, slot), str(node)) for node in lines[slot].nodes(*places[slot])])
    return out, {slot: lines[slot] for slot in sorted(used)}


def _join(raw: DataFrame, step: InlinePass) -> DataFrame:
    plan = step.layout
    keyed, lines = _keyed(plan.coded)
    kinds = sorted({kind for keys in keyed for kind, _ in keys})
    number = {kind: i for i, kind in enumerate(kinds)}
    masks = [f"m{w}" for w in range(plan.words)]
    rows = [(r["rule_id"], number[kind], key, None, *[r[m] for m in masks]) for r, keys in zip(plan.rules, keyed, strict=True) for kind, key in keys]
    schema = "rule_id string, signature int, match_key string, fixed int, " + ", ".join(f"{m} bigint" for m in masks)
    rules = raw.sparkSession.createDataFrame(rows, schema)

    marked = B.with_bitmaps(B.read_paths(parse_events(raw), step.slots), plan)
    marked = marked.selectExpr("*", *[f"{line.leaf(slot)} as leaf{slot}" for slot, line in lines.items()])
    keys = []
    for kind in kinds:
        if kind[0] == NUMBER:  # only the levels at which a rule stands
            levels = sorted({lines[kind[1]].depth + 1 - int(key).bit_length() for of in keyed for k, key in of if k == kind})
            values = [F.shiftright(f"leaf{kind[1]}", level).cast("string") for level in levels]
        else:  # an event without a text in one of the fields has no key
            texts = [F.when(F.col(f"k{i}") == C.TEXT, F.col(f"s{i}")) for i in kind[1:]]
            values = [F.concat(*[x for t in texts for x in (F.lit(_SEPARATOR), t)][1:]) if texts else F.lit("")]
        keys += [F.struct(F.lit(number[kind]).alias("signature"), value.alias("match_key")) for value in values]
    wanted = ["topic", "partition", "offset", "ts", *[f"hold{w}" for w in range(plan.words)]]
    if not keys:
        keys = [F.struct(F.lit(None).cast("int").alias("signature"), F.lit(None).cast("string").alias("match_key"))]
    # explode_outer: a plain explode has Catalyst test the array in a filter below, parsing every event twice.
    exploded = marked.select(*wanted, F.explode_outer(F.when(F.col("parsed"), F.array(*keys))).alias("key")).select(*wanted, "key.*")
    joined = exploded.join(F.broadcast(rules).alias("r"), ["signature", "match_key"])
    return joined.where(F.expr(B.pair_matches("r", plan.words)))
