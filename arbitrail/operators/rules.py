"""The rule table: change log, current state, search, and the snapshot one batch works with."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import xor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitrail import schema as S
from arbitrail.functions import cells as C
from arbitrail.functions import text
from arbitrail.operators import clauses as K
from arbitrail.operators import predicates as P
from arbitrail.operators.bitmaps import Layout, layout, slot_needs
from arbitrail.session import remove_folder, shared_dir

# A snapshot up to these sizes travels inside the plan; a larger one is joined (see evaluate.py).
INLINE_RULES = 1000
INLINE_BITS = 2000
INLINE_PATHS = 256
#: Passes over the events that larger rule tables may take, each with a portion of the rules in its plan, before packs are used.
INLINE_PASSES = 20
RULES_PER_PACK = 500
BROADCAST_BYTES = 32 << 20


# --- table maintenance -------------------------------------------------------------------------


def with_rule_id(changes: DataFrame) -> DataFrame:
    """Fills a blank id from the description, or from ``seq`` when nothing readable is left."""
    blank = F.coalesce(F.trim("rule_id") == "", F.lit(True))
    readable = text.slug(F.coalesce("description", F.lit("")))
    made = F.when(readable != "", readable).otherwise(F.concat(F.lit("rule-"), F.col("seq").cast("string")))
    return changes.withColumn("rule_id", F.when(blank, made).otherwise(F.col("rule_id")))


def current_rules(changes: DataFrame) -> DataFrame:
    """Latest change per rule; rules whose latest change is a delete are gone.

    ``max_by`` combines before the shuffle, so one rule with very many changes stays cheap.
    """
    named = with_rule_id(changes)
    payload = F.struct(*[F.col(c) for c in named.columns if c != "rule_id"])
    latest = named.groupBy("rule_id").agg(F.max_by(payload, F.struct("updated_at", "seq")).alias("last"))
    return latest.select("rule_id", "last.*").where(~F.col("op").eqNullSafe("delete"))


def rules_as_of(changes: DataFrame, moment: Column) -> DataFrame:
    """The rule table as a batch started at ``moment`` sees it."""
    return current_rules(changes.where(F.col("updated_at") <= moment))


def search(rules: DataFrame, term: str = "", status: str = "all") -> DataFrame:
    """Case-insensitive substring of description or expression, and status all/active/inactive."""
    needle = F.lit(term.lower())
    hit = F.lower("description").contains(needle) | F.lower("expression").contains(needle)
    if status == "active":
        hit &= F.col("active")
    elif status != "all":
        hit &= ~F.col("active")
    return rules.where(hit)


def lookup(rules: DataFrame, rule_id: str) -> DataFrame:
    """One rule; a missing id is an error. The table is evaluated once; its one row is what comes back."""
    found = rules.where(F.col("rule_id") == rule_id).limit(1).collect()
    if not found:
        raise LookupError(f"Rule not found: {rule_id}")
    return rules.sparkSession.createDataFrame(found, rules.schema)


def counts(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("active")).alias("active"),
        F.count_if(~F.col("active")).alias("inactive"),
    )


def seed_if_empty(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """The existing table, or the seeds when it holds no row."""
    return seeds if existing.isEmpty() else existing


def rule_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rule rows made in code (``clauses.rule``) as a table."""
    return spark.createDataFrame([tuple(tuple_of(r, S.RULES)) for r in rows], S.RULES)


def tuple_of(row: dict, schema) -> list:
    return [[tuple(c[f] for f in S.CLAUSE.fieldNames()) for c in row[n]] if n == "clauses" and row[n] is not None else row[n] for n in schema.fieldNames()]


# --- the snapshot of active rules --------------------------------------------------------------


@dataclass
class InlinePass:
    """Rules small enough to be a constant of the plan."""

    layout: Layout
    slots: list[tuple]
    predicates: list[str]
    event_schema: str | None = None


@dataclass
class PackPass:
    """Rules kept as packs in one row of bounded size, which is broadcast to the events."""

    packs: DataFrame


@dataclass
class Snapshot:
    spark: SparkSession
    count: int
    passes: list = field(default_factory=list)
    load_errors: list[tuple] = field(default_factory=list)
    folder: str | None = None  # of the stored rules, if the plan reads them
    version: int = 0  # of the active rules' content, the same in every run
    texts: DataFrame | None = None  # (rule_version, rule_id, expression, paths) of the active rules

    def release(self) -> None:
        """Removes the stored rules; the snapshot can't be evaluated afterwards."""
        if self.folder:
            remove_folder(self.spark, self.folder)


def take_snapshot(
    rules: DataFrame,
    event_schema: str | None = None,
    inline_rules: int = INLINE_RULES,
    inline_paths: int = INLINE_PATHS,
    rules_per_pack: int = RULES_PER_PACK,
    broadcast_bytes: int = BROADCAST_BYTES,
    inline_passes: int = INLINE_PASSES,
) -> Snapshot:
    """Reads the active rules once; the result does not change when the table does.

    Rules that fit go into the plan. Of more, portions that fit each take a pass over the events, so that a pair of event and rule still costs
    bit arithmetic in generated code; parsing an event again is little against the rules of a portion. Only tables beyond ``inline_passes``
    portions are broadcast as packs.

    All clauses are coded and judged first, by one expression, so the plans that sizes lead to agree. A null id is a blank one.
    """
    spark = rules.sparkSession
    coded = F.transform("clauses", lambda c, i: K.clause_code(c, i + 1))
    active = rules.where("active").select(F.coalesce("rule_id", F.lit("")).alias("rule_id"), "expression", coded.alias("clauses"), "predicate")
    active = active.withColumn("mark", F.xxhash64("rule_id", "expression", F.to_json(F.struct("clauses")), "predicate"))
    head = active.limit(inline_rules + 1).collect()
    bits = {(i, *c) for r in head for i, c in enumerate(r["clauses"] or ())}
    paths = {(c["path"], c["item"]) for r in head for c in (r["clauses"] or ())}
    if len(head) <= inline_rules and len(bits) <= INLINE_BITS and len(paths) <= inline_paths:
        snap = Snapshot(spark, 0, version=reduce(xor, (r["mark"] for r in head), 0))
        snap.texts = _texts(spark.createDataFrame(head, active.schema), snap.version)
        _add_inline(snap, sorted(head, key=lambda r: r["rule_id"]), event_schema)
        return snap

    folder = shared_dir(spark, "rules")
    active.withColumn("row_no", F.monotonically_increasing_id()).write.parquet(folder)
    kept = spark.read.parquet(folder)
    plain = kept.where("predicate is null")
    n, size = plain.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("rule_id", "expression", "clauses"))))).first()
    snap = Snapshot(spark, n, folder=folder, version=kept.agg(F.bit_xor("mark")).first()[0] or 0)
    snap.texts = _texts(kept, snap.version)
    if n and n <= inline_passes * inline_rules:
        for portion in _portions(plain, inline_rules, inline_paths):
            _add_inline(snap, portion, event_schema, counted=True)
    elif n:
        n_packs = -(-n // rules_per_pack)
        n_chunks = min(n_packs, -(-(size or 1) // max(1, broadcast_bytes)))
        packs = _packs(plain, n_packs)
        for chunk in range(n_chunks):  # a pass over the events for each chunk that is small enough to be broadcast
            members = packs.where(F.pmod("pack_no", F.lit(n_chunks)) == chunk)
            snap.passes.append(PackPass(members.agg(F.collect_list(F.struct("slots", "rules")).alias("packs"))))
    last = -1
    while True:  # conditions are compiled, so they come in bounded portions, one pass each; the row number is unique
        portion = kept.where(F.col("predicate").isNotNull() & (F.col("row_no") > last)).orderBy("row_no").limit(inline_rules).collect()
        if not portion:
            break
        last = portion[-1]["row_no"]
        _add_inline(snap, portion, event_schema)
    if not snap.passes:
        _add_inline(snap, [], event_schema)
    return snap


def _portions(rules: DataFrame, most_rules: int, most_paths: int):
    """Rules without conditions in lists that fit into a plan, one list on the driver at a time. Rules with the same paths stay together."""
    order = F.array_join(F.transform("clauses", lambda c: F.concat_ws(" ", c["path"], c["item"], c["family"].cast("string"))), ",")
    portion: list = []
    bits: set = set()
    paths: set = set()
    for r in rules.withColumn("order", order).orderBy("order", "row_no").drop("order").toLocalIterator():
        more_bits = {(i, *c) for i, c in enumerate(r["clauses"] or ())}
        more_paths = {(c["path"], c["item"]) for c in r["clauses"] or ()}
        if portion and (len(portion) == most_rules or len(bits | more_bits) > INLINE_BITS or len(paths | more_paths) > most_paths):
            yield portion
            portion, bits, paths = [], set(), set()
        portion.append(r)
        bits |= more_bits
        paths |= more_paths
    if portion:
        yield portion


def _texts(rules: DataFrame, version: int) -> DataFrame:
    paths = F.transform("clauses", lambda c: F.coalesce(c["path"], F.lit("")))
    return rules.select(F.lit(version).cast("long").alias("rule_version"), "rule_id", "expression", F.coalesce(paths, F.array().cast("array<string>")).alias("paths"))


def _add_inline(snap: Snapshot, rows: list, event_schema: str | None, counted: bool = False) -> None:
    slots: dict[tuple, int] = {}
    predicates: list[str] = []
    coded = []
    for r in rows:
        if r["predicate"] is not None:
            verdict = P.check_condition(snap.spark, r["predicate"], event_schema) if event_schema else P.REFUSED
            if verdict == P.UNPARSEABLE:
                snap.load_errors.append((r["rule_id"], verdict))
                continue
            family = K.PREDICATE if verdict == P.ACCEPTED else K.REFUSED
            clause_rows = [{**_NO_LITERAL, "no": 1, "family": family, "slot": len(predicates)}]
            if verdict == P.ACCEPTED:
                predicates.append(r["predicate"])
        else:
            clause_rows = []
            for c in r["clauses"] or ():
                slot = -1 if c["family"] == K.UNSUPPORTED else slots.setdefault((c["path"], c["item"]), len(slots))
                clause_rows.append({**c.asDict(), "slot": slot})
        coded.append({"rule_id": r["rule_id"], "expression": r["expression"], "clauses": clause_rows})
    snap.count += 0 if counted else len(coded)
    if coded or not snap.passes:
        needs: dict[int, set[str]] = {}
        for c in (c for r in coded for c in r["clauses"]):
            needs.setdefault(c["slot"], set()).update(slot_needs(c))
        ordered = [(p, i, needs[at] or "presence") for (p, i), at in slots.items()]
        snap.passes.append(InlinePass(layout(coded), ordered, predicates, event_schema))


_NO_LITERAL = {"accepted": 0, "lit_kind": C.TEXT, "lit_int": None, "lit_num": None, "lit_str": None, "path": None, "item": None}


def _packs(rules: DataFrame, n_packs: int) -> DataFrame:
    """Rules in packs of bounded size, each with the list of paths its clauses read."""
    key = lambda c: F.struct(c["path"].alias("path"), c["item"].alias("item"))
    grouped = (
        rules.withColumn("pack_no", F.pmod(F.xxhash64("rule_id"), F.lit(n_packs)).cast("int"))
        .groupBy("pack_no")
        .agg(F.collect_list(F.struct("rule_id", "expression", "clauses")).alias("members"))
    )
    reading = lambda cs: F.filter(cs, lambda c: c["family"] != K.UNSUPPORTED)
    slots = F.array_distinct(F.flatten(F.transform("members", lambda m: F.transform(reading(m["clauses"]), key))))

    def coded(m, slots_col):
        slot = lambda c: F.array_position(slots_col, key(c)) - 1
        placed = F.transform(m["clauses"], lambda c: F.struct(*[c[n].alias(n) for n in K.CODED], slot(c).cast("int").alias("slot")))
        return F.struct(m["rule_id"].alias("rule_id"), m["expression"].alias("expression"), placed.alias("clauses"))

    return grouped.withColumn("slots", slots).select(
        "pack_no", "slots", F.transform("members", lambda m: coded(m, F.col("slots"))).alias("rules")
    )


def load_errors(rules: DataFrame, event_schema: str | None = None) -> DataFrame:
    """(rule_id, verdict) of each active rule with a condition or with clauses that can't be evaluated.

    accepted, refused, not_boolean or unparseable for a condition (an unparseable one is skipped), bad_clause for a rule some of
    whose clauses always give an error. Conditions are judged once for each distinct text.
    """
    spark = rules.sparkSession
    active = rules.where("active")
    broken = F.exists("clauses", lambda c: K.clause_code(c, F.lit(1))["family"] == K.UNSUPPORTED)
    bad = active.where(F.col("predicate").isNull() & F.coalesce(broken, F.lit(False))).select("rule_id", F.lit("bad_clause").alias("verdict"))
    conditions = active.where(F.col("predicate").isNotNull()).select("rule_id", "predicate")
    judged = [(r["predicate"], P.check_condition(spark, r["predicate"], event_schema) if event_schema else P.REFUSED) for r in conditions.select("predicate").distinct().toLocalIterator()]
    verdicts = spark.createDataFrame(judged, "predicate string, verdict string")
    return conditions.join(verdicts, "predicate").select("rule_id", "verdict").unionByName(bad)
