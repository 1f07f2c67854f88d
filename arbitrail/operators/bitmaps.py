"""Rule outcomes from clause bitmaps: the plan for a rule snapshot that fits into it.

Rules share most of their clauses. Every distinct (position, clause) gets one bit, ordered by position,
so a rule's own clauses appear in its mask from left to right. Per event three bitmaps are computed
once: which clauses hold, which are errors, which lack their enclosing object. Per (event, rule) only
bit arithmetic is left: the lowest bit of ``mask AND NOT holds`` is the clause that decides.
All of it is ordinary generated code; there is no lambda in the per-pair part.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.functions import cells as C
from arbitrail.operators import clauses as K

WORD_BITS = 63
EXACT_DOUBLE = 1 << 53
# Error shown when a clause is an error and its enclosing object is there.
STATIC_CAUSE = {
    K.COMPARE: K.NOT_COMPARABLE,
    K.STARTS_WITH: K.NOT_A_TEXT,
    K.ANY_ITEM: K.NOT_A_LIST,
    K.UNSUPPORTED: K.NOT_SUPPORTED,
    K.REFUSED: K.RULE_REFUSED,
}


@dataclass
class Layout:
    """Bit positions of the distinct clauses, and each rule's masks."""

    bits: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    coded: list[dict] = field(default_factory=list)

    @property
    def words(self) -> int:
        return max(1, -(-len(self.bits) // WORD_BITS))


def layout(coded_rules: list[dict]) -> Layout:
    def key(c):
        return tuple(c[k] for k in ("slot", "family", "accepted", "lit_kind", "lit_int", "lit_num", "lit_str"))

    distinct = {(c["no"], key(c)): c for r in coded_rules for c in r["clauses"]}
    ordered = sorted(distinct, key=lambda k: (k[0], repr(k[1])))
    place = {k: i for i, k in enumerate(ordered)}
    out = Layout([{**distinct[k], "bit": i} for i, k in enumerate(ordered)], coded=coded_rules)
    for r in coded_rules:
        masks = [0] * out.words
        for c in r["clauses"]:
            at = place[(c["no"], key(c))]
            masks[at // WORD_BITS] |= 1 << (at % WORD_BITS)
        out.rules.append(
            {
                "rule_id": r["rule_id"],
                "rule_json": json.dumps(r["rule_id"], ensure_ascii=False)[1:-1],
                "expression": r["expression"],
                "fixed": None,
                "causes": [STATIC_CAUSE.get(c["family"], K.NOT_COMPARABLE) for c in r["clauses"]],
                "paths": [c["path"] or "" for c in r["clauses"]],
                **{f"m{w}": m for w, m in enumerate(masks)},
            }
        )
    return out


def rule_type(words: int) -> str:
    masks = "".join(f",m{w}:bigint" for w in range(words))
    return f"array<struct<rule_id:string,rule_json:string,expression:string,fixed:int,causes:array<int>,paths:array<string>{masks}>>"


def pseudo_rule(rule_id: str, code: int, words: int) -> dict:
    """A row that is not a rule: its code is fixed and its masks are empty."""
    return {"rule_id": rule_id, "rule_json": None, "expression": None, "fixed": code, "causes": [], "paths": [], **{f"m{w}": 0 for w in range(words)}}


# --- per event: typed values of each path, then the bitmaps ----------------------------------------
# Written as SQL text: hundreds of small Column calls per plan would cost seconds on the driver.


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: list) -> str:
    """A constant array, as JSON that Catalyst folds into one literal."""
    kind = {str: "string", float: "double", int: "bigint"}[type(values[0])]
    return f"from_json({sql_text(json.dumps(values))}, 'array<{kind}>')"


def _path(path: str) -> str:
    return sql_text(f"${path}" if path.startswith("[") else f"$.{path}")


def _holder(root: str, path: str) -> str:
    """SQL test that the object holding ``path`` is there."""
    parent = re.sub(r"(^|\.)[^.\[\]]+$|\['[^']*'\]$", "", path)
    return "true" if not parent else f"try_variant_get({root}, {_path(parent)}, 'map<string,variant>') is not null"


def read_paths(parsed: DataFrame, slots: list[tuple]) -> DataFrame:
    """Columns ``k<i>`` (kind), ``n<i>`` (number), ``i<i>`` (exact integer) and ``s<i>`` (text) per path.

    A list slot has the largest and smallest number (``hi``, ``lo``), ``nul`` and ``bad`` instead.
    The steps are separate projections on purpose: each value is used several times by the next one.
    """
    lists = [(i, s) for i, s in enumerate(slots) if s[1] is not None]
    plain = [(i, s) for i, s in enumerate(slots) if s[1] is None]
    valued = [(i, s) for i, s in plain if s[2] != "presence"]

    values = [f"try_variant_get(root, {_path(path)}, 'variant') as v{i}" for i, (path, _, _) in plain]
    out = parsed.selectExpr("*", *values)
    if lists:
        out = out.withColumns({f"c{i}": C.array_cell(F.col("root"), F.lit(path), F.lit(item)) for i, (path, item, _) in lists})
    out = out.selectExpr("*", *[f"schema_of_variant(v{i}) as t{i}" for i, _ in valued])
    kinds = [f"{_kind_sql(i, s)} as k{i}" for i, s in plain] + [f"c{i}.kind as k{i}" for i, _ in lists]
    out = out.selectExpr("*", *kinds)
    typed = []
    for i, (_, _, needs) in valued:
        if "number" in needs:
            typed.append(f"case when k{i} in ({C.INTEGER}, {C.FRACTION}) then try_variant_get(v{i}, '$', 'double') end as n{i}")
        if "integer" in needs:
            typed.append(f"case when k{i} = {C.INTEGER} then try_variant_get(v{i}, '$', 'bigint') end as i{i}")
        if "text" in needs:
            typed.append(f"case when k{i} in ({C.TEXT}, {C.BOOL}) then try_variant_get(v{i}, '$', 'string') end as s{i}")
    for i, (_, _, needs) in lists:
        if "number" in needs:
            numbers = f"transform(c{i}.items, e -> coalesce(e.d, double(e.i)))"
            typed += [
                f"array_max({numbers}) as hi{i}",
                f"array_min({numbers}) as lo{i}",
                f"exists(c{i}.items, e -> e.kind = {C.NULL}) as nul{i}",
                f"exists(c{i}.items, e -> e.kind not in ({C.NULL}, {C.INTEGER}, {C.FRACTION})) as bad{i}",
            ]
    return out.selectExpr("*", *typed)


def _kind_sql(i: int, slot: tuple) -> str:
    head = f"case when v{i} is null then case when {_holder('root', slot[0])} then {C.NULL} else {C.NO_PARENT} end "
    if slot[2] == "presence":
        return head + f"when is_variant_null(v{i}) then {C.NULL} else {C.OTHER} end"
    return head + (
        f"when t{i} = 'BIGINT' then {C.INTEGER} when t{i} = 'STRING' then {C.TEXT} when t{i} = 'BOOLEAN' then {C.BOOL} "
        f"when t{i} = 'VOID' then {C.NULL} when t{i} like 'DECIMAL%' or t{i} in ('DOUBLE', 'FLOAT') then {C.FRACTION} "
        f"when t{i} like 'ARRAY%' then {C.ARRAY} else {C.OTHER} end"
    )


def slot_needs(clause: dict) -> set[str]:
    """What a clause reads of its path."""
    number = clause["lit_kind"] == C.INTEGER
    if clause["family"] == K.ANY_ITEM:
        simple = number and clause["accepted"] in (K.ACCEPTED[o] for o in ("gt", "ge", "lt", "le")) and not is_big(clause)
        return {"number"} if simple else {"items"}
    if clause["family"] == K.COMPARE:
        return ({"number", "integer"} if is_big(clause) else {"number"}) if number else {"text"}
    return {"text"} if clause["family"] == K.STARTS_WITH else set()


def is_big(c: dict) -> bool:
    return c["lit_int"] is not None and abs(c["lit_int"]) >= EXACT_DOUBLE


def with_bitmaps(prepared: DataFrame, plan: Layout) -> DataFrame:
    """Adds ``hold<w>``, ``error<w>`` and ``orphan<w>`` for each word; ``p<i>`` are the SQL conditions."""
    columns = []
    for w in range(plan.words):
        members = [(1 << b, c) for b, c in enumerate(plan.bits[w * WORD_BITS : (w + 1) * WORD_BITS])]
        for name, parts in zip(("hold", "error", "orphan"), _word(members)):
            # Never null: otherwise a filter on matches pushes "is not null" below the parse and doubles it.
            columns.append(f"coalesce({' | '.join(parts) or '0L'}, 0L) as {name}{w}")
    out = prepared
    states = {}
    for c in plan.bits:
        if "items" in slot_needs(c):
            literal = F.struct(*[F.lit(c[n]).cast(t).alias(n) for n, t in _COMPARED.items()])
            states[f"a{c['bit']}"] = K.any_item(F.col(f"c{c['slot']}.items"), literal)
    if states:
        out = out.withColumns(states)
    return out.selectExpr("*", *columns)


_COMPARED = {"accepted": "int", "lit_kind": "int", "lit_int": "bigint", "lit_num": "double", "lit_str": "string"}
_SQL_OP = {K.ACCEPTED[op]: sign for op, sign in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}.items()}


def _pick(condition: str, bits: int) -> str:
    return f"(case when {condition} then {bits}L else 0L end)"


def _word(members: list[tuple[int, dict]]) -> tuple[list[str], list[str], list[str]]:
    hold, error, orphan = [], [], []
    groups: dict[tuple, list[tuple[int, dict]]] = defaultdict(list)
    for bit, c in members:
        groups[(c["family"], c["slot"], c["lit_kind"], c["accepted"], is_big(c))].append((bit, c))
    orphans: dict[int, int] = defaultdict(int)
    for (family, slot, lit_kind, accepted, big), group in sorted(groups.items()):
        bits = sum(b for b, _ in group)
        kind = f"k{slot}"
        if family in (K.UNSUPPORTED, K.REFUSED):
            error.append(f"{bits}L")
            continue
        if family == K.PREDICATE:
            hold.append(_pick(f"p{slot}", bits))
            continue
        orphans[slot] |= bits
        if family == K.NOT_NULL:
            hold.append(_pick(f"{kind} not in ({C.NULL}, {C.NO_PARENT})", bits))
            error.append(_pick(f"{kind} = {C.NO_PARENT}", bits))
        elif family == K.STARTS_WITH:
            hold += [_pick(f"{kind} = {C.TEXT} and startswith(s{slot}, {sql_text(c['lit_str'])})", b) for b, c in group]
            error.append(_pick(f"{kind} <> {C.TEXT}", bits))
        elif family == K.COMPARE:
            number = lit_kind == C.INTEGER
            wanted = f"{C.INTEGER}, {C.FRACTION}" if number else f"{lit_kind}"
            if number and not big:
                hold.append(_by_threshold(f"n{slot}", accepted, group, lambda c: c["lit_num"]))
            elif number:  # too large for a double: integers exactly, fractions as double
                sign = _SQL_OP[accepted]
                hold += [_pick(f"coalesce(i{slot} {sign} {c['lit_int']}L, n{slot} {sign} {c['lit_num']!r}D, false)", b) for b, c in group]
            else:
                same = f"(case when {kind} = {lit_kind} then s{slot} end)"
                hold.append(_by_threshold(same, accepted, group, lambda c: c["lit_str"]))
            if accepted & K.BELOW:  # null lies below every literal
                hold.append(_pick(f"{kind} = {C.NULL}", bits))
            if accepted == K.ACCEPTED["ne"]:  # another type differs from it
                hold.append(_pick(f"{kind} not in ({C.NULL}, {C.NO_PARENT}, {wanted})", bits))
            equality = accepted in (K.ACCEPTED["eq"], K.ACCEPTED["ne"])
            error.append(_pick(f"{kind} = {C.NO_PARENT}" if equality else f"{kind} not in ({C.NULL}, {wanted})", bits))
        elif "items" in slot_needs(group[0][1]):
            for b, c in group:
                state = f"a{c['bit']}"
                hold.append(_pick(f"{kind} = {C.ARRAY} and {state} = {K.TRUE}", b))
                error.append(_pick(f"{kind} <> {C.ARRAY} or {state} > {K.FALSE}", b))
        else:
            clean = f"({kind} = {C.ARRAY} and not bad{slot})"
            high = bool(accepted & K.ABOVE)
            hold.append(_by_threshold(f"(case when {clean} then {'hi' if high else 'lo'}{slot} end)", accepted, group, lambda c: c["lit_num"]))
            if not high:
                hold.append(_pick(f"{clean} and nul{slot}", bits))
            error.append(_pick(f"not coalesce({clean}, false)", bits))
    for slot, bits in sorted(orphans.items()):
        orphan.append(_pick(f"k{slot} = {C.NO_PARENT}", bits))
    return hold, error, orphan


def _by_threshold(value: str, accepted: int, group, literal) -> str:
    """Bits of all clauses ``value <op> literal`` of one operator, looked up in constant arrays.

    For an ordering the literals are sorted from the easiest on; the number of literals met gives the
    bits of all of them. The expression's size does not depend on how many clauses there are.
    """
    by_literal: dict = defaultdict(int)
    for bit, c in group:
        by_literal[literal(c)] |= bit
    if accepted in (K.ACCEPTED["eq"], K.ACCEPTED["ne"]):
        literals = list(by_literal)
        masks = sql_array([by_literal[x] for x in literals])
        equal = f"coalesce(get({masks}, int(array_position({sql_array(literals)}, {value})) - 1), 0L)"
        if accepted == K.ACCEPTED["eq"]:
            return equal
        return f"(case when {value} is null then 0L else {equal} ^ {sum(by_literal.values())}L end)"
    literals = sorted(by_literal, reverse=not accepted & K.ABOVE)
    met = [0]
    for x in literals:
        met.append(met[-1] | by_literal[x])
    passed = f"size(filter({sql_array(literals)}, x -> {value} {_SQL_OP[accepted]} x))"
    return f"(case when {value} is null then 0L else get({sql_array(met)}, {passed}) end)"


# --- per (event, rule) -----------------------------------------------------------------------------


def pair_code(rule: str, words: int) -> str:
    """The rule's code (see clauses.py) from the exploded struct ``rule`` and the bitmaps, as SQL."""
    branches, before = [f"when {rule}.fixed is not null then {rule}.fixed"], "0"
    for w in range(words):
        mask = f"{rule}.m{w}"
        failing = f"({mask} & ~hold{w})"
        lowest = f"({failing} & -{failing})"
        number = f"(bit_count({mask} & ({lowest} - 1)) + {before} + 1)"
        outcome = (
            f"case when {lowest} & error{w} = 0 then {K.FALSE} when {lowest} & orphan{w} <> 0 then {K.NO_PARENT_OBJECT} "
            f"else get({rule}.causes, {number} - 1) end"
        )
        branches.append(f"when {failing} <> 0 then {number} * {K.CODE_BASE} + {outcome}")
        before = f"{before} + bit_count({mask})"
    return f"case {' '.join(branches)} else 0 end"


def pair_matches(rule: str, words: int) -> str:
    """Whether every clause of the exploded rule holds, as SQL."""
    return " and ".join([f"{rule}.fixed is null", *[f"{rule}.m{w} & ~hold{w} = 0" for w in range(words)]])
