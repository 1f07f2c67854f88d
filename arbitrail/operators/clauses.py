"""Rules as data: ordered clauses, their text form, and the outcome of one clause.

A rule is a list of clauses that must all hold, read left to right. Each clause is TRUE, FALSE or
one of the error outcomes; the first clause that is not TRUE decides, so an earlier FALSE hides a
later error. ``aggregate`` over the clause array gives exactly that order; Catalyst's ``AND`` makes
no such promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbitrail.functions import cells as C
from arbitrail.schema import ERRORED, MATCHED, UNMATCHED

# Comparison operators as the set of orderings they accept: 1 below, 2 equal, 4 above.
BELOW, EQUAL, ABOVE, DIFFERENT = 1, 2, 4, 8
ACCEPTED = {"gt": ABOVE, "ge": ABOVE | EQUAL, "lt": BELOW, "le": BELOW | EQUAL, "eq": EQUAL, "ne": BELOW | ABOVE}
SYMBOL = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}
ANY_PREFIX = "any_"

COMPARE, NOT_NULL, STARTS_WITH, ANY_ITEM, PREDICATE, UNSUPPORTED, REFUSED = range(7)

# Clause outcomes. Everything from NO_PARENT_OBJECT on is an error.
TRUE, FALSE, NO_PARENT_OBJECT, NOT_COMPARABLE, NOT_A_TEXT, NOT_A_LIST, NOT_SUPPORTED, RULE_REFUSED = range(8)
CAUSES = {
    NO_PARENT_OBJECT: "the enclosing object is absent",
    NOT_COMPARABLE: "the value cannot be compared with the literal",
    NOT_A_TEXT: "the value is not a text",
    NOT_A_LIST: "the value is not a list of objects to compare",
    NOT_SUPPORTED: "the operation is not known",
    RULE_REFUSED: "RULE_REFUSED",
}

# Fields of a coded clause.
CODED = ("no", "family", "accepted", "lit_kind", "lit_int", "lit_num", "lit_str", "path", "item")

# A rule's code is 0 when it matched, else clause number * CODE_BASE + outcome.
CODE_BASE = 16
CODE_PARSE, CODE_NO_RULES = -1, -2


def clause(op: str, path: str | None = None, literal=None, item: str | None = None) -> dict:
    """One clause as a row of ``schema.CLAUSE``.

    ``op`` is gt, ge, lt, le, eq, ne, not_null, starts_with, or any_<comparison> with ``item`` naming
    the field of the list's elements.
    """
    row = {"op": op, "path": path, "item": item, "lit_kind": None, "lit_int": None, "lit_num": None, "lit_str": None}
    if isinstance(literal, bool):
        row.update(lit_kind="bool", lit_str="true" if literal else "false")
    elif isinstance(literal, int):
        row.update(lit_kind="num", lit_int=literal, lit_num=float(literal))
    elif isinstance(literal, float):
        row.update(lit_kind="num", lit_num=literal)
    elif isinstance(literal, str):
        row.update(lit_kind="text", lit_str=literal)
    return row


def rule(rule_id, description, clauses=None, active=True, predicate=None, updated_at=None) -> dict:
    """One rule as a row of ``schema.RULES``; ``expression`` is its text form."""
    row = {
        "rule_id": rule_id,
        "description": description,
        "expression": None,
        "clauses": clauses if predicate is None else None,
        "predicate": predicate,
        "active": active,
        "updated_at": updated_at,
    }
    row["expression"] = expression_text(row)
    return row


def expression_text(row: dict) -> str:
    """A rule row as readable text, e.g. ``['amount'] > 100 and ['metadata']['source'] == 'web'``."""

    def field(path: str | None) -> str:
        if not path:
            return ""
        return path if path.startswith("[") else "".join(f"['{part}']" for part in path.split("."))

    def literal(c: dict) -> str:
        if c["lit_kind"] == "text":
            return f"'{c['lit_str']}'"
        return str(next((c[k] for k in ("lit_int", "lit_num", "lit_str") if c[k] is not None), "null"))

    def one(c: dict) -> str:
        plain = c["op"].removeprefix(ANY_PREFIX)
        if c["op"] == "not_null":
            return f"{field(c['path'])} != null"
        if c["op"] == "starts_with":
            return f"{field(c['path'])}.startsWith({literal(c)})"
        if plain not in SYMBOL:
            return f"{field(c['path'])}.{c['op']}()"
        if c["op"] != plain:
            return f"{field(c['path'])}.?[{field(c['item'])} {SYMBOL[plain]} {literal(c)}].size() > 0"
        return f"{field(c['path'])} {SYMBOL[plain]} {literal(c)}"

    return row["predicate"] or " and ".join(one(c) for c in row["clauses"] or ()) or "true"


#: A path the event reader understands: names with dots between, positions and quoted names in brackets.
PATH = r"^(?:[^.\[\]]+|\[\d+\]|\['[^']*'\])(?:\.[^.\[\]]+|\[\d+\]|\['[^']*'\])*$"


def clause_code(c: Column, number: Column) -> Column:
    """The clause in the form the evaluation reads: integer family and accepted orderings.

    This is the only place where clauses are judged: whatever can't be evaluated (an unknown operation, a missing or malformed
    path, item or literal) becomes the constant error outcome here, before a plan is chosen. ``item`` is kept for list clauses.
    """
    op = F.coalesce(c["op"], F.lit(""))
    plain = F.regexp_replace(op, f"^{ANY_PREFIX}", "")
    accepted = F.element_at(F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair]), plain)
    fine = lambda path: F.coalesce(path.rlike(PATH), F.lit(False))
    number_of = F.coalesce(c["lit_num"], c["lit_int"].cast("double"))
    text = c["lit_str"].isNotNull()
    literal = F.coalesce(
        F.when(c["lit_kind"] == "num", number_of.isNotNull() & ~F.isnan(number_of)).when(c["lit_kind"].isin("text", "bool"), text), F.lit(False)
    )
    is_any = op.startswith(ANY_PREFIX)
    family = (
        F.when(~fine(c["path"]), F.lit(UNSUPPORTED))
        .when(op == "not_null", F.lit(NOT_NULL))
        .when((op == "starts_with") & (c["lit_kind"] == "text") & text, F.lit(STARTS_WITH))
        .when(accepted.isNull() | ~literal | (is_any & ~fine(c["item"])), F.lit(UNSUPPORTED))
        .otherwise(F.when(is_any, F.lit(ANY_ITEM)).otherwise(F.lit(COMPARE)))
    )
    return F.struct(
        number.cast("int").alias("no"),
        family.alias("family"),
        F.coalesce(accepted, F.lit(0)).alias("accepted"),
        F.when(c["lit_kind"] == "num", F.lit(C.INTEGER)).when(c["lit_kind"] == "bool", F.lit(C.BOOL)).otherwise(F.lit(C.TEXT)).alias("lit_kind"),
        c["lit_int"].alias("lit_int"),
        number_of.alias("lit_num"),
        c["lit_str"].alias("lit_str"),
        c["path"].alias("path"),
        F.when(family == ANY_ITEM, c["item"]).alias("item"),
    )


def _side(left: Column, right: Column) -> Column:
    return F.when(left < right, F.lit(BELOW)).when(left == right, F.lit(EQUAL)).otherwise(F.lit(ABOVE))


def _ordering(cell: Column, c: Column) -> Column:
    """Where the value lies relative to the literal; null lies below everything."""
    number = cell["kind"].isin(C.INTEGER, C.FRACTION)
    return (
        F.when(number & (c["lit_kind"] == C.INTEGER), F.when(
            cell["i"].isNotNull() & c["lit_int"].isNotNull(), _side(cell["i"], c["lit_int"])
        ).otherwise(_side(F.coalesce(cell["d"], cell["i"].cast("double")), c["lit_num"])))
        .when(cell["kind"] == C.NULL, F.lit(BELOW))
        .when(cell["kind"] == c["lit_kind"], _side(cell["s"], c["lit_str"]))
        .otherwise(F.lit(DIFFERENT))
    )


def _compared(cell: Column, c: Column) -> Column:
    accepted = c["accepted"]

    def decide(order):
        return (
            F.when(accepted.bitwiseAND(order) != 0, F.lit(TRUE))
            .when(order != DIFFERENT, F.lit(FALSE))
            .when(cell["kind"] == C.NO_PARENT, F.lit(NO_PARENT_OBJECT))
            .when(accepted == ACCEPTED["eq"], F.lit(FALSE))
            .when(accepted == ACCEPTED["ne"], F.lit(TRUE))
            .otherwise(F.lit(NOT_COMPARABLE))
        )

    return C.bind(_ordering(cell, c), decide)


def any_item(items: Column, c: Column) -> Column:
    """Whether some element's field satisfies the clause; one element in error spoils the list."""
    states = F.transform(items, lambda e: _compared(e, c))
    return C.bind(
        states,
        lambda s: F.when(F.exists(s, lambda x: x > FALSE), F.lit(NOT_A_LIST))
        .when(F.array_contains(s, TRUE), F.lit(TRUE))
        .otherwise(F.lit(FALSE)),
    )


def clause_outcome(c: Column, cells: Column, predicates: Column) -> Column:
    """TRUE, FALSE or an error outcome of one coded clause for one event."""
    cell = F.get(cells, c["slot"])
    missing = cell["kind"] == C.NO_PARENT
    return (
        F.when(c["family"] == COMPARE, _compared(cell, c))
        .when(c["family"] == PREDICATE, F.get(predicates, c["slot"]))
        .when(c["family"] == UNSUPPORTED, F.lit(NOT_SUPPORTED))
        .when(c["family"] == REFUSED, F.lit(RULE_REFUSED))
        .when(missing, F.lit(NO_PARENT_OBJECT))
        .when(c["family"] == NOT_NULL, F.when(cell["kind"] == C.NULL, F.lit(FALSE)).otherwise(F.lit(TRUE)))
        .when(
            c["family"] == STARTS_WITH,
            F.when(cell["kind"] != C.TEXT, F.lit(NOT_A_TEXT)).when(cell["s"].startswith(c["lit_str"]), F.lit(TRUE)).otherwise(F.lit(FALSE)),
        )
        .otherwise(F.when(cell["kind"] != C.ARRAY, F.lit(NOT_A_LIST)).otherwise(any_item(cell["items"], c)))
    )


def rule_code(clauses: Column, cells: Column, predicates: Column) -> Column:
    """0 when every clause holds, else number and outcome of the first that does not."""
    return F.aggregate(
        clauses,
        F.lit(0),
        lambda acc, c: F.when(acc != 0, acc).otherwise(
            C.bind(clause_outcome(c, cells, predicates), lambda o: F.when(o == TRUE, F.lit(0)).otherwise(c["no"] * CODE_BASE + o))
        ),
    )


def audit_type_of(code: Column) -> Column:
    return (
        F.when(code == 0, F.lit(MATCHED))
        .when((code == CODE_NO_RULES) | ((code > 0) & (code % CODE_BASE == FALSE)), F.lit(UNMATCHED))
        .otherwise(F.lit(ERRORED))
    )


def failed_clause_of(code: Column) -> Column:
    return F.when(code > 0, F.floor(code / CODE_BASE).cast("int"))


def error_text(code: Column, paths: Column) -> Column:
    """``CLAUSE_ERROR <no> <path>: <cause>`` or the refusal mark."""
    causes = F.create_map(*[x for k, v in CAUSES.items() for x in (F.lit(k), F.lit(v))])
    number = failed_clause_of(code)
    cause = F.element_at(causes, code % CODE_BASE)
    path = F.coalesce(F.get(paths, number - 1), F.lit(""))
    return F.when(code % CODE_BASE == RULE_REFUSED, cause).otherwise(
        F.concat(F.lit("CLAUSE_ERROR "), number.cast("string"), F.lit(" "), path, F.lit(": "), cause)
    )
