"""Row-by-row evaluation in plain Python, to compare the Spark plans with."""

import json
import operator

from arbitrail.operators import clauses as K

OPS = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "eq": operator.eq, "ne": operator.ne}


def literal(c):
    if c["lit_kind"] == "num":
        return c["lit_int"] if c["lit_int"] is not None else c["lit_num"]
    return c["lit_str"] == "true" if c["lit_kind"] == "bool" else c["lit_str"]


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return "num" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "other"


def compare(op, value, c):
    lit = literal(c)
    if value is None:
        return K.TRUE if op in ("lt", "le", "ne") else K.FALSE
    if kind(value) != c["lit_kind"]:
        return {"eq": K.FALSE, "ne": K.TRUE}.get(op, K.NOT_COMPARABLE)
    if isinstance(value, float) or isinstance(lit, float):
        value, lit = float(value), float(lit)
    return K.TRUE if OPS[op](value, lit) else K.FALSE


def state(c, root):
    op = c["op"]
    plain = op.removeprefix("any_")
    if op == "refused":
        return K.RULE_REFUSED
    known = op == "not_null" or (op == "starts_with" and c["lit_kind"] == "text") or (plain in OPS and c["lit_kind"])
    if not known or (op != plain and not c["item"]):
        return K.NOT_SUPPORTED
    *parents, last = c["path"].split(".")
    holder = root
    for p in parents:
        holder = holder.get(p) if isinstance(holder, dict) else None
    if not isinstance(holder, dict):
        return K.NO_PARENT_OBJECT
    value = holder.get(last)
    if op == "not_null":
        return K.FALSE if value is None else K.TRUE
    if op == "starts_with":
        return K.NOT_A_TEXT if not isinstance(value, str) else K.TRUE if value.startswith(c["lit_str"]) else K.FALSE
    if op == plain:
        return compare(op, value, c)
    if not isinstance(value, list):
        return K.NOT_A_LIST
    found = [compare(plain, e.get(c["item"]), c) if isinstance(e, dict) else K.NO_PARENT_OBJECT for e in value]
    return K.NOT_A_LIST if any(s > K.FALSE for s in found) else K.TRUE if K.TRUE in found else K.FALSE


def code(rule, root):
    for number, c in enumerate(rule["clauses"], 1):
        s = state(c, root)
        if s != K.TRUE:
            return number * K.CODE_BASE + s
    return 0


def parse(text):
    try:
        root, _ = json.JSONDecoder().raw_decode(text.lstrip())
    except (ValueError, AttributeError):
        return None
    return root if isinstance(root, dict) else None


def evaluate(text, rules):
    root = parse(text)
    if root is None:
        return {"_parse": K.CODE_PARSE}
    return {r["rule_id"]: code(r, root) for r in rules if r["active"]}
