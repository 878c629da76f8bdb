"""Predicates on one tagged item in plain Python: the yardstick the column compiler is tested against."""

from __future__ import annotations

import base64
from decimal import Decimal

from keyloom.expr.ast import And, BeginsWith, Between, Compare, Contains, Exists, In, Literal, Not, Or, Path, Size, TypeIs, literal

_SETS = ("SS", "NS", "BS")


def lookup(item: dict, path: Path) -> Literal | None:
    """The literal at a path of a tagged item, None if missing."""
    node: object = {"M": item}
    for part in path.parts:
        if isinstance(part, int):
            if not isinstance(node, dict) or "L" not in node or part >= len(node["L"]):
                return None
            node = node["L"][part]
        else:
            if not isinstance(node, dict) or "M" not in node or part not in node["M"]:
                return None
            node = node["M"][part]
    return literal(node)


def _key(x: Literal):
    return Decimal(x.value) if x.tag == "N" else x.value.encode() if x.tag == "S" else x.value


def equal(a: Literal, b: Literal) -> bool:
    if a.tag != b.tag:
        return False
    if a.tag == "N":
        return Decimal(a.value) == Decimal(b.value)
    if a.tag == "NS":
        return {Decimal(x) for x in a.value} == {Decimal(x) for x in b.value}
    if a.tag in _SETS:
        return set(a.value) == set(b.value)
    if a.tag == "L":
        return len(a.value) == len(b.value) and all(map(equal, a.value, b.value))
    if a.tag == "M":
        x, y = dict(a.value), dict(b.value)
        return x.keys() == y.keys() and all(equal(v, y[k]) for k, v in x.items())
    return a.value == b.value


def compare(op: str, a: Literal, b: Literal) -> bool:
    if a.tag != b.tag:
        return op == "<>"
    if op in ("=", "<>"):
        return equal(a, b) == (op == "=")
    if a.tag not in ("S", "N", "B"):
        return False
    x, y = _key(a), _key(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def size(x: Literal) -> int | None:
    if x.tag == "S":
        return len(x.value.encode("utf-16-be")) // 2
    if x.tag == "B" or x.tag in _SETS or x.tag in ("L", "M"):
        return len(x.value)
    return None


def evaluate(node: object, item: dict, dialect: str = "condition") -> bool:
    """Two-valued truth of a predicate; the statement dialect treats missing operands and CONTAINS by its own rules."""

    def value(operand):
        if isinstance(operand, Literal):
            return operand
        if isinstance(operand, Size):
            x = lookup(item, operand.path)
            n = None if x is None else size(x)
            return None if n is None else Literal("N", str(n))
        return lookup(item, operand)

    statement = dialect == "statement"
    if isinstance(node, And):
        return all(evaluate(p, item, dialect) for p in node.parts)
    if isinstance(node, Or):
        return any(evaluate(p, item, dialect) for p in node.parts)
    if isinstance(node, Not):
        return not evaluate(node.part, item, dialect)
    if isinstance(node, Exists):
        return (lookup(item, node.path) is not None) == node.wanted
    if isinstance(node, TypeIs):
        x = lookup(item, node.path)
        return x is not None and x.tag == node.tag
    if isinstance(node, Compare):
        a, b = value(node.left), value(node.right)
        if a is None or b is None:
            return node.op == "<>" and not statement
        return compare(node.op, a, b)
    if isinstance(node, Between):
        x, low, high = value(node.value), value(node.low), value(node.high)
        return None not in (x, low, high) and compare(">=", x, low) and compare("<=", x, high)
    if isinstance(node, In):
        x = value(node.value)
        return x is not None and any((y := value(o)) is not None and equal(x, y) for o in node.options)
    if isinstance(node, BeginsWith):
        x, y = value(node.value), value(node.prefix)
        return None not in (x, y) and x.tag == y.tag and x.tag in (("S",) if statement else ("S", "B")) and x.value.startswith(y.value)
    if isinstance(node, Contains):
        x, y = value(node.value), value(node.part)
        if x is None or y is None:
            return False
        if x.tag in ("S", "B") and x.tag == y.tag:
            return y.value in x.value and not (statement and x.tag == "B")
        if x.tag in _SETS and y.tag == x.tag[0]:
            if x.tag == "NS":
                return Decimal(y.value) in {Decimal(v) for v in x.value}
            return y.value in x.value and not (statement and x.tag == "BS")
        if x.tag == "L":
            return y in x.value if statement else any(equal(v, y) for v in x.value)
        return False
    raise TypeError(node)


def as_json(x: Literal) -> dict:
    """The tagged object of a literal."""
    if x.tag == "L":
        return {"L": [as_json(v) for v in x.value]}
    if x.tag == "M":
        return {"M": {k: as_json(v) for k, v in x.value}}
    if x.tag == "B":
        return {"B": base64.b64encode(x.value).decode()}
    if x.tag == "BS":
        return {"BS": [base64.b64encode(v).decode() for v in x.value]}
    if x.tag in ("SS", "NS"):
        return {x.tag: list(x.value)}
    return {x.tag: x.value}
