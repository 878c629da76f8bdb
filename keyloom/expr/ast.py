"""Trees both languages share: paths, literals, predicates, update clauses."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from decimal import Decimal

from keyloom.errors import ValidationError
from keyloom.functions.tagged import TAGS


@dataclass(frozen=True)
class Path:
    """``a.b[0]``: attribute names and list positions, a name first."""

    parts: tuple[str | int, ...]

    @property
    def top(self) -> str:
        return str(self.parts[0])

    def overlaps(self, other: Path) -> bool:
        n = min(len(self.parts), len(other.parts))
        return self.parts[:n] == other.parts[:n]

    def conflicts(self, other: Path) -> bool:
        """Whether one treats a node as a map that the other treats as a list."""
        for a, b in zip(self.parts, other.parts):
            if a != b:
                return isinstance(a, int) != isinstance(b, int)
        return False

    def __str__(self) -> str:
        return "".join(f"[{p}]" if isinstance(p, int) else (f".{p}" if i else p) for i, p in enumerate(self.parts))


@dataclass(frozen=True)
class Literal:
    """A tagged value: S str, N str, B bytes, BOOL bool, NULL True, sets tuples, L tuple of literals, M tuple of (name, literal)."""

    tag: str
    value: object


@dataclass(frozen=True)
class Size:
    path: Path


Operand = Path | Literal | Size


@dataclass(frozen=True)
class Compare:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Between:
    value: Operand
    low: Operand
    high: Operand


@dataclass(frozen=True)
class In:
    value: Operand
    options: tuple[Operand, ...]


@dataclass(frozen=True)
class Exists:
    path: Path
    wanted: bool


@dataclass(frozen=True)
class TypeIs:
    path: Path
    tag: str


@dataclass(frozen=True)
class BeginsWith:
    value: Operand
    prefix: Operand


@dataclass(frozen=True)
class Contains:
    value: Operand
    part: Operand


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class IfNotExists:
    path: Path
    default: object


@dataclass(frozen=True)
class ListAppend:
    first: object
    second: object


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Update:
    """Clauses of an update, applied SET, REMOVE, ADD, DELETE."""

    sets: tuple[tuple[Path, object], ...] = ()
    removes: tuple[Path, ...] = ()
    adds: tuple[tuple[Path, Literal], ...] = ()
    deletes: tuple[tuple[Path, Literal], ...] = ()

    @property
    def paths(self) -> list[Path]:
        return [*(p for p, _ in self.sets), *self.removes, *(p for p, _ in self.adds), *(p for p, _ in self.deletes)]


def literal(value: object) -> Literal:
    """A literal from a Python value or a tagged object ``{"S": "x"}``."""
    if isinstance(value, Literal):
        return value
    if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in TAGS:
        (tag, x), = value.items()
        if tag == "L":
            return Literal("L", tuple(literal(v) for v in x))
        if tag == "M":
            return Literal("M", tuple(sorted((k, literal(v)) for k, v in x.items())))
        if tag in ("SS", "NS", "BS"):
            if not x or len(set(x)) < len(x):
                raise ValidationError("a set is empty or repeats a member")
            return Literal(tag, tuple(base64.b64decode(v) if tag == "BS" and isinstance(v, str) else v if tag == "BS" else str(v) for v in x))
        if tag == "B" and isinstance(x, str):
            x = base64.b64decode(x)
        return Literal(tag, str(x) if tag in ("S", "N") else x)
    if value is None:
        return Literal("NULL", True)
    if isinstance(value, bool):
        return Literal("BOOL", value)
    if isinstance(value, (int, float, Decimal)):
        return Literal("N", format(Decimal(repr(value)) if isinstance(value, float) else Decimal(value), "f"))
    if isinstance(value, (bytes, bytearray)):
        return Literal("B", bytes(value))
    if isinstance(value, str):
        return Literal("S", value)
    if isinstance(value, (set, frozenset)):
        members = sorted(value)
        if not members:
            raise ValidationError("a set is empty")
        tag = "BS" if isinstance(members[0], bytes) else "SS" if isinstance(members[0], str) else "NS"
        return Literal(tag, tuple(m if tag != "NS" else str(m) for m in members))
    if isinstance(value, (list, tuple)):
        return Literal("L", tuple(literal(v) for v in value))
    if isinstance(value, dict):
        return Literal("M", tuple(sorted((k, literal(v)) for k, v in value.items())))
    return Literal("T", value)  # a native date or time of the typed plane


def plain(value: Literal) -> object:
    """The Python value of a literal; numbers as Decimal."""
    if value.tag == "N":
        return Decimal(value.value)
    if value.tag == "NULL":
        return None
    if value.tag == "L":
        return [plain(v) for v in value.value]
    if value.tag == "M":
        return {k: plain(v) for k, v in value.value}
    if value.tag == "NS":
        return [Decimal(v) for v in value.value]
    if value.tag in ("SS", "BS"):
        return list(value.value)
    return value.value


def walk(node: object):
    """All nodes of a predicate, depth first."""
    yield node
    for name in getattr(node, "__dataclass_fields__", ()):
        part = getattr(node, name)
        for p in part if isinstance(part, tuple) else (part,):
            if hasattr(p, "__dataclass_fields__"):
                yield from walk(p)


def paths(node: object) -> list[Path]:
    """The paths a predicate names."""
    return [n for n in walk(node) if isinstance(n, Path)]
