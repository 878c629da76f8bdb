"""Predicate trees to columns.

The languages are two-valued, SQL is three-valued. ``Compiler`` moves NOT down to the leaves: an even number of negations
leaves a leaf bare, which is enough, since a filter treats NULL like FALSE and AND and OR keep that order; an odd
number makes it ``leaf IS NULL OR NOT leaf``. Both forms are pushed down to a Parquet scan, which
``coalesce(leaf, false)`` is not. A value that is selected instead of filtered on is closed as a whole.

Two planes give columns to paths. The typed plane has native columns, NULL meaning missing. The document plane has one
VARIANT column of tagged JSON, so that missing, NULL-tagged and other-typed values stay apart.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ValidationError
from keyloom.expr.ast import And, BeginsWith, Between, Compare, Contains, Exists, In, Literal, Not, Or, Path, Size, TypeIs, plain
from keyloom.expr.interpret import as_json
from keyloom.functions.numbers import number_sort_key, sort_key_text
from keyloom.functions.tagged import dumps, parse_object

_SETS = ("SS", "NS", "BS")
_SHORT = re.compile(r"^-?[0-9]{1,8}([.][0-9]{1,6})?$")
_PLAIN = re.compile(r"^(0|-?[1-9][0-9]{0,36})$")
_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def no() -> Column:
    return F.lit(False)


def yes() -> Column:
    return F.lit(True)


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16, which is what size() counts in strings."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def tag_of(kind: T.DataType) -> str:
    """The tag a native type stands for; 'T' for dates and times, which only compare with their like."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "S"
    if isinstance(kind, T.NumericType):
        return "N"
    if isinstance(kind, T.BinaryType):
        return "B"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, T.ArrayType):
        return "L"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "M"
    return "T"


def native(value: Literal, like: T.DataType | None = None) -> Column:
    """A literal as a column, of the type of the column it meets where that loses nothing, so that filters are pushed down."""
    x = plain(value)
    if value.tag == "N":
        if isinstance(like, T.IntegralType) and x == x.to_integral_value() and abs(x) < 1 << 63:
            return F.lit(int(x))
        if isinstance(like, (T.DoubleType, T.FloatType)):
            return F.lit(float(x))
        if like is None and x == x.to_integral_value() and abs(x) < 1 << 63:
            return F.lit(int(x))
        return F.lit(x) if len(x.as_tuple().digits) <= 38 and -38 <= x.as_tuple().exponent <= 0 else F.lit(float(x))
    if value.tag in ("L", *_SETS):
        of = like.elementType if isinstance(like, T.ArrayType) else None
        inner = [native(v, of) for v in value.value] if value.tag == "L" else [native(Literal(value.tag[0], v), of) for v in value.value]
        column = F.array(*inner)
        return column.cast(like) if isinstance(like, T.ArrayType) else column
    if value.tag == "M":
        fields = dict(value.value)
        if isinstance(like, T.StructType):
            return F.struct(*((native(fields[f.name], f.dataType).cast(f.dataType) if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.fields))
        if isinstance(like, T.MapType):
            return F.create_map(*(c for k, v in fields.items() for c in (F.lit(k), native(v, like.valueType)))).cast(like)
        return F.struct(*(native(v).alias(k) for k, v in fields.items()))
    if value.tag == "NULL":
        return F.lit(None)
    return F.lit(x)


class Typed:
    """Native columns; SQL NULL is missing. ``columns`` may override a top attribute with another column."""

    def __init__(self, schema: T.StructType, columns: dict[str, Column] | None = None) -> None:
        self.schema, self.columns = schema, columns or {}

    def resolve(self, path: Path) -> tuple[Column, T.DataType] | None:
        """Column and type at a path; None where the schema has no such place, which means missing everywhere."""
        top = next((f for f in self.schema.fields if f.name == path.top), None)
        if top is None:
            return None
        column, kind = self.columns.get(path.top, F.col(f"`{path.top}`")), top.dataType
        for part in path.parts[1:]:
            if isinstance(part, int):
                if not isinstance(kind, T.ArrayType):
                    return None
                column, kind = F.get(column, F.lit(part)), kind.elementType
            elif isinstance(kind, T.StructType):
                inner = next((f for f in kind.fields if f.name == part), None)
                if inner is None:
                    return None
                column, kind = column.getField(part), inner.dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
            else:
                return None
        return column, kind

    def present(self, path: Path) -> Column | None:
        found = self.resolve(path)
        return None if found is None else found[0].isNotNull()

    def tag_is(self, path: Path, tag: str) -> Column:
        found = self.resolve(path)
        return no() if found is None or tag_of(found[1]) != tag else found[0].isNotNull()

    def _side(self, operand, other=None) -> tuple[Column, str, T.DataType | None] | None:
        if isinstance(operand, Literal):
            like = None
            if isinstance(other, Path) and (found := self.resolve(other)):
                like = found[1]
            return native(operand, like if like is not None and self._same(tag_of(like), operand.tag) else None), operand.tag, like
        if isinstance(operand, Size):
            n = self.size(operand.path)
            return None if n is None else (n, "N", T.IntegerType())
        found = self.resolve(operand)
        return None if found is None else (found[0], tag_of(found[1]), found[1])

    @staticmethod
    def _same(a: str, b: str) -> bool:
        return a == b or {a, b} <= {"L", *_SETS} and not (a in _SETS and b in _SETS)

    def compare(self, op: str, left, right) -> tuple[Column | None, Column]:
        """The comparison (NULL if an operand is missing; None if it always is) and whether both operands are present."""
        a, b = self._side(left, right), self._side(right, left)
        if a is None or b is None:
            return None, no()
        both = a[0].isNotNull() & b[0].isNotNull()
        if not self._same(a[1], b[1]):
            return F.when(both, F.lit(op == "<>")), both
        if op not in ("=", "<>") and a[1] not in ("S", "N", "B", "T"):
            return F.when(both, no()), both
        x, y = a[0], b[0]
        if isinstance(left, Literal) and left.tag in _SETS or isinstance(right, Literal) and right.tag in _SETS:
            x, y = F.array_sort(x), F.array_sort(y)
        if isinstance(a[2], T.MapType) or isinstance(b[2], T.MapType):
            x, y = F.array_sort(F.map_entries(x)), F.array_sort(F.map_entries(y))
        return _OPS[op](x, y), both

    def begins_with(self, value, prefix, only_text: bool) -> Column | None:
        a, b = self._side(value), self._side(prefix)
        if a is None or b is None:
            return None
        if a[1] != b[1] or a[1] not in (("S",) if only_text else ("S", "B")):
            return no()
        return a[0].startswith(plain(prefix)) if isinstance(prefix, Literal) and a[1] == "S" else F.startswith(a[0], b[0])

    def contains(self, value, part, statement: bool) -> Column | None:
        a, b = self._side(value), self._side(part)
        if a is None or b is None:
            return None
        if a[1] == "S" and b[1] == "S":
            return a[0].contains(plain(part)) if isinstance(part, Literal) else F.contains(a[0], b[0])
        if a[1] == "B" and b[1] == "B":
            return no() if statement else F.contains(a[0], b[0])
        if a[1] == "L" and isinstance(a[2], T.ArrayType):
            if not self._same(tag_of(a[2].elementType), b[1]):
                return F.when(a[0].isNotNull() & b[0].isNotNull(), no())
            needle = native(part, a[2].elementType) if isinstance(part, Literal) else b[0]
            if isinstance(a[2].elementType, T.MapType):
                return F.exists(a[0], lambda e: F.array_sort(F.map_entries(e)) == F.array_sort(F.map_entries(needle)))
            return F.when(a[0].isNotNull(), F.coalesce(F.array_contains(a[0], needle.cast(a[2].elementType)), no()))
        return no()

    def size(self, path: Path) -> Column | None:
        found = self.resolve(path)
        if found is None:
            return None
        column, kind = found
        tag = tag_of(kind)
        if tag == "S":
            return utf16_length(column)
        if tag == "B":
            return F.octet_length(column)
        if tag == "L" or isinstance(kind, T.MapType):
            return F.when(column.isNotNull(), F.size(column))
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), sum((F.when(column.getField(f.name).isNotNull(), 1).otherwise(0) for f in kind.fields), F.lit(0)))
        return None


class Document:
    """One VARIANT column of tagged JSON (``{"a": {"N": "1"}}``), canonical since its ingest: numbers plain, sets in order."""

    def __init__(self, doc: Column | str = "doc") -> None:
        self.doc = F.col(doc) if isinstance(doc, str) else doc

    def _at(self, path: Path, tag: str = "") -> str:
        out, inside = "$", ""
        for part in path.parts:
            step = f"[{part}]" if isinstance(part, int) else "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
            out += inside and (".L" if isinstance(part, int) else ".M")
            out += step
            inside = "yes"
        return out + (f".{tag}" if tag else "")

    def text(self, path: Path, tag: str) -> Column:
        """The content under a tag as text, NULL if it isn't there."""
        return F.try_variant_get(self.doc, self._at(path, tag), "string")

    def _node(self, path: Path, tag: str = "") -> Column:
        return F.try_variant_get(self.doc, self._at(path, tag), "variant")

    def present(self, path: Path) -> Column:
        return self._node(path).isNotNull()

    def tag_is(self, path: Path, tag: str) -> Column:
        return self._node(path, tag).isNotNull()

    def _canonical(self, path: Path) -> Column:
        return F.to_json(self._node(path))

    def _comparable(self, operand, tag: str) -> Column:
        """The operand's content under ``tag`` in a form whose order is the order of values."""
        if isinstance(operand, Literal):
            if operand.tag != tag:
                return F.lit(None)
            if tag == "N":
                return F.lit(sort_key_text(operand.value))
            return F.lit(str(operand.value).lower()) if tag in ("BOOL", "NULL") else F.lit(operand.value)
        if isinstance(operand, Size):
            return number_sort_key(self.size(operand.path).cast("string")) if tag == "N" else F.lit(None)
        text = self.text(operand, tag)
        return number_sort_key(text) if tag == "N" else F.unbase64(text) if tag == "B" else text

    def _is_present(self, operand) -> Column:
        if isinstance(operand, Literal):
            return yes()
        return self.size(operand.path).isNotNull() if isinstance(operand, Size) else self.present(operand)

    def _canonical_of(self, operand) -> Column:
        if isinstance(operand, Literal):
            return F.lit(canonical_json(operand))
        if isinstance(operand, Size):
            return F.when(self.size(operand.path).isNotNull(), F.concat(F.lit('{"N":"'), self.size(operand.path).cast("string"), F.lit('"}')))
        return self._canonical(operand)

    def compare(self, op: str, left, right) -> tuple[Column, Column]:
        both = self._is_present(left) & self._is_present(right)
        tags = {x.tag for x in (left, right) if isinstance(x, Literal)} | {"N" for x in (left, right) if isinstance(x, Size)}
        scalar = len(tags) == 1 and tags <= {"S", "N", "B", "BOOL", "NULL"}
        if op in ("=", "<>"):
            if scalar:  # by the content under the tag, so that these need no canonical documents
                same = F.coalesce(self._test("=", left, right, *tags), no())
            else:
                same = self._canonical_of(left) == self._canonical_of(right)
            return F.when(both, same if op == "=" else ~same), both
        if len(tags) > 1:
            return F.when(both, no()), both
        any_of = no()
        for tag in ("S", "N", "B"):
            if not tags or tag in tags:
                any_of = any_of | F.coalesce(self._test(op, left, right, tag), no())
        return F.when(both, any_of), both

    def _test(self, op: str, left, right, tag: str) -> Column:
        """The comparison under one tag, NULL unless both sides have it; short numbers as doubles, others by their order text."""
        exact = _OPS[op](self._comparable(left, tag), self._comparable(right, tag))
        path, value = (left, right) if isinstance(left, Path) else (right, left)
        if tag != "N" or not isinstance(path, Path) or not isinstance(value, Literal) or value.tag != "N" or not _SHORT.match(value.value):
            return exact
        text, number = self.text(path, "N"), F.lit(float(value.value))
        short = _OPS[op](text.try_cast("double"), number) if path is left else _OPS[op](number, text.try_cast("double"))
        return F.when(text.rlike(_SHORT.pattern), short).otherwise(exact)

    def begins_with(self, value, prefix, only_text: bool) -> Column:
        out = no()
        for tag in ("S",) if only_text else ("S", "B"):
            out = out | F.coalesce(F.startswith(self._comparable(value, tag), self._comparable(prefix, tag)), no())
        return out

    def contains(self, value, part, statement: bool) -> Column:
        out = no()
        for tag in ("S",) if statement else ("S", "B"):
            out = out | F.coalesce(F.contains(self._comparable(value, tag), self._comparable(part, tag)), no())
        if not isinstance(value, Path):
            return out
        for tag in ("SS", "NS") if statement else _SETS:
            members = F.try_variant_get(self.doc, self._at(value, tag), "array<string>")
            one = F.lit(self._member(part)) if isinstance(part, Literal) and part.tag == tag[0] else self.text(part, tag[0]) if isinstance(part, Path) else None
            if one is not None:
                out = out | F.coalesce(F.array_contains(members, one), no())
        items = F.try_variant_get(self.doc, self._at(value, "L"), "array<variant>")
        return out | F.coalesce(F.exists(items, lambda e: F.to_json(e) == self._canonical_of(part)), no())

    @staticmethod
    def _member(x: Literal) -> str:
        return json.loads(canonical_json(x))[x.tag]

    def size(self, path: Path) -> Column:
        sets = [F.size(F.try_variant_get(self.doc, self._at(path, t), "array<variant>")) for t in ("SS", "NS", "BS", "L")]
        return F.coalesce(
            utf16_length(self.text(path, "S")),
            F.octet_length(F.unbase64(self.text(path, "B"))),
            *(F.when(n >= 0, n) for n in sets),
            F.size(F.map_keys(F.try_variant_get(self.doc, self._at(path, "M"), "map<string,variant>"))),
        )


def canonical_json(value: Literal) -> str:
    """The canonical JSON text of a literal: plain numbers, sets in order, keys in order."""

    def canonical(x: Literal) -> Literal:
        if x.tag == "N":
            return Literal("N", plain_number(x.value))
        if x.tag in _SETS:
            return Literal(x.tag, tuple(sorted({plain_number(v) if x.tag == "NS" else v for v in x.value})))
        if x.tag == "L":
            return Literal("L", tuple(canonical(v) for v in x.value))
        if x.tag == "M":
            return Literal("M", tuple((k, canonical(v)) for k, v in x.value))
        return x

    return json.dumps(as_json(canonical(value)), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def plain_number(text: str) -> str:
    """The one plain spelling of a number's text."""
    d = Decimal(text)
    if not d:
        return "0"
    out = format(d, "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


class Compiler:
    """Trees to columns in one plane and dialect ('condition' or 'statement')."""

    def __init__(self, plane: Typed | Document, dialect: str = "condition") -> None:
        self.plane, self.statement = plane, dialect == "statement"

    def filter(self, node) -> Column:
        """For WHERE: TRUE where the predicate holds, else FALSE or NULL."""
        return self._compile(node, False)

    def value(self, node) -> Column:
        """For SELECT, counts and write conditions: TRUE or FALSE, never NULL."""
        return F.coalesce(self._compile(node, False), no())

    def _compile(self, node, negated: bool) -> Column:
        """The column of a node, or of its negation: NOT is moved down to the leaves."""
        if isinstance(node, (And, Or)):
            parts = [self._compile(p, negated) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node, And) != negated else out | p
            return out
        if isinstance(node, Not):
            return self._compile(node.part, not negated)
        leaf, closed = self._leaf(node)
        if not negated:
            return leaf
        if closed:
            return ~leaf
        subject = self._subject(node)
        # spelled by the attribute where one alone can be missing, so that it is pushed down
        return (leaf.isNull() if subject is None else ~self.plane.present(subject)) | ~leaf

    def _subject(self, node) -> Path | None:
        """The only path of a leaf on native columns, all its other operands being literals."""
        if not isinstance(self.plane, Typed):
            return None
        operands = {Compare: lambda: (node.left, node.right), Between: lambda: (node.value, node.low, node.high), BeginsWith: lambda: (node.value, node.prefix), Contains: lambda: (node.value, node.part), In: lambda: (node.value, *node.options)}[type(node)]()
        found = [o for o in operands if not isinstance(o, Literal)]
        return found[0] if len(found) == 1 and isinstance(found[0], Path) else None

    def _leaf(self, node) -> tuple[Column, bool]:
        """The leaf and whether it is never NULL."""
        plane = self.plane
        if isinstance(node, Exists):
            present = plane.present(node.path)
            if present is None:
                return F.lit(not node.wanted), True
            return (present if node.wanted else ~present), True
        if isinstance(node, TypeIs):
            return plane.tag_is(node.path, node.tag), True
        if isinstance(node, Compare):
            test, _ = plane.compare(node.op, node.left, node.right)
            missing_is = node.op == "<>" and not self.statement
            if test is None:
                return F.lit(missing_is), True
            return (F.coalesce(test, yes()), True) if missing_is else (test, False)
        if isinstance(node, Between):
            low, _ = plane.compare(">=", node.value, node.low)
            high, _ = plane.compare("<=", node.value, node.high)
            return (no(), True) if low is None or high is None else (low & high, False)
        if isinstance(node, In):
            return self._in(node)
        if isinstance(node, BeginsWith):
            test = plane.begins_with(node.value, node.prefix, self.statement)
        elif isinstance(node, Contains):
            test = plane.contains(node.value, node.part, self.statement)
        else:
            raise ValidationError(f"not a predicate: {node}")
        return (no(), True) if test is None else (test, False)

    def _in(self, node: In) -> tuple[Column, bool]:
        plane = self.plane
        if isinstance(plane, Typed) and isinstance(node.value, Path) and all(isinstance(o, Literal) and o.tag in ("S", "N", "B", "BOOL", "T") for o in node.options):
            found = plane.resolve(node.value)
            if found is None:
                return no(), True
            fitting = [native(o, found[1]) for o in node.options if o.tag == tag_of(found[1])]
            return (found[0].isin(*fitting), False) if fitting else (no(), True)
        out = no()
        for option in node.options:
            test, _ = plane.compare("=", node.value, option)
            if test is not None:
                out = out | F.coalesce(test, no())
        return out, True


def canonical_document(text: Column) -> Column:
    """The VARIANT of a tagged item's JSON text, numbers plain and sets in order; damaged and non-object text gives NULL."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical_item)

    return F.try_parse_json(canonical.asNondeterministic()(text))  # so that it is computed once, however often the plan names it


def _canonical_value(value: dict) -> dict:
    (tag, content), = value.items()
    if tag == "N":
        return {"N": content if _PLAIN.match(content) else plain_number(content)}
    if tag in ("SS", "BS"):
        return {tag: sorted(set(content))}
    if tag == "NS":
        return {tag: sorted({plain_number(v) for v in content})}
    if tag == "L":
        return {"L": [_canonical_value(v) for v in content]}
    if tag == "M":
        return {"M": {k: _canonical_value(v) for k, v in content.items()}}
    return value


def _canonical_item(text: str | None) -> str | None:
    item = parse_object(text)
    if item is None:
        return None
    try:
        return dumps({k: _canonical_value(v) for k, v in item.items()})
    except (ArithmeticError, ValueError, TypeError, AttributeError):
        return None
