"""Projections and updates of native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ValidationError
from keyloom.expr.ast import Arithmetic, IfNotExists, ListAppend, Literal, Path, Update, literal
from keyloom.expr.compile import Typed, native, tag_of
from keyloom.model import TableDef


def project(df: DataFrame, paths: list[Path], nest: bool = True) -> DataFrame:
    """The parts of rows at ``paths``, nested back under their attributes in the order attributes are first named.

    Missing paths are NULL; elements of one list come out compacted in order of their positions; paths into the same
    element are merged. Keys aren't added. With ``nest`` false every path is a column named by its text.
    """
    plane = Typed(df.schema)
    if not nest:
        return df.select(*((found[0] if (found := plane.resolve(p)) else F.lit(None).cast("string")).alias(str(p)) for p in paths))
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.parts:
            node = node.setdefault(part, {})
    fields = {f.name: f for f in df.schema.fields}
    return df.select(*(_rebuild(F.col(f"`{top}`"), fields[top].dataType, below).alias(top) if top in fields else F.lit(None).cast("string").alias(top) for top, below in tree.items()))


def _rebuild(column: Column, kind: T.DataType, tree: dict) -> Column:
    if not tree:
        return column
    if isinstance(kind, T.StructType) and all(isinstance(k, str) for k in tree):
        inner = {f.name: f.dataType for f in kind.fields}
        parts = [_rebuild(column.getField(k), inner[k], sub).alias(k) for k, sub in tree.items() if k in inner]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast("string")
    if isinstance(kind, T.MapType) and all(isinstance(k, str) for k in tree):
        kept = F.map_filter(column, lambda k, _: k.isin(*tree))
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.ArrayType) and all(isinstance(k, int) for k in tree):
        parts = [_rebuild(F.get(column, F.lit(i)), kind.elementType, tree[i]) for i in sorted(tree)]
        kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return F.lit(None).cast("string")


class Updater:
    """Applies update clauses to native columns; every right side reads the row before the update."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema
        self.fields = {f.name: f.dataType for f in schema.fields}

    def _type(self, path: Path) -> T.DataType:
        found = Typed(self.schema).resolve(path)
        if found is None:
            raise ValidationError(f"the typed plane has no column for {path}; declare it first")
        return found[1]

    def value(self, term, plane: Typed, like: T.DataType) -> Column:
        """The column of a right side."""
        if isinstance(term, Literal):
            if tag_of(like) != term.tag and not (tag_of(like) == "L" and term.tag in ("SS", "NS", "BS")) and term.tag != "NULL":
                raise ValidationError(f"a value of type {term.tag} does not fit the column")
            return native(term, like).cast(like)
        if isinstance(term, Path):
            found = plane.resolve(term)
            return F.lit(None).cast(like) if found is None else found[0].cast(like)
        if isinstance(term, IfNotExists):
            return F.coalesce(self.value(term.path, plane, like), self.value(term.default, plane, like))
        if isinstance(term, ListAppend):
            return F.concat(self.value(term.first, plane, like), self.value(term.second, plane, like))
        if isinstance(term, Arithmetic):
            a, b = self.value(term.left, plane, like), self.value(term.right, plane, like)
            return (a + b if term.op == "+" else a - b).cast(like)
        raise ValidationError(f"not a value: {term}")

    def _put(self, column: Column, kind: T.DataType, parts: tuple, value: Column) -> Column:
        if not parts:
            return value
        head, rest = parts[0], parts[1:]
        if isinstance(kind, T.StructType):
            inner = {f.name: f.dataType for f in kind.fields}[head]
            return column.withField(head, self._put(column.getField(head), inner, rest, value))
        if isinstance(kind, T.MapType):
            entry = self._put(F.try_element_at(column, F.lit(head)), kind.valueType, rest, value)
            return F.map_concat(F.map_filter(column, lambda k, _: k != head), F.create_map(F.lit(head), entry))
        # a position past the end pads with nulls
        length = F.greatest(F.size(column), F.lit(head + 1))
        padded = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(column, i))
        return F.transform(padded, lambda x, i: F.when(i == head, self._put(x, kind.elementType, rest, value)).otherwise(x))

    def _drop(self, column: Column, kind: T.DataType, paths: list[tuple]) -> Column:
        """Without the places at ``paths``; list positions all refer to the list before the update."""
        by_head: dict = {}
        for p in paths:
            by_head.setdefault(p[0], []).append(p[1:])
        if isinstance(kind, T.StructType):
            inner = {f.name: f.dataType for f in kind.fields}
            for head, rests in by_head.items():
                if head in inner:
                    gone = F.lit(None).cast(inner[head]) if () in rests else self._drop(column.getField(head), inner[head], rests)
                    column = column.withField(head, gone)
            return column
        if isinstance(kind, T.MapType):
            whole = [h for h, rests in by_head.items() if () in rests]
            column = F.map_filter(column, lambda k, _: ~k.isin(*whole)) if whole else column
            for head, rests in by_head.items():
                if head not in whole:
                    column = F.transform_values(column, lambda k, v, h=head, r=rests: F.when(k == h, self._drop(v, kind.valueType, r)).otherwise(v))
            return column
        whole = [h for h, rests in by_head.items() if () in rests]
        for head, rests in by_head.items():
            if head not in whole:
                column = F.transform(column, lambda x, i, h=head, r=rests: F.when(i == h, self._drop(x, kind.elementType, r)).otherwise(x))
        return F.filter(column, lambda _, i: ~i.isin(*whole)) if whole else column

    def columns(self, update: Update, sequential: bool = False) -> dict[str, Column]:
        """New columns by top attribute: SET, REMOVE, ADD, DELETE, each clause once.

        With ``sequential`` every SET sees the ones before it, as in the statement dialect.
        """
        before = Typed(self.schema)
        out: dict[str, Column] = {}
        now = lambda name: out.get(name, F.col(f"`{name}`"))
        for path, term in update.sets:
            plane = Typed(self.schema, dict(out)) if sequential else before
            value = self.value(term, plane, self._type(path))
            new = self._put(now(path.top), self.fields[path.top], path.parts[1:], value)
            if len(path.parts) > 1:
                # SET under a missing parent is an error, not a silent no-op
                parent = plane.resolve(Path(path.parts[:-1]))[0]
                error = F.raise_error(F.lit(f"the document path {path} is invalid for update")).cast(self.fields[path.top])
                new = F.when(parent.isNull(), error).otherwise(new)
            out[path.top] = new
        removed: dict[str, list[tuple]] = {}
        for path in update.removes:
            if path.top in self.fields:
                removed.setdefault(path.top, []).append(path.parts[1:])
        for top, rests in removed.items():
            out[top] = F.lit(None).cast(self.fields[top]) if () in rests else self._drop(now(top), self.fields[top], rests)
        for path, value in update.adds:
            kind = self._type(path)
            old = before.resolve(path)[0]
            if value.tag == "N":
                new = F.coalesce(old + native(value, kind), native(value, kind)).cast(kind)
            else:
                new = F.array_sort(F.array_union(F.coalesce(old, F.array().cast(kind)), native(value, kind).cast(kind)))
            out[path.top] = self._put(now(path.top), self.fields[path.top], path.parts[1:], new)
        for path, value in update.deletes:
            kind = self._type(path)
            left = F.array_except(before.resolve(path)[0], native(value, kind).cast(kind))
            out[path.top] = self._put(now(path.top), self.fields[path.top], path.parts[1:], F.when(F.size(left) > 0, left))
        return out


def legacy_update(attributes: dict[str, dict], table: TableDef) -> Update:
    """The clauses of attribute updates in the older form: ``{name: {"Action": "PUT", "Value": ..}}``."""
    sets, removes, adds, deletes = [], [], [], []
    for name, a in attributes.items():
        if name in table.keys:
            raise ValidationError(f"key attribute {name} cannot be updated")
        path, action = Path((name,)), a.get("Action", "PUT")
        if action == "DELETE" and "Value" not in a:
            removes.append(path)
            continue
        value = literal(a["Value"])
        if action == "PUT":
            sets.append((path, value))
        elif action == "ADD":
            if value.tag == "L":
                sets.append((path, ListAppend(IfNotExists(path, Literal("L", ())), value)))
            else:
                adds.append((path, value))
        elif action == "DELETE":
            deletes.append((path, value))
        else:
            raise ValidationError(f"unknown action {action}")
    return Update(tuple(sets), tuple(removes), tuple(adds), tuple(deletes))
