"""Flat tables out of deeply nested items: one per kind of list element, rows linked to their parents.

A bottom-up tree automaton reads each item. Its state for a node is decided by the node's tag and the states of
its children alone: a scalar's state is its tag, a map's the sorted attribute-state pairs, a list's the set of its elements' states. So
equal shapes reach equal states wherever they stand, in any file, whatever the order of their attributes; a state's
id is a hash of its transition and needs no shared table. A map that is an element of a list becomes a row; its state is its
*variant*, the attribute path down to it (indices left out) its *kind*. Every variant shares the supertype's keys
(``source_field``, ``record_id``, ``child_path``, ``parent_path``), by which children join their parents; ``subtype``
gives a kind's variants as one typed table with columns chosen by hand. ``kind_columns`` derives the columns and types of every kind from
what its variants hold, ``subtypes`` makes every kind's table of them, ``all_subtypes`` all of these in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, DecimalException
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.tagged import dumps, parse_object, strings, tagged

#: Memory of known transitions of a worker is emptied between items beyond this many; ids are hashes and shapes are spelled anew, so nothing else changes.
KNOWN_STATES = 200_000

ROWS = "source_field string, record_id bigint, child_path string, parent_path string, kind string, variant string, shape string, scalars map<string,string>"
FOUND = "kind string, name string, type string, whole int, scale int"
LINKS = "source_field string, record_id bigint, child_path string, parent_path string, variant string"

_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


class ShapeAutomaton:
    """States of tagged trees, bottom-up; ``elements`` gets every map that is an element of a list."""

    def __init__(self, want_scalars: bool) -> None:
        self.known: dict[object, str] = {}
        self.shapes: dict[str, str] = {}
        self.want_scalars = want_scalars

    def forget(self) -> None:
        """Empty the memory between two items, never within one, as shapes are spelled from those of their children."""
        if len(self.known) >= KNOWN_STATES:
            self.known.clear()
            self.shapes.clear()

    def _state(self, transition: object, describe) -> str:
        state = self.known.get(transition)
        if state is None:
            state = blake2b(repr(transition).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            self.known[transition] = state
            self.shapes[state] = describe()
        return state

    def read(self, item: dict) -> list[tuple[str, str, str, str, str, list]]:
        """Rows of one item: (path, parent path, kind, variant, shape, scalar pairs), parents before children."""
        rows: list = []
        self.forget()
        try:
            for name, value in item.items():
                self._node(value, name, name, "", rows)
        except RecursionError:
            rows.clear()
            for name, value in item.items():
                self._deep(value, name, rows)
        rows.reverse()
        return rows

    def _deep(self, value: object, name: str, rows: list) -> None:
        """``_node`` of nesting beyond Python's recursion limit: the same walk on a stack of its own."""
        state, todo = "", [self._steps(value, name, name, "", rows)]
        while todo:
            try:
                todo.append(todo[-1].send(state or None))
                state = ""
            except StopIteration as done:
                todo.pop()
                state = done.value

    def _steps(self, value: object, path: str, kind: str, parent: str, rows: list):
        """Asks for the states of the children by yielding their steps; the order of the rows is that of ``_node``."""
        node = tagged(value)
        if node and node[0] == "M" and isinstance(node[1], dict):
            pairs = []
            for name, child in node[1].items():
                pairs.append((name, (yield self._steps(child, path + "." + name, kind + "." + name, parent, rows))))
            return self._map_state(pairs)
        if node and node[0] == "L" and isinstance(node[1], list):
            states = set()
            for i, element in enumerate(node[1]):
                at, inner = f"{path}[{i}]", tagged(element)
                own = bool(inner and inner[0] == "M" and isinstance(inner[1], dict))
                state = yield self._steps(element, at, kind + "[]", at if own else parent, rows)
                if own:
                    rows.append((at, parent, kind + "[]", state, self.shapes.get(state, ""), inner[1] if self.want_scalars else None))
                states.add(state)
            return self._list_state(states)
        return self._node(value, path, kind, parent, rows)

    def _map(self, content: dict, path: str, kind: str, parent: str, rows: list) -> str:
        prefix, kinds = (path + ".", kind + ".") if path else ("", "")
        pairs = [(name, self._node(value, prefix + name, kinds + name, parent, rows)) for name, value in content.items()]
        return self._map_state(pairs)

    def _map_state(self, pairs: list) -> str:
        pairs.sort()
        return self._state(("M", tuple(pairs)), lambda: "{" + ",".join(f"{n}:{self.shapes.get(s, s)}" for n, s in pairs) + "}")

    def _node(self, value: object, path: str, kind: str, parent: str, rows: list) -> str:
        node = tagged(value)
        if node is None:
            return self._state("?", lambda: "?")
        tag, content = node
        if tag == "M" and isinstance(content, dict):
            return self._map(content, path, kind, parent, rows)
        if tag == "L" and isinstance(content, list):
            states = set()
            for i, element in enumerate(content):
                at = f"{path}[{i}]"
                inner = tagged(element)
                if inner and inner[0] == "M" and isinstance(inner[1], dict):
                    state = self._map(inner[1], at, kind + "[]", at, rows)
                    rows.append((at, parent, kind + "[]", state, self.shapes.get(state, ""), inner[1] if self.want_scalars else None))
                else:
                    state = self._node(element, at, kind + "[]", parent, rows)
                states.add(state)
            return self._list_state(states)
        return self._state(tag, lambda: tag)

    def _list_state(self, states: set) -> str:
        ordered = tuple(sorted(states))
        return self._state(("L", ordered), lambda: "[" + "|".join(self.shapes.get(s, s) for s in ordered) + "]")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`" if "." in name or "`" in name else name


def _without_maps(elements: list) -> tuple[list, bool]:
    """The tagged elements of a list with null for its maps, which have rows of their own, and whether anything else is in it."""
    top: list = []
    kept, todo = False, [(elements, top)]
    while todo:
        source, out = todo.pop()
        for element in source:
            node = tagged(element)
            if node and node[0] == "M" and isinstance(node[1], dict):
                out.append(None)
            elif node and node[0] == "L" and isinstance(node[1], list):
                inner: list = []
                out.append({"L": inner})
                todo.append((node[1], inner))
            else:
                out.append(element)
                kept = True
    return top, kept


def _values(content: dict) -> list[tuple[str, str, object]]:
    """Dotted name, tag and content of every value of an element that no other element's row holds; untagged values have the tag '?'."""
    out, todo = [], [("", content)]
    while todo:
        prefix, attributes = todo.pop()
        for name, value in attributes.items():
            at, node = prefix + _quoted(name), tagged(value)
            if node is None:
                out.append((at, "?", value))
            elif node[0] == "M" and isinstance(node[1], dict):
                todo.append((at + ".", node[1]))
            elif node[0] == "L" and isinstance(node[1], list):
                rest, kept = _without_maps(node[1])
                if kept:
                    out.append((at, "L", rest))
            else:
                out.append((at, *node))
    return out


def _text(content: object) -> str:
    return content if isinstance(content, str) else dumps(content)


def _scalars(content: dict) -> list[tuple[str, str]]:
    """Values of an element as text: bare for S, N and B, JSON for the rest; NULL is left out.

    Maps within it are flattened into dotted names (``shipment.carrier``; a name that itself holds a dot or a backquote is backquoted).
    A list that holds anything but maps is the JSON of its tagged elements, with null in the place of each map.
    """
    return [(name, _text(value)) for name, tag, value in _values(content) if tag != "NULL"]


def _pairs(rows: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = [0, *accumulate(len(row) for row in rows)]
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings([k for row in rows for k, _ in row]), strings([v for row in rows for _, v in row]))


def _reader(want_scalars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShapeAutomaton(want_scalars)
        for batch in batches:
            fields, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = [[] for _ in range(8 if want_scalars else 5)]

            def flush() -> pa.RecordBatch:
                columns = [strings(out[0]), pa.array(out[1], pa.int64()), strings(out[2]), strings(out[3])]
                if want_scalars:
                    columns += [strings(out[4]), strings(out[5]), strings(out[6]), _pairs(out[7])]
                    names = ["source_field", "record_id", "child_path", "parent_path", "kind", "variant", "shape", "scalars"]
                else:
                    columns += [strings(out[4])]
                    names = ["source_field", "record_id", "child_path", "parent_path", "variant"]
                for column in out:
                    column.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for field, record, text in zip(fields, ids, texts):
                item = parse_object(text)
                if item is None:
                    continue
                for path, parent, kind, variant, shape, content in automaton.read(item):
                    out[0].append(field)
                    out[1].append(record)
                    out[2].append(path)
                    out[3].append(parent)
                    if want_scalars:
                        out[4].append(kind)
                        out[5].append(variant)
                        out[6].append(shape)
                        out[7].append(_scalars(content))
                    else:
                        out[4].append(variant)
                if len(out[0]) >= 20_000:
                    yield flush()
            if out[0]:
                yield flush()

    return run


def may_hold_list_of_maps(text: Column) -> Column:
    """False only for texts that cannot hold a list tag, however it is spelled; keeps the rest out of Python."""
    return text.contains('"L"') | text.contains("\\u")


def documents(df: DataFrame, record_id: str, *sources: tuple[str, str]) -> DataFrame:
    """``source_field``, ``record_id``, ``text`` of the JSON columns of a table; ``sources`` are (column, name) pairs.

    One scan for all columns: they are packed into an array and exploded.
    """
    packed = F.array(*(F.struct(F.lit(name).alias("source_field"), F.col(column).alias("text")) for column, name in sources))
    return df.select(F.col(record_id).cast("bigint").alias("record_id"), F.explode(packed).alias("d")).select("d.source_field", "record_id", "d.text")


def element_rows(docs: DataFrame, scalars: bool = False) -> DataFrame:
    """Every map that is an element of a list, at any depth, of every document that parses.

    ``docs``: ``source_field``, ``record_id``, ``text``. Documents that are null, empty, damaged, not objects or nested beyond the JSON parser give no rows. Paths count
    list positions over all elements from 0; ``parent_path`` is '' under the item itself. Of an attribute named
    twice in one object the last counts. With ``scalars`` also the kind, the shape of the variant and all values of the element but
    those of the elements below it: maps that aren't elements are flattened into dotted names, lists of scalars kept as JSON (``_scalars``).
    Values of the item outside any list of maps are in no row; they stay in the item.
    Record ids may repeat or be null; each row keeps its own.
    """
    small = docs.where(may_hold_list_of_maps(F.col("text"))).select("source_field", "record_id", "text")
    return small.mapInArrow(_reader(scalars), ROWS if scalars else LINKS)


def variants(rows: DataFrame) -> DataFrame:
    """The routes: rows per source, kind and variant with the variant's shape."""
    return rows.groupBy("source_field", "kind", "variant").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n_rows"))


def subtype(rows: DataFrame, kind: str, **columns: str) -> DataFrame:
    """The table of one kind: the supertype's keys, the variant, and ``columns`` (attribute name, dotted within maps, to SQL type).

    Variants lacking an attribute, and values that don't fit the type, give null.
    """
    typed = [F.try_element_at("scalars", F.lit(name)).try_cast(of).alias(name) for name, of in columns.items()]
    return rows.where(F.col("kind") == kind).select("source_field", "record_id", "child_path", "parent_path", "variant", *typed)


def _width(text: object) -> tuple[int, int] | None:
    """Digits of a number before and after the point; None for what no decimal holds."""
    if not isinstance(text, str) or not _NUMBER.fullmatch(text):
        return None
    if len(text) <= 18 and text.isdigit():
        return len(text), 0
    try:
        digits, power = Decimal(text).as_tuple()[1:]
    except DecimalException:
        return None
    if not isinstance(power, int):
        return None
    bare = "".join(map(str, digits)).lstrip("0")
    shown = bare.rstrip("0")
    power += len(bare) - len(shown)
    whole, scale = (max(1, len(shown) + power), max(0, -power)) if shown else (1, 0)
    return (whole, scale) if whole + scale <= 38 else None


def _type(tag: str, content: object) -> str:
    """What a value asks of its column; numbers are judged by ``_width``. A value its tag's type can't hold asks for text."""
    if tag == "NULL":
        return "void"
    if tag == "BOOL" and isinstance(content, bool):
        return "boolean"
    if tag in ("SS", "NS", "BS") and isinstance(content, list) and all(isinstance(x, str) for x in content):
        return "array<string>"
    return "string"


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = ShapeAutomaton(True)
    found: dict[tuple[str, str | None, str], tuple[int, int]] = {}

    def flush() -> pa.RecordBatch:
        keys, widths = list(found), list(found.values())
        found.clear()
        texts = [strings([key[i] for key in keys]) for i in range(3)]
        sizes = [pa.array([w[i] for w in widths], pa.int32()) for i in range(2)]
        return pa.RecordBatch.from_arrays(texts + sizes, names=["kind", "name", "type", "whole", "scale"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            item = parse_object(text)
            if item is None:
                continue
            for _, _, kind, _, _, content in automaton.read(item):
                found[kind, None, "void"] = (0, 0)
                for name, tag, value in _values(content):
                    width = _width(value) if tag == "N" else None
                    key = (kind, name, "number" if width else _type(tag, value))
                    had = found.get(key)
                    if had is None or width and (width[0] > had[0] or width[1] > had[1]):
                        found[key] = (max(width[0], had[0]), max(width[1], had[1])) if width and had else width or (0, 0)
        if len(found) >= KNOWN_STATES:
            yield flush()
    if found:
        yield flush()


def kind_columns(docs: DataFrame) -> dict[str, dict[str, str]]:
    """Kinds with the columns of their tables: dotted name to the narrowest SQL type that holds every value of every variant.

    Numbers are bigint, decimal, or text where 38 digits don't hold them all; sets are arrays of text; lists and mixtures are text.
    A column that is NULL in all variants is text. Reads all documents once; only the columns found come to the driver.
    """
    found = docs.where(may_hold_list_of_maps(F.col("text"))).select("text").mapInArrow(_finder, FOUND)
    merged = found.groupBy("kind", "name").agg(F.collect_set("type").alias("types"), F.max("whole").alias("whole"), F.max("scale").alias("scale"))
    kinds: dict[str, dict[str, str]] = {}
    for r in sorted(merged.collect(), key=lambda r: (r.kind, r.name or "")):
        columns = kinds.setdefault(r.kind, {})
        if r.name is None:
            continue
        types = set(r.types) - {"void"}
        if types == {"number"}:
            whole, scale = r.whole, r.scale
            columns[r.name] = "bigint" if not scale and whole <= 18 else f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "string"
        else:
            columns[r.name] = types.pop() if len(types) == 1 else "string"
    return kinds


def _labels(names: list[str], taken: tuple[str, ...] = ()) -> dict[str, str]:
    """A column label per name, apart from ``taken`` and from each other even where case doesn't count."""
    used, out = {t.lower() for t in taken}, {}
    for name in sorted(names):
        label, n = name, 1
        while label.lower() in used:
            n += 1
            label = f"{name}_{n}"
        used.add(label.lower())
        out[name] = label
    return out


def _typed(name: str, of: str) -> Column:
    text = F.try_element_at("scalars", F.lit(name))
    if of == "string":
        return text
    if of.startswith("array"):
        return F.from_json(text, of)
    return text.try_cast("decimal(38,0)").try_cast("bigint") if of == "bigint" else text.try_cast(of)


_KEYS = ("source_field", "record_id", "child_path", "parent_path", "variant")


def subtypes(docs: DataFrame, kinds: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """The flat table of every kind: the supertype's keys, the variant, and the typed columns of ``kind_columns``.

    A column named like a key, or like another but for case, gets a number behind its name.
    """
    kinds = kind_columns(docs) if kinds is None else kinds
    rows, out = element_rows(docs, scalars=True), {}
    for kind, columns in kinds.items():
        labels = _labels(list(columns), _KEYS)
        out[kind] = rows.where(F.col("kind") == kind).select(*_KEYS, *(_typed(name, of).alias(labels[name]) for name, of in columns.items()))
    return out


def all_subtypes(docs: DataFrame, kinds: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The tables of all kinds in one pass: keys, variant, kind, and per kind a struct of its typed columns, null in rows of other kinds.

    Kinds without a value of their own have rows but no struct. The schema grows with the kinds the data hold.
    """
    kinds = kind_columns(docs) if kinds is None else kinds
    labels, structs = _labels(list(kinds)), []
    for kind, columns in kinds.items():
        if columns:
            inner = _labels(list(columns))
            fields = F.struct(*(_typed(name, of).alias(inner[name]) for name, of in columns.items()))
            structs.append(F.when(F.col("kind") == kind, fields).alias(labels[kind]))
    return element_rows(docs, scalars=True).select(*_KEYS, "kind", *structs)
