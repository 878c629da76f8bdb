"""Keyed, indexed, paged and segmented reads of native tables.

One plan per request: range and cursor filters are pushed to the scan, then order and limit become a top-k, and only
above it come the page cut and the caller's filter, since a limit counts the rows read, not the rows that pass.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.errors import ValidationError
from keyloom.expr import parse
from keyloom.expr.ast import Path, literal, paths
from keyloom.expr.compile import Compiler, Typed, native
from keyloom.expr.rewrite import project
from keyloom.functions.sizes import item_size
from keyloom.model import MAX_BATCH_GET, MAX_TRANSACT, PAGE_BYTES, IndexDef, TableDef

SELECTS = ("ALL_ATTRIBUTES", "ALL_PROJECTED_ATTRIBUTES", "SPECIFIC_ATTRIBUTES", "COUNT")


@dataclass
class Request:
    """What a query or scan asks for; all but the table may be left out."""

    key_condition: str | None = None
    filter: str | None = None
    projection: str | None = None
    names: dict[str, str] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)
    index: str | None = None
    forward: bool = True
    limit: int | None = None
    start: dict[str, object] | None = None
    select: str | None = None
    segment: int | None = None
    segments: int | None = None
    page_bytes: int | None = None
    consistent: bool = False
    key_conditions: dict[str, dict] | None = None
    legacy_filter: dict[str, dict] | None = None
    conditional_operator: str = "AND"
    attributes: list[str] | None = None


@dataclass
class Read:
    """A compiled read: ``rows`` are the rows returned, ``evaluated`` those read before the filter, in order."""

    rows: DataFrame
    evaluated: DataFrame
    matches: Column
    order: list[str]
    forward: bool
    limit: int | None

    def counts(self) -> DataFrame:
        """One row: ``count`` of returned and ``scanned_count`` of evaluated rows."""
        return self.evaluated.agg(F.count_if(self.matches).alias("count"), F.count(F.lit(1)).alias("scanned_count"))

    def last_key(self) -> dict[str, object] | None:
        """Where the next page starts: the keys of the last evaluated row if the limit was reached, even if nothing follows."""
        if self.limit is None:
            return None
        key = F.struct(*(F.col(f"`{c}`") for c in self.order))
        row = self.evaluated.agg(F.count(F.lit(1)).alias("n"), (F.max(key) if self.forward else F.min(key)).alias("key")).first()
        return row["key"].asDict() if row["n"] >= self.limit else None


def ordering(columns: list[str], forward: bool = True) -> list[Column]:
    return [F.col(f"`{c}`").asc() if forward else F.col(f"`{c}`").desc() for c in columns]


def after(df: DataFrame, order: list[str], start: dict[str, object], forward: bool = True) -> Column:
    """Rows that come after a key in an order of several columns, spelled out so that it is pushed down."""
    if set(start) != set(order):
        raise ValidationError(f"the start key needs exactly {order}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    value = {c: native(literal(start[c]), kinds[c]) for c in order}
    beyond = (lambda c: F.col(f"`{c}`") > value[c]) if forward else (lambda c: F.col(f"`{c}`") < value[c])
    out = beyond(order[-1])
    for c in reversed(order[:-1]):
        out = beyond(c) | ((F.col(f"`{c}`") == value[c]) & out)
    first = F.col(f"`{order[0]}`")
    return ((first >= value[order[0]]) if forward else (first <= value[order[0]])) & out


def index_rows(df: DataFrame, table: TableDef, index: IndexDef) -> DataFrame:
    """The index copy of a table: sparse (rows with all index keys), projected."""
    here = df
    for k in index.keys:
        here = here.where(F.col(f"`{k}`").isNotNull())
    return here.select(*(f"`{c}`" for c in table.index_columns(index, df.columns)))


def index_order(table: TableDef, index: IndexDef) -> list[str]:
    """Order of index rows: the index range key, then the table's keys, the index hash key first in scans."""
    return list(dict.fromkeys((*index.keys, *table.keys)))


def hash_bucket(key: Column) -> Column:
    """One of 4,096 buckets of a key's text: the first three hex digits of a salted md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("Outliers"), key.cast("string"))), 1, 3), 16, 10).cast("int")


def in_segment(key: Column, segment: int, segments: int) -> Column:
    """Whether a hash key falls to a segment of a parallel scan; segments are disjoint and together everything."""
    if not 0 <= segment < segments:
        raise ValidationError("the segment must be below the number of segments")
    low, high = -(-4096 * segment // segments), -(-4096 * (segment + 1) // segments) - 1
    return hash_bucket(key).between(low, high)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's bytes, as bigint."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.lit(2166136261).cast("bigint")
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(1 << 32))
    return F.when(F.octet_length(text) > 0, F.aggregate(bytes_, start, step)).otherwise(start)


def in_index_segment(key: Column, segment: int, segments: int) -> Column:
    """The segment rule of index scans, by the table's hash key."""
    return F.pmod(fnv1a(key.cast("string")), F.lit(segments)) == segment


def page_cut(df: DataFrame, order: list[str], forward: bool = True, bytes_: int = PAGE_BYTES, size: Column | None = None) -> DataFrame:
    """Rows of the first page: up to the row that would overflow it; the first row always is in.

    Every row stores its key names at least, so a page holds a bounded number of rows: a top-k of so many comes first, and
    only these meet in one task for the running total.
    """
    least = max(1, sum(len(c) for c in order)) if size is None else 1
    window = Window.orderBy(*ordering(order, forward)).rowsBetween(Window.unboundedPreceding, 0)
    first = df.orderBy(*ordering(order, forward)).limit(bytes_ // least + 1)
    sized = first.withColumn("_size", item_size(df.schema) if size is None else size)
    ranked = sized.withColumn("_sum", F.sum("_size").over(window)).withColumn("_rank", F.count(F.lit(1)).over(window))
    return ranked.where((F.col("_sum") <= bytes_) | (F.col("_rank") == 1)).drop("_size", "_sum", "_rank")


def _scope(r: Request) -> parse.Scope:
    return parse.Scope(r.names, r.values)


def _selected(r: Request, table: TableDef, index: IndexDef | None, scope: parse.Scope) -> list[Path] | None:
    """The projected paths, None for all; refuses illegal combinations."""
    if r.projection is not None and r.attributes is not None:
        raise ValidationError("old and new style projections can't be mixed")
    wanted = parse.projection(r.projection, scope) if r.projection is not None else [Path((a,)) for a in r.attributes] if r.attributes else None
    if r.select is not None and r.select not in SELECTS:
        raise ValidationError(f"select {r.select!r}")
    if wanted and r.select not in (None, "SPECIFIC_ATTRIBUTES"):
        raise ValidationError("a projection goes with SPECIFIC_ATTRIBUTES only")
    if r.select == "SPECIFIC_ATTRIBUTES" and not wanted:
        raise ValidationError("SPECIFIC_ATTRIBUTES needs a projection")
    if r.select == "ALL_PROJECTED_ATTRIBUTES" and index is None:
        raise ValidationError("ALL_PROJECTED_ATTRIBUTES is for index reads")
    if r.select == "ALL_ATTRIBUTES" and index is not None and not index.local and index.projection != "ALL":
        raise ValidationError("a global index gives only what it projects")
    return wanted


def _read(df: DataFrame, table: TableDef, r: Request, query: bool) -> Read:
    index = table.index(r.index) if r.index else None
    if index is not None and not index.local and r.consistent:
        raise ValidationError("global indexes are not read consistently")
    if r.limit is not None and r.limit < 1:
        raise ValidationError("the limit must be at least 1")
    scope = _scope(r)
    wanted = _selected(r, table, index, scope)
    rows = df if index is None else index_rows(df, table, index)
    keys = table.keys if index is None else index.keys
    order = list(table.keys) if index is None else index_order(table, index)
    if query:
        if r.key_condition is None and r.key_conditions is None:
            raise ValidationError("a query needs a key condition")
        hash_key, range_key = keys[0], keys[1] if len(keys) > 1 else None
        if r.key_condition is not None:
            node = parse.key_condition(r.key_condition, scope, hash_key, range_key)
        else:
            node = parse.legacy_condition(r.key_conditions)
            if any(p.top not in keys for p in paths(node)):
                raise ValidationError("a key condition is on keys only")
        rows = rows.where(Compiler(Typed(rows.schema)).filter(node))
        order = [c for c in order if c != hash_key] or [hash_key]
    elif (r.segment is None) != (r.segments is None):
        raise ValidationError("segment and segments go together")
    elif r.segments is not None:
        owner = F.col(f"`{table.hash_key}`")
        rows = rows.where(in_segment(owner, r.segment, r.segments) if index is None else in_index_segment(owner, r.segment, r.segments))
    node = None
    if r.filter is not None:
        node = parse.condition(r.filter, scope)
    elif r.legacy_filter is not None:
        node = parse.legacy_condition(r.legacy_filter, r.conditional_operator)
    if query and node is not None and any(p.top in keys for p in paths(node)):
        raise ValidationError("a filter of a query can't name its key attributes")
    scope.close()
    if r.start is not None:
        start = {k: v for k, v in r.start.items() if not query or k in order}
        rows = rows.where(after(rows, order, start, r.forward))
    paged = r.limit is not None or r.page_bytes is not None
    if query or paged:
        rows = rows.orderBy(*ordering(order, r.forward))
    if r.limit is not None:
        rows = rows.limit(r.limit)
    if r.page_bytes is not None:
        rows = page_cut(rows, order, r.forward, r.page_bytes).orderBy(*ordering(order, r.forward))
    matches = F.lit(True) if node is None else Compiler(Typed(rows.schema)).value(node)
    kept = rows if node is None else rows.where(Compiler(Typed(rows.schema)).filter(node))
    if index is not None and index.local and index.projection != "ALL" and (r.select == "ALL_ATTRIBUTES" or (wanted and any(p.top not in rows.columns for p in wanted))):
        kept = fetch_base(kept, df, table)
        if query or paged:
            kept = kept.orderBy(*ordering(order, r.forward))
    if r.select == "COUNT":
        out = rows.agg(F.count_if(matches).alias("count"), F.count(F.lit(1)).alias("scanned_count"))
    else:
        out = project(kept, wanted) if wanted else kept
    return Read(out, rows, matches, order, r.forward, r.limit)


def query(df: DataFrame, table: TableDef, request: Request) -> Read:
    """One partition of a table or index, in sort-key order, by range, cursor, limit and filter."""
    return _read(df, table, request, True)


def scan(df: DataFrame, table: TableDef, request: Request) -> Read:
    """A whole table or index, or one segment of it; ordered by key only when paged."""
    return _read(df, table, request, False)


def fetch_base(index_part: DataFrame, base: DataFrame, table: TableDef) -> DataFrame:
    """Index rows with all attributes of their base rows; a row whose base is gone keeps what the index has."""
    own = index_part.columns
    more = base.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(table.keys)), *(F.col(f"`{c}`").alias(f"_b_{c}") for c in base.columns))
    on = [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(table.keys)]
    joined = index_part.join(more, on, "left")
    pick = lambda c: F.coalesce(F.col(f"`_b_{c}`"), F.col(f"`{c}`")) if c in own else F.col(f"`_b_{c}`")
    return joined.select(*(pick(c).alias(c) for c in base.columns))


def get_item(df: DataFrame, table: TableDef, key: dict[str, object], projection: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The row of one full primary key, none if it is absent."""
    if set(key) != set(table.keys):
        raise ValidationError(f"the key needs exactly {table.keys}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df
    for k, v in key.items():
        rows = rows.where(F.col(f"`{k}`") == native(literal(v), kinds[k]))
    scope = parse.Scope(names)
    wanted = parse.projection(projection, scope) if projection else None
    scope.close()
    return project(rows, wanted) if wanted else rows


def _keys_frame(df: DataFrame, table: TableDef, keys: list[dict[str, object]], most: int) -> DataFrame:
    if not 1 <= len(keys) <= most:
        raise ValidationError(f"1 to {most} keys")
    rows = [tuple(k[a] for a in table.keys) for k in keys]
    if len(set(rows)) < len(rows):
        raise ValidationError("a key is asked for twice")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = lambda i, r: F.struct(*(native(literal(v), kinds[k]).cast(kinds[k]).alias(k) for k, v in zip(table.keys, r)), F.lit(i).alias("_pos"))
    return df.sparkSession.range(1).select(F.inline(F.array(*(one(i, r) for i, r in enumerate(rows)))))


def batch_get(df: DataFrame, table: TableDef, keys: list[dict[str, object]], projection: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Rows of up to 100 keys, missing ones left out; the key list is that small, so it is the broadcast side."""
    wanted = parse.projection(projection, parse.Scope(names)) if projection else None
    asked = _keys_frame(df, table, keys, MAX_BATCH_GET).drop("_pos")
    found = df.join(F.broadcast(asked), list(table.keys), "left_semi")
    return project(found, wanted) if wanted else found


def multi_get(df: DataFrame, table: TableDef, keys: DataFrame) -> DataFrame:
    """Rows of any number of distinct keys; Spark picks the join by the sizes it sees."""
    return df.join(keys.select(*table.keys).distinct(), list(table.keys), "left_semi")


def transact_get(df: DataFrame, table: TableDef, keys: list[dict[str, object]], projection: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """One row per asked key in the order asked, ``found`` false and attributes NULL where there is none.

    A projection is given the key attributes besides, as this read's results carry them.
    """
    asked = _keys_frame(df, table, keys, MAX_TRANSACT)
    rows = df.withColumn("found", F.lit(True))
    found = rows.join(F.broadcast(asked.select(*table.keys)), list(table.keys), "left_semi")  # at most as many rows as keys
    joined = asked.join(found, list(table.keys), "left")
    joined = joined.withColumn("found", F.coalesce("found", F.lit(False)))
    columns = df.columns
    if projection:
        tops = [p.top for p in parse.projection(projection, parse.Scope(names))]
        columns = list(dict.fromkeys((*table.keys, *tops)))
    return joined.select("_pos", "found", *columns).orderBy("_pos").withColumnRenamed("_pos", "position")


def least_recently_used(df: DataFrame, keys: list[str], at: str = "cached_at", limit: int = 100) -> DataFrame:
    """The rows touched longest ago; rows never touched are left out; ties by key."""
    return df.where(F.col(at).isNotNull()).orderBy(F.col(at).asc(), *keys).limit(limit)


def page_token(table: str, statement: str, key: dict[str, object]) -> str:
    """An opaque token for where a statement's next page starts."""
    mark = hashlib.sha256(statement.encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([table, mark, key], default=str).encode()).decode()


def read_token(token: str, table: str, statement: str) -> dict[str, object]:
    """The start key of a token; refuses tokens of other tables or statements."""
    try:
        own, mark, key = json.loads(base64.urlsafe_b64decode(token))
    except ValueError as bad:
        raise ValidationError("the token is damaged") from bad
    if own != table or mark != hashlib.sha256(statement.encode()).hexdigest()[:16]:
        raise ValidationError("the token is of another statement")
    return key
