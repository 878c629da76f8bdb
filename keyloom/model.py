"""Tables, keys and indexes, and the limits requests are held to."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from keyloom.errors import ResourceInUse, ResourceNotFound, ValidationError

#: Limits of requests and items.
MAX_ITEM_BYTES, MAX_DEPTH, MAX_HASH_BYTES, MAX_RANGE_BYTES = 409_600, 32, 2048, 1024
MAX_EXPRESSION_BYTES, PAGE_BYTES = 4096, 1 << 20
MAX_BATCH_GET, MAX_BATCH_WRITE, MAX_TRANSACT, MAX_BATCH_STATEMENTS, MAX_RECORDS = 100, 25, 100, 25, 1000
MAX_TRANSACT_BYTES, MAX_BATCH_BYTES = 4 << 20, 16 << 20
MAX_GSI, MAX_LSI = 20, 5
VIEWS = ("KEYS_ONLY", "NEW_IMAGE", "OLD_IMAGE", "NEW_AND_OLD_IMAGES")

_NAME = re.compile(r"^[A-Za-z0-9_.-]{3,255}$")


@dataclass(frozen=True)
class IndexDef:
    """A materialised, sparse copy of a table under other keys."""

    name: str
    hash_key: str
    range_key: str | None = None
    projection: str = "ALL"
    include: tuple[str, ...] = ()
    local: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.hash_key,) if self.range_key is None else (self.hash_key, self.range_key)


@dataclass(frozen=True)
class TableDef:
    """A keyed table: its keys with their types (S, N, B), indexes, stream view and expiry attribute."""

    name: str
    hash_key: str
    range_key: str | None = None
    key_types: tuple[tuple[str, str], ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    stream_view: str | None = None
    ttl_attribute: str | None = None
    protected: bool = False
    tags: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        if not _NAME.match(self.name):
            raise ValidationError(f"table name {self.name!r}")
        if self.hash_key == self.range_key:
            raise ValidationError("hash and range key are the same attribute")
        names = [i.name for i in self.indexes]
        if len(set(names)) < len(names):
            raise ValidationError("index names repeat")
        if sum(i.local for i in self.indexes) > MAX_LSI or sum(not i.local for i in self.indexes) > MAX_GSI:
            raise ValidationError("too many indexes")
        for i in self.indexes:
            if i.local and (i.hash_key != self.hash_key or self.range_key is None or i.range_key is None):
                raise ValidationError(f"local index {i.name} needs the table's hash key and a range key of its own")
            if i.projection not in ("ALL", "KEYS_ONLY", "INCLUDE") or (i.include and i.projection != "INCLUDE"):
                raise ValidationError(f"projection of index {i.name}")
        if self.stream_view is not None and self.stream_view not in VIEWS:
            raise ValidationError(f"stream view {self.stream_view!r}")
        for _, kind in self.key_types:
            if kind not in ("S", "N", "B"):
                raise ValidationError(f"key type {kind!r}")

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.hash_key,) if self.range_key is None else (self.hash_key, self.range_key)

    def index(self, name: str) -> IndexDef:
        for i in self.indexes:
            if i.name == name:
                return i
        raise ResourceNotFound(f"index {name} of table {self.name}")

    def index_columns(self, index: IndexDef, columns: list[str]) -> list[str]:
        """The columns an index copy carries: index and table keys always, then what it projects."""
        if index.projection == "ALL":
            return columns
        carried = dict.fromkeys((*index.keys, *self.keys, *index.include))
        return [c for c in columns if c in carried]

    @staticmethod
    def from_description(text: str | dict) -> TableDef:
        """A table description (``{"Table": {...}}`` or its content) as other tools export it."""
        d = json.loads(text) if isinstance(text, str) else text
        d = d.get("Table", d)
        kind = lambda s, of: next((k["AttributeName"] for k in s if k["KeyType"] == of), None)

        def indexes(key: str, local: bool) -> list[IndexDef]:
            out = []
            for g in d.get(key) or []:
                p = g.get("Projection") or {}
                out.append(IndexDef(g["IndexName"], kind(g["KeySchema"], "HASH"), kind(g["KeySchema"], "RANGE"), p.get("ProjectionType", "ALL"), tuple(p.get("NonKeyAttributes") or ()), local))
            return out

        stream = d.get("StreamSpecification") or {}
        return TableDef(
            d["TableName"],
            kind(d["KeySchema"], "HASH"),
            kind(d["KeySchema"], "RANGE"),
            tuple((a["AttributeName"], a["AttributeType"]) for a in d.get("AttributeDefinitions") or []),
            tuple(indexes("GlobalSecondaryIndexes", False) + indexes("LocalSecondaryIndexes", True)),
            stream.get("StreamViewType") if stream.get("StreamEnabled", bool(stream)) else None,
        )

    def describe(self) -> dict:
        """The description ``from_description`` reads."""
        keys = lambda x: [{"AttributeName": k, "KeyType": t} for k, t in zip(x.keys, ("HASH", "RANGE"))]

        def index(i: IndexDef) -> dict:
            p: dict = {"ProjectionType": i.projection} | ({"NonKeyAttributes": list(i.include)} if i.include else {})
            return {"IndexName": i.name, "KeySchema": keys(i), "Projection": p}

        out: dict = {"TableName": self.name, "KeySchema": keys(self), "AttributeDefinitions": [{"AttributeName": n, "AttributeType": t} for n, t in self.key_types], "TableStatus": "ACTIVE"}
        for key, local in (("GlobalSecondaryIndexes", False), ("LocalSecondaryIndexes", True)):
            if own := [index(i) for i in self.indexes if i.local == local]:
                out[key] = own
        if self.stream_view:
            out["StreamSpecification"] = {"StreamEnabled": True, "StreamViewType": self.stream_view}
        return out


class Catalog:
    """Definitions by name: create, update, delete, describe, list, tag."""

    def __init__(self) -> None:
        self._tables: dict[str, TableDef] = {}

    def create(self, table: TableDef) -> TableDef:
        if table.name in self._tables:
            raise ResourceInUse(f"table {table.name} exists")
        self._tables[table.name] = table
        return table

    def describe(self, name: str) -> TableDef:
        if name not in self._tables:
            raise ResourceNotFound(f"table {name}")
        return self._tables[name]

    def update(self, name: str, *, add_index: IndexDef | None = None, drop_index: str | None = None, **changes: object) -> TableDef:
        """Change settings, or create or delete one global index (existing items are backfilled by deriving it anew)."""
        table = self.describe(name)
        if add_index is not None:
            if add_index.local:
                raise ValidationError("a local index is made with its table")
            changes["indexes"] = (*table.indexes, add_index)
        if drop_index is not None:
            if table.index(drop_index).local:
                raise ValidationError("a local index goes with its table")
            changes["indexes"] = tuple(i for i in table.indexes if i.name != drop_index)
        self._tables[name] = replace(table, **changes)
        return self._tables[name]

    def delete(self, name: str) -> TableDef:
        if self.describe(name).protected:
            raise ResourceInUse(f"table {name} is protected")
        return self._tables.pop(name)

    def list(self, start: str | None = None, limit: int = 100) -> tuple[list[str], str | None]:
        """Names in order after ``start``, at most ``limit`` (up to 100), and where to go on."""
        if not 1 <= limit <= 100:
            raise ValidationError("limit must be 1 to 100")
        names = [n for n in sorted(self._tables) if start is None or n > start]
        return names[:limit], names[limit - 1] if len(names) > limit else None

    def tag(self, name: str, tags: dict[str, str]) -> None:
        t = self.describe(name)
        self._tables[name] = replace(t, tags=tuple((dict(t.tags) | tags).items()))

    def untag(self, name: str, keys: list[str]) -> None:
        t = self.describe(name)
        self._tables[name] = replace(t, tags=tuple((k, v) for k, v in t.tags if k not in keys))

    def set_ttl(self, name: str, attribute: str | None) -> None:
        self._tables[name] = replace(self.describe(name), ttl_attribute=attribute)
