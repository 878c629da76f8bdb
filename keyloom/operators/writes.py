"""Writes as transforms of table versions: a batch of mutations meets the current rows in one join by key.

``apply`` takes a frame of mutations, at most one per key, and gives every mutated key's old and new image with the
outcome; the new version is the old one without those keys plus the new images. A condition is evaluated on the
old image, on the empty item where there is none. Batches and transactions are the same join with other limits; an ordered
log with repeated keys belongs to ``changefeed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.errors import ConditionFailed, DuplicateItem, TransactionCanceled, ValidationError
from keyloom.expr import parse
from keyloom.expr.ast import Update, literal
from keyloom.expr.compile import Compiler, Typed, native
from keyloom.expr.rewrite import Updater
from keyloom.functions.sizes import index_units, item_size, write_units
from keyloom.model import MAX_BATCH_WRITE, MAX_ITEM_BYTES, MAX_TRANSACT, IndexDef, TableDef
from keyloom.operators.reads import index_rows


def _key_equal(table: TableDef, left: str = "", right: str = "") -> Column:
    out = F.lit(True)
    for k in table.keys:
        out = out & (F.col(f"`{left}{k}`") == F.col(f"`{right}{k}`"))
    return out


def has_key(df: DataFrame, table: TableDef) -> Column:
    """Whether all key attributes are there and, where text, not empty."""
    out = F.lit(True)
    for k in table.keys:
        out = out & F.col(f"`{k}`").isNotNull() & (F.col(f"`{k}`").cast("string") != "")
    return out


def repeated_keys(mutations: DataFrame, table: TableDef) -> DataFrame:
    """Keys a batch names more than once."""
    return mutations.groupBy(*table.keys).count().where("count > 1").drop("count")


@dataclass
class Outcome:
    """What a batch did: ``rows`` per mutated key with ``ok``, ``existed`` and the images; ``table`` is the new version."""

    rows: DataFrame
    table: DataFrame
    definition: TableDef
    columns: list[str]

    def image(self, which: str) -> DataFrame:
        """Old or new images ('old', 'new') of the mutations that went through."""
        rows = self.rows.where(F.col("ok") & F.col(which).isNotNull())
        return rows.select(f"{which}.*")

    def returned(self, values: str, touched: list[str] | None = None) -> DataFrame:
        """RETURN VALUES: NONE, ALL_OLD, ALL_NEW, UPDATED_OLD, UPDATED_NEW (the top attributes the update touches)."""
        if values not in ("NONE", "ALL_OLD", "ALL_NEW", "UPDATED_OLD", "UPDATED_NEW"):
            raise ValidationError(f"return values {values!r}")
        if values == "NONE":
            return self.image("new").limit(0)
        side = self.image("old" if values.endswith("OLD") else "new")
        return side.select(*touched) if values.startswith("UPDATED") and touched else side

    def changes(self) -> DataFrame:
        """Change records: keys, event (INSERT, MODIFY, REMOVE) and images; a MODIFY that changes nothing is one too."""
        event = F.when(F.col("new").isNull(), "REMOVE").when(F.col("old").isNull(), "INSERT").otherwise("MODIFY")
        keys = [F.coalesce(F.col(f"new.`{k}`"), F.col(f"old.`{k}`")).alias(k) for k in self.definition.keys]
        return self.rows.where(F.col("ok") & (F.col("old").isNotNull() | F.col("new").isNotNull())).select(*keys, event.alias("event"), "old", "new")

    def capacity(self, transactional: bool = False) -> DataFrame:
        """Write units per key."""
        schema = self.table.schema
        of = lambda side: F.when(F.col(side).isNotNull(), _struct_size(side, schema))
        keys = [F.col(f"`{k}`") for k in self.definition.keys]
        return self.rows.select(*keys, write_units(of("old"), of("new"), transactional).alias("write_units"))

    def index_capacity(self, index: IndexDef) -> DataFrame:
        """Write units of one index per key that went through."""
        columns = self.definition.index_columns(index, self.columns)

        def copy(side: str) -> Column:
            there = F.col(side).isNotNull()
            for k in index.keys:
                there = there & F.col(f"{side}.`{k}`").isNotNull()
            return F.when(there, F.struct(*(F.col(f"{side}.`{c}`").alias(c) for c in columns)))

        rows = self.rows.where("ok").withColumn("_o", copy("old")).withColumn("_n", copy("new"))
        schema = rows.schema["_o"].dataType
        moved = F.lit(False)
        for k in index.keys:
            moved = moved | ~F.col(f"_o.`{k}`").eqNullSafe(F.col(f"_n.`{k}`"))
        of = lambda side: F.when(F.col(side).isNotNull(), _struct_size(side, schema))
        units = index_units(of("_o"), of("_n"), F.col("_o").eqNullSafe(F.col("_n")), moved)
        return rows.select(*(F.col(f"`{k}`") for k in self.definition.keys), units.alias("write_units"))


def _struct_size(side: str, schema) -> Column:
    from keyloom.functions.sizes import value_size

    total = F.lit(0)
    for f in schema.fields:
        column = F.col(f"{side}.`{f.name}`")
        total = total + F.when(column.isNotNull(), F.lit(len(f.name.encode())) + value_size(column, f.dataType)).otherwise(0)
    return total


def _meet(base: DataFrame, table: TableDef, mutations: DataFrame) -> DataFrame:
    """Mutations beside the stored rows: their columns, and ``old`` (NULL where there is none)."""
    stored = base.select(F.struct("*").alias("old"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(table.keys)))
    on = F.lit(True)
    for i, k in enumerate(table.keys):
        on = on & (F.col(f"`{k}`") == F.col(f"_k{i}"))
    return mutations.join(stored, on, "left").drop(*(f"_k{i}" for i in range(len(table.keys))))


def _condition(base: DataFrame, text: str | None, names: dict | None, values: dict | None, expected: dict | None = None, operator: str = "AND", scope: parse.Scope | None = None) -> Column:
    own = scope or parse.Scope(names, values)
    if text is not None:
        node = parse.condition(text, own)
    elif expected:
        node = parse.legacy_condition(expected, operator)
    else:
        node = None
    if scope is None:
        own.close()
    if node is None:
        return F.lit(True)
    return Compiler(Typed(base.schema, {c: F.col(f"old.`{c}`") for c in base.columns})).value(node)


def _publish(base: DataFrame, table: TableDef, met: DataFrame) -> Outcome:
    """The outcome of rows with ``old``, ``new`` (the image if allowed, NULL for a removal) and ``ok``."""
    touched = met.where("ok").select(*table.keys)
    kept = base.join(touched, list(table.keys), "left_anti").select(*base.columns)
    written = met.where(F.col("ok") & F.col("new").isNotNull()).select("new.*")
    return Outcome(met, kept.unionByName(written), table, base.columns)


def put(base: DataFrame, table: TableDef, items: DataFrame, condition: str | None = None, names: dict | None = None, values: dict | None = None, expected: dict | None = None) -> Outcome:
    """Replace whole items, those whose condition holds on the old image. Items without a full key or over the size limit are refused."""
    fits = has_key(items, table) & (item_size(base.schema) <= MAX_ITEM_BYTES)
    rows = items.select(*base.columns).where(F.when(fits, True).otherwise(F.raise_error(F.lit("an item lacks a key or is too large")).cast("boolean")))
    met = _meet(base, table, rows).withColumn("existed", F.col("old").isNotNull())
    ok = _condition(base, condition, names, values, expected)
    new = F.struct(*(F.col(f"`{c}`") for c in base.columns))
    return _publish(base, table, met.withColumn("ok", ok).select(*table.keys, "existed", "ok", "old", new.alias("new")))


def delete(base: DataFrame, table: TableDef, keys: DataFrame, condition: str | None = None, names: dict | None = None, values: dict | None = None, expected: dict | None = None) -> Outcome:
    """Remove items; an absent one is fine unless the condition says otherwise."""
    met = _meet(base, table, keys.select(*table.keys)).withColumn("existed", F.col("old").isNotNull())
    ok = _condition(base, condition, names, values, expected)
    gone = F.when(F.lit(False), F.col("old"))
    return _publish(base, table, met.withColumn("ok", ok).select(*table.keys, "existed", "ok", "old", gone.alias("new")))


def update(
    base: DataFrame, table: TableDef, keys: DataFrame, expression: str | Update, condition: str | None = None, names: dict | None = None, values: dict | None = None,
    expected: dict | None = None, upsert: bool = True, sequential: bool = False,
) -> Outcome:
    """Apply one update to the items of ``keys``; absent items are made (``upsert``) or fail the condition."""
    scope = parse.Scope(names, values)
    made = parse.update(expression, scope, table) if isinstance(expression, str) else expression
    ok = _condition(base, condition, names, values, expected, scope=scope)
    scope.close()
    met = _meet(base, table, keys.select(*table.keys)).withColumn("existed", F.col("old").isNotNull())
    met = met.withColumn("ok", ok if upsert else ok & F.col("existed"))
    own = {c: F.col(f"`{c}`") if c in table.keys else F.col(f"old.`{c}`").alias(c) for c in base.columns}
    before = met.select("existed", "ok", "old", *(own[c].alias(c) for c in base.columns))
    changed = Updater(base.schema).columns(made, sequential)
    # where the condition fails nothing is computed, so that errors of the update don't hide it
    new = F.when(F.col("ok"), F.struct(*((changed[c] if c in changed else F.col(f"`{c}`")).alias(c) for c in base.columns)))
    return _publish(base, table, before.select(*table.keys, "existed", "ok", "old", new.alias("new")))


def batch_write(base: DataFrame, table: TableDef, puts: DataFrame | None = None, deletes: DataFrame | None = None, limit: int | None = MAX_BATCH_WRITE) -> Outcome:
    """Unconditioned puts and deletes in one merge; no key twice; ``limit`` None for bulk loads."""
    parts = []
    if puts is not None:
        parts.append(puts.select(*table.keys, F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("new")))
    if deletes is not None:
        kind = F.struct(*(F.col(f"`{c}`") for c in base.columns))
        shape = base.select(kind.alias("x")).schema["x"].dataType
        parts.append(deletes.select(*table.keys, F.lit(None).cast(shape).alias("new")))
    if not parts:
        raise ValidationError("nothing to write")
    mutations = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if limit is not None:
        if mutations.limit(limit + 1).count() > limit:
            raise ValidationError(f"at most {limit} writes")
        if not repeated_keys(mutations, table).isEmpty():
            raise ValidationError("a key is written twice")
    met = _meet(base, table, mutations).select(*table.keys, F.col("old").isNotNull().alias("existed"), F.lit(True).alias("ok"), "old", "new")
    return _publish(base, table, met)


@dataclass
class Action:
    """One action of a transaction: ``kind`` is put, update, delete or check."""

    kind: str
    key: dict[str, object]
    item: dict[str, object] | None = None
    expression: str | None = None
    condition: str | None = None
    names: dict | None = None
    values: dict | None = None


def transact(base: DataFrame, table: TableDef, actions: list[Action]) -> Outcome:
    """All actions or none, each evaluated against the same version; raises with one reason per action if any fails.

    The targets are at most 100 rows: their images are the only rows that come to the driver.
    """
    if not 1 <= len(actions) <= MAX_TRANSACT:
        raise ValidationError(f"1 to {MAX_TRANSACT} actions")
    targets = [tuple(a.key[k] for k in table.keys) for a in actions]
    if len(set(targets)) < len(targets):
        raise ValidationError("an item is the target of two actions")
    frames = []
    # one lookup of all targets; the actions work on these rows
    found = base.join(F.broadcast(_frame(base, [a.key for a in actions], list(table.keys))), list(table.keys), "left_semi").select(*base.columns)
    stored = base.sparkSession.createDataFrame([tuple(r) for r in found.collect()], base.schema)
    for n, a in enumerate(actions):
        key = _frame(base, [a.key], list(table.keys))
        if a.kind == "put":
            out = put(stored, table, _frame(base, [a.key | (a.item or {})], base.columns), a.condition, a.names, a.values)
        elif a.kind == "update":
            out = update(stored, table, key, a.expression or "", a.condition, a.names, a.values)
        elif a.kind in ("delete", "check"):
            out = delete(stored, table, key, a.condition, a.names, a.values)
        else:
            raise ValidationError(f"unknown action {a.kind!r}")
        rows = out.rows.withColumn("_n", F.lit(n))
        if a.kind == "check":
            rows = rows.withColumn("new", F.col("old"))
        frames.append(rows)
    met = frames[0]
    for f in frames[1:]:
        met = met.unionByName(f)
    outcome = {r["_n"]: r["ok"] for r in met.select("_n", "ok").collect()}
    if not all(outcome.values()):
        raise TransactionCanceled(["" if outcome[n] else "ConditionalCheckFailed" for n in range(len(actions))])
    return _publish(base, table, met.drop("_n"))


def _frame(base: DataFrame, rows: list[dict[str, object]], columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in base.schema.fields}
    one = lambda r: F.struct(*((native(literal(r[c]), kinds[c]).cast(kinds[c]) if r.get(c) is not None else F.lit(None).cast(kinds[c])).alias(c) for c in columns))
    spark = base.sparkSession
    return spark.range(1).select(F.inline(F.array(*(one(r) for r in rows)))) if rows else spark.createDataFrame([], base.select(*columns).schema)


def insert(base: DataFrame, table: TableDef, item: dict[str, object], if_not_exists: bool = False) -> Outcome:
    """Insert one item; one that exists is an error, or left alone with ``if_not_exists``."""
    row = _frame(base, [item], base.columns)
    out = put(base, table, row, "attribute_not_exists(#k)", {"#k": table.hash_key})
    if not if_not_exists and out.rows.where("not ok").count():
        raise DuplicateItem(f"the item exists in {table.name}")
    return out


def require(outcome: Outcome) -> Outcome:
    """The outcome, or an error if any condition failed."""
    if outcome.rows.where("not ok").limit(1).count():
        raise ConditionFailed("the condition does not hold")
    return outcome


def derive_indexes(base: DataFrame, table: TableDef) -> dict[str, DataFrame]:
    """Every index of a table version, derived anew: what maintenance and backfill come to."""
    return {i.name: index_rows(base, table, i) for i in table.indexes}
