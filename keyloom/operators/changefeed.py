"""Rebuild the current state of keyed tables from a feed of inserts, updates and deletes.

Changes may be repeated, late and out of order; only their log sequence decides. Copies of a change and all
changes of an item share the item's key, so one shuffle by key serves both steps: a window orders an item's changes
by sequence, latest first, copies by arrival, and rank 1 is the change the item comes from. Catalyst turns
the rank filter into a WindowGroupLimit before the exchange, so an input partition sends one row per key and a hot
key never gathers its history in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.numbers import canonical_number

#: The usable change events.
EVENTS = ("INSERT", "MODIFY", "REMOVE")

_BLANKS = " \t\r\n\f\v"


def key_names(catalog: DataFrame) -> DataFrame:
    """``table_name``, ``hash_attr``, ``range_attr`` (null for tables without one) of a table catalog."""
    schema = F.from_json("key_schema", "array<struct<AttributeName:string,KeyType:string>>")
    named = lambda kind: F.get(F.filter(schema, lambda k: k["KeyType"] == kind), F.lit(0))["AttributeName"]
    return catalog.where(F.col("table_name").isNotNull()).select("table_name", named("HASH").alias("hash_attr"), named("RANGE").alias("range_attr")).dropDuplicates(["table_name"])


def _bare(keys: Column, attr: Column) -> Column:
    """The bare text of a key attribute of a parsed key map; numbers in canonical spelling."""
    tagged = F.try_element_at(keys, attr)
    return F.coalesce(
        F.try_element_at(tagged, F.lit("S")), canonical_number(F.try_element_at(tagged, F.lit("N"))), F.get(F.map_values(tagged), F.lit(0))
    )


def sequence_value(text: Column) -> Column:
    """The whole number spelled by ``text`` (blanks around, a sign and leading zeros allowed) as bigint, else null."""
    bare = F.btrim(text.cast("string"), F.lit(_BLANKS))
    return F.when(bare.rlike("^[+-]?[0-9]+$"), F.regexp_replace(bare, "^([+-]?)0+(?=[0-9])", "$1").try_cast("bigint"))


def read_changes(records: DataFrame, catalog: DataFrame, *carry: str) -> DataFrame:
    """One row per record whose keys can be read: ``id``, ``table_name``, ``pk``, ``sk`` ('' for tables without one), ``event``, ``seq``, ``created_at`` and the columns of ``carry``.

    ``event`` is null unless it is usable, ``seq`` is null unless it is a whole number. Records with unreadable keys
    or a null table are left out, as no item can be named for them; key names of tables missing in the catalog are
    taken as pk and sk.
    """
    event = F.upper(F.btrim(F.col("event_name"), F.lit(_BLANKS)))
    parsed = records.where(F.col("table_name").isNotNull()).select(
        "id",
        "table_name",
        F.when(event.isin(*EVENTS), event).alias("event"),
        sequence_value(F.col("sequence_number")).alias("seq"),
        "created_at",
        F.from_json("keys_json", "map<string,map<string,string>>").alias("_keys"),
        *carry,
    )
    named = parsed.join(key_names(catalog), "table_name", "left")
    has_schema = F.col("hash_attr").isNotNull()
    return named.select(
        "id",
        "table_name",
        _bare(F.col("_keys"), F.coalesce("hash_attr", F.lit("pk"))).alias("pk"),
        F.coalesce(_bare(F.col("_keys"), F.when(has_schema, F.col("range_attr")).otherwise("sk")), F.lit("")).alias("sk"),
        "event",
        "seq",
        "created_at",
        *carry,
    ).where(F.col("pk").isNotNull())


def usable(changes: DataFrame) -> DataFrame:
    """Changes with a usable event and number."""
    return changes.where(F.col("event").isNotNull() & F.col("seq").isNotNull())


def distinct_changes(changes: DataFrame) -> DataFrame:
    """One row per (table, event, number): the first delivery of each change, in log order columns intact."""
    first = Window.partitionBy("table_name", "event", "seq").orderBy("id")
    return usable(changes).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The change every item comes from, removals included: highest number first, of copies the first delivered."""
    order = Window.partitionBy("table_name", "pk", "sk").orderBy(F.col("seq").desc(), F.col("id"))
    return usable(changes).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def current_state(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Items alive after all changes; ``base`` (the columns of ``changes``, ``seq`` the number it stands at) is merged below them.

    A base row is a change of its own that any higher number overrides, so the merge needs no join: base and feed
    share the ranking shuffle. INSERT and MODIFY make an item alive without an image or an earlier record; REMOVE of
    an absent item does nothing. Ties between different events of one number go to the first delivered.
    """
    merged = changes if base is None else changes.unionByName(base)
    return latest_changes(merged).where(F.col("event") != "REMOVE")
