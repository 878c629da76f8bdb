"""Change data capture and expiry."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.errors import ValidationError
from keyloom.model import MAX_RECORDS, VIEWS, TableDef

#: Fixed value: who removes expired items.
SERVICE_IDENTITY = '{"type":"Service","principalId":"ttl"}'


def viewed(changes: DataFrame, view: str) -> DataFrame:
    """Change records with only the images a stream view has; ``old`` and ``new`` are images, keys always stay."""
    if view not in VIEWS:
        raise ValidationError(f"stream view {view!r}")
    out = changes
    if view in ("KEYS_ONLY", "NEW_IMAGE"):
        out = out.withColumn("old", F.when(F.lit(False), F.col("old")))
    if view in ("KEYS_ONLY", "OLD_IMAGE"):
        out = out.withColumn("new", F.when(F.lit(False), F.col("new")))
    return out


def between_versions(old: DataFrame, new: DataFrame, table: TableDef, unchanged: bool = False) -> DataFrame:
    """Change records that lead from one version of a table to another; ``unchanged`` keeps overwrites without effect."""
    before = old.select(F.struct("*").alias("old"), *(F.col(f"`{k}`") for k in table.keys))
    after = new.select(F.struct("*").alias("new"), *(F.col(f"`{k}`") for k in table.keys))
    both = before.join(after, list(table.keys), "full")
    event = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    out = both.select(*table.keys, event.alias("event"), "old", "new")
    return out if unchanged else out.where(~F.col("old").eqNullSafe(F.col("new")))


def from_log(log: DataFrame, keys: list[str], sequence: str, removed: Column | None = None) -> DataFrame:
    """Change records of an ordered log of images per key: the image before is the key's previous row, unless that was a removal.

    ``removed`` marks rows that remove the item; removals of absent items change nothing and are left out.
    """
    gone = F.lit(False) if removed is None else F.coalesce(removed, F.lit(False))
    image = F.struct(*(F.col(f"`{c}`") for c in log.columns if c not in (*keys, sequence)))
    rows = log.select(*keys, sequence, F.when(~gone, image).alias("new"))
    order = Window.partitionBy(*keys).orderBy(sequence)
    rows = rows.withColumn("old", F.lag("new").over(order)).where(F.col("old").isNotNull() | F.col("new").isNotNull())
    event = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    return rows.select(*keys, sequence, event.alias("event"), "old", "new")


def next_sequence(records: DataFrame, sequence: str = "seq") -> DataFrame:
    """One row: the number the next record gets, 1 for an empty stream."""
    return records.agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next_sequence"))


def iterator(kind: str, sequence: int | None = None, latest: int | None = None, stream: str = "") -> str:
    """An opaque token for a place in a stream: TRIM_HORIZON, LATEST, AT_SEQUENCE_NUMBER or AFTER_SEQUENCE_NUMBER."""
    if kind.endswith("SEQUENCE_NUMBER") and sequence is None:
        raise ValidationError(f"{kind} needs a sequence number")
    places = {"TRIM_HORIZON": 0, "LATEST": latest or 0, "AT_SEQUENCE_NUMBER": (sequence or 0) - 1, "AFTER_SEQUENCE_NUMBER": sequence or 0}
    if kind not in places:
        raise ValidationError(f"iterator type {kind!r}")
    return base64.urlsafe_b64encode(json.dumps([stream, places[kind]]).encode()).decode()


def position(token: str) -> tuple[str, int]:
    """Stream and position of a token."""
    try:
        stream, at = json.loads(base64.urlsafe_b64decode(token))
        return str(stream), int(at)
    except ValueError as bad:
        raise ValidationError("the iterator is damaged") from bad


def get_records(records: DataFrame, after: int | str, limit: int = MAX_RECORDS, sequence: str = "seq") -> DataFrame:
    """The records after a position or iterator token, in order, at most ``limit``."""
    if not 1 <= limit <= MAX_RECORDS:
        raise ValidationError(f"the limit must be 1 to {MAX_RECORDS}")
    at = position(after)[1] if isinstance(after, str) else after
    return records.where(F.col(sequence) > at).orderBy(sequence).limit(limit)


def next_iterator(page: DataFrame, after: int | str, sequence: str = "seq") -> str:
    """The token that goes on after a page of records; the same place if the page is empty."""
    stream, at = position(after) if isinstance(after, str) else ("", after)
    last = page.agg(F.max(sequence).alias("m")).first()["m"]
    return base64.urlsafe_b64encode(json.dumps([stream, at if last is None else int(last)]).encode()).decode()


def list_streams(tables: list[TableDef]) -> list[dict[str, str]]:
    """The streams of a catalog, each with one shard."""
    return [{"table_name": t.name, "stream": f"{t.name}/stream", "view": t.stream_view, "shard_id": f"shardId-00000001-{t.name}"} for t in sorted(tables, key=lambda t: t.name) if t.stream_view]


def expired(kind: str, attribute: str, now: int) -> Column:
    """Whether a row is past its time: the attribute is a whole, non-negative number below ``now``.

    ``kind`` is the attribute's tag; text and fractions never expire. ``now`` is a parameter, the clock is the caller's.
    """
    column = F.col(f"`{attribute}`")
    if kind != "N":
        return F.lit(False)
    return F.coalesce((column >= 0) & (column < now) & (column == F.floor(column)), F.lit(False))


def sweep(base: DataFrame, table: TableDef, now: int) -> tuple[DataFrame, DataFrame]:
    """The version without expired items, and the REMOVE records of the service for them."""
    from keyloom.expr.compile import tag_of

    if not table.ttl_attribute or table.ttl_attribute not in base.columns:
        return base, base.limit(0).select(*table.keys, F.lit("REMOVE").alias("event"), F.struct("*").alias("old"), F.lit(SERVICE_IDENTITY).alias("user_identity"))
    past = expired(tag_of(base.schema[table.ttl_attribute].dataType), table.ttl_attribute, now)
    removed = base.where(past).select(*table.keys, F.lit("REMOVE").alias("event"), F.struct("*").alias("old"), F.lit(SERVICE_IDENTITY).alias("user_identity"))
    return base.where(~past), removed
