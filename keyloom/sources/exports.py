"""Export files of tagged JSON lines: discovery, reading, table descriptions, entity models."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.errors import ValidationError
from keyloom.model import TableDef

#: Longest line that is read as an item.
MAX_LINE_CHARS = 4 << 20


def discover(spark: SparkSession, root: str, tables: list[str] | None = None) -> DataFrame:
    """Export files under ``root``: ``table_name`` and ``path``, in order.

    Two layouts are known: ``<root>/<table>/data/*.json[.gz]``, and files directly under ``root``, whose table is the name up to the first dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl,json.gz,jsonl.gz}").load(root).select("path")
    nested = F.regexp_extract("path", r"/([^/]+)/data/[^/]+$", 1)
    flat = F.regexp_extract("path", r"/([^/.]+)[^/]*$", 1)
    named = files.withColumn("table_name", F.when(nested != "", nested).otherwise(flat))
    out = named if tables is None else named.where(F.col("table_name").isin(*tables))
    return out.select("table_name", "path").orderBy("table_name", "path")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of plain or gzipped files with their file: ``path``, ``value``."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")


def as_items(lines: DataFrame, column: str = "value") -> DataFrame:
    """``item`` (VARIANT of tagged JSON, the content of ``Item`` where wrapped) and ``bad``: true for lines that are no items."""
    text = F.col(column)
    parsed = F.when(F.length(text) <= MAX_LINE_CHARS, F.try_parse_json(text))
    item = F.coalesce(F.try_variant_get(parsed, "$.Item", "variant"), parsed)
    is_object = F.try_variant_get(item, "$", "map<string,variant>").isNotNull()
    return lines.withColumn("item", F.when(is_object, item)).withColumn("bad", ~F.coalesce(is_object, F.lit(False)))


def skipped(items: DataFrame) -> DataFrame:
    """How many lines were read and how many were no items."""
    return items.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_skipped"))


def attribute(item: Column | str, name: str, tag: str, kind: str = "string") -> Column:
    """One attribute of an item as a native column, NULL where it is missing or of another tag."""
    column = F.col(item) if isinstance(item, str) else item
    return F.try_variant_get(column, f"$['{name}'].{tag}", "string").try_cast(kind)


def typed(items: DataFrame, table: TableDef, **attributes: tuple[str, str]) -> DataFrame:
    """Items in native columns: the table's keys, and ``attributes`` given as (tag, SQL type)."""
    kinds = dict(table.key_types)
    native = {"S": "string", "N": "decimal(38,10)", "B": "string"}
    keys = {k: (kinds.get(k, "S"), native[kinds.get(k, "S")]) for k in table.keys}
    return items.where("not bad").select(*(attribute("item", n, tag, kind).alias(n) for n, (tag, kind) in (keys | attributes).items()))


def load_tables(texts: list[str]) -> list[TableDef]:
    """Table definitions out of description files."""
    return [TableDef.from_description(t) for t in texts]


@dataclass(frozen=True)
class Entity:
    """One entity of a single-table model: attribute types and key templates like ``user#${id}``."""

    name: str
    attributes: dict[str, str]
    templates: dict[str, str]


def read_entities(text: str) -> tuple[list[Entity], dict[str, dict]]:
    """Entities and index definitions of an entity model in JSON (``{"indexes": .., "models": {name: {attr: {"type", "value"}}}}``)."""
    model = json.loads(text)
    if "models" not in model:
        raise ValidationError("the model has no entities")
    out = []
    for name, fields in model["models"].items():
        out.append(Entity(name, {a: str(f.get("type", "string")) for a, f in fields.items()}, {a: f["value"] for a, f in fields.items() if isinstance(f.get("value"), str) and "${" in f["value"]}))
    return out, model.get("indexes", {})


def render(template: str) -> Column:
    """A key template as a column; NULL if an attribute it names is."""
    parts = re.split(r"\$\{([^}]+)\}", template)
    return F.concat(*(F.col(f"`{p}`").cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))
