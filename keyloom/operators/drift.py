"""Files whose fields drift: one consistent table of everything, and a report of every change.

``rescue_ingest`` enforces a target schema of the key columns and keeps all else of an item as JSON in ``rescued``; nothing is
lost, whatever a file brings. ``promote`` turns approved fields into typed columns by replaying the rescued values;
values that don't fit stay rescued. ``drift_report`` reads the same rescued column: the lines of an item meet
in one shuffle by key, where a pass over them counts paths, tags and matching values, folded before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.tagged import dumps, parse_object, strings, tagged
from keyloom.operators.orphans import micros
from keyloom.session import materialize

#: The bit of each tag in a set of types; NULL has none.
TAG_BITS = {"S": 1, "N": 2, "B": 4, "BOOL": 8, "SS": 16, "NS": 32, "BS": 64, "L": 128, "M": 256, "NULL": 0}

#: A rename needs so many shared items, and so many fifths of them with the same value.
LEAST_ITEMS, MATCH_FIFTHS = 3, 4

#: A table is read in one task unless it has this fraction of all lines; then its items are spread over so many.
SPREAD = 64

#: Counters a task holds before it hands them on.
HELD = 50_000

INGESTED = "table_name string, file_name string, exported_us bigint, line_id bigint, line_no int, pk string, sk string, rescued string"
_STATS = "kind string, table_name string, former string, file_name string, path string, new_path string, n bigint, types int"


def _key_text(value: object) -> str | None:
    node = tagged(value)
    if node is None or node[0] == "NULL":
        return None
    return node[1] if isinstance(node[1], str) else dumps(node[1])


def _ordered_sets(value: object) -> object:
    """The value with the members of its sets in order, as sets have none of their own."""
    if isinstance(value, dict):
        return {k: sorted(v, key=str) if k in ("SS", "NS", "BS") and isinstance(v, list) else _ordered_sets(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_ordered_sets(v) for v in value]
    return value


def _ingest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, pks, sks, rescued = [], [], [], []
        for i, text in enumerate(batch.column("item_json").to_pylist()):
            item = parse_object(text)
            if item is not None and len(item) == 1 and "Item" in item:
                item = item["Item"] if isinstance(item["Item"], dict) else None
            if item is None:
                continue
            keep.append(i)
            pks.append(_key_text(item.get("pk")))
            sks.append(_key_text(item.get("sk")) or "")
            rescued.append(dumps({k: v for k, v in item.items()}))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in ("table_name", "file_name", "exported_us", "line_id", "line_no")] + [strings(pks), strings(sks), strings(rescued)],
            names=["table_name", "file_name", "exported_us", "line_id", "line_no", "pk", "sk", "rescued"],
        )


def rescue_ingest(lines: DataFrame) -> DataFrame:
    """All items of export lines in one table: where each stands, its keys, the whole item as canonical JSON in ``rescued``.

    A line is a bare item or ``{"Item": item}``; null, empty, cut-off and non-object lines are no items. A missing or
    NULL-tagged key reads as null (``pk``) or '' (``sk``). Repeated lines are all kept. ``lines`` needs ``line_id,
    table_name, file_name, exported_at, line_no, item_json``, other columns are pruned.
    """
    read = lines.select("table_name", "file_name", micros(lines, "exported_at").alias("exported_us"), "line_id", "line_no", "item_json")
    return read.where(F.col("item_json").isNotNull()).mapInArrow(_ingest, INGESTED)


def promote(ingested: DataFrame, **approved: str) -> DataFrame:
    """Replay approved attributes (name to SQL type) out of ``rescued`` into typed columns.

    A value that casts leaves ``rescued``; one that doesn't stays there and the column is null. Attributes tagged
    with maps, lists or sets are replayed as their JSON text where the type is string.
    """
    fields = F.from_json("rescued", "map<string,string>")
    typed = {}
    for name, kind in approved.items():
        value = F.try_element_at(F.col("_fields"), F.lit(name))
        text = F.coalesce(*(F.get_json_object(value, f"$.{tag}") for tag in ("S", "N", "BOOL", "B", "SS", "NS", "BS", "L", "M")))
        typed[name] = text.try_cast(kind)
    out = ingested.withColumn("_fields", fields).withColumns(typed)
    taken = F.filter(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in approved)), lambda x: x.isNotNull())
    left = F.map_entries(F.map_filter("_fields", lambda k, _: ~F.array_contains(taken, k)))
    name_json = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    parts = F.transform(left, lambda e: F.concat(name_json(e["key"]), F.lit(":"), e["value"]))
    return out.withColumn("rescued", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).drop("_fields")


def _paths(item: dict, prefix: str, into: dict[str, list]) -> None:
    """Per path its types as bits, then its values."""
    todo = [(prefix, iter(item.items()))]
    while todo:
        prefix, attributes = todo[-1]
        for name, value in attributes:
            path, bit, inner = prefix + name, 0, None
            if type(value) is dict and len(value) == 1:
                (tag, content), = value.items()
                bit = TAG_BITS.get(tag, 0)
                if tag == "M" and type(content) is dict:
                    inner = content
            entry = into.get(path)
            if entry is None:
                into[path] = [bit, value]
            else:
                entry[0] |= bit
                entry.append(value)
            if inner:
                todo.append((path + ".", iter(inner.items())))
                break
        else:
            todo.pop()


def _count_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by item, then by file; what is held is one item in two files, and the counters."""
    counts: dict[tuple, int] = {}
    types: dict[tuple, dict[str, int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [("path", t, "", f, p, "", 0, bits) for (t, f), own in types.items() for p, bits in own.items()]
        rows += [("match" if q else "had", t, g, f, p, q, n, 0) for (t, g, f, p, q), n in counts.items()]
        counts.clear()
        types.clear()
        columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays(
            [strings(list(c)) for c in columns[:6]] + [pa.array(columns[6], pa.int64()), pa.array(columns[7], pa.int32())],
            names=["kind", "table_name", "former", "file_name", "path", "new_path", "n", "types"],
        )

    def compare(table: str, former: tuple[str, dict], latter: tuple[str, dict]) -> None:
        (old_file, old), (new_file, new) = former, latter
        gone, come = [p for p in old if p not in new], [q for q in new if q not in old]
        if not gone:
            return
        spelled = lambda entry: {dumps(_ordered_sets(v)) for v in entry[1:]}
        found: dict[str, list[str]] = {}
        for q in come:
            for v in spelled(new[q]):
                found.setdefault(v, []).append(q)
        for p in gone:
            key = (table, old_file, new_file, p, "")
            counts[key] = counts.get(key, 0) + 1
            if found:
                for q in {q for v in spelled(old[p]) for q in found.get(v, ())}:
                    key = (table, old_file, new_file, p, q)
                    counts[key] = counts.get(key, 0) + 1

    item: tuple = ()
    held = 0
    before: tuple[str, dict] | None = None
    now: tuple[str, dict] | None = None
    for batch in batches:
        for table, file, pk, sk, text in zip(*(batch.column(c).to_pylist() for c in ("table_name", "file_name", "pk", "sk", "rescued"))):
            paths: dict[str, list] = {}
            _paths(parse_object(text) or {}, "", paths)
            own = types.setdefault((table, file), {})
            for p, entry in paths.items():
                if own.get(p, -1) | entry[0] != own.get(p):
                    own[p] = own.get(p, 0) | entry[0]
                    held += 1
            if pk is None:
                continue
            if (table, pk, sk) != item:
                if before and now:
                    compare(item[0], before, now)
                item, before, now = (table, pk, sk), None, (file, paths)
            elif now and now[0] == file:
                for p, entry in paths.items():
                    mine = now[1].setdefault(p, [0])
                    mine.extend(v for v in entry[1:] if v not in mine[1:])
            else:
                if before and now:
                    compare(table, before, now)
                before, now = now, (file, paths)
            if len(counts) + held > HELD:
                yield flush()
                held = 0
    if before and now:
        compare(item[0], before, now)
    yield flush()


def large_tables(lines: DataFrame) -> list[str]:
    """Tables with at least a ``SPREAD``-th of all lines; no more than ``SPREAD`` names, whatever the data."""
    sizes = lines.where(F.col("table_name").isNotNull()).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.sum("n").alias("n")).select(F.ceil(F.col("n") / SPREAD)).scalar()
    return [r.table_name for r in sizes.where(F.col("n") >= least).select("table_name").collect()]


def files_in_order(lines: DataFrame) -> DataFrame:
    """``table_name``, ``file_name``, the file just before it and the one after (null at the ends), by export time, then name."""
    order = Window.partitionBy("table_name").orderBy("exported_us", "file_name")
    files = lines.where(F.col("table_name").isNotNull() & F.col("file_name").isNotNull() & F.col("exported_at").isNotNull())
    files = files.groupBy("table_name", "file_name").agg(F.min(micros(lines, "exported_at")).alias("exported_us"))
    return files.select("table_name", "file_name", F.lag("file_name").over(order).alias("former"), F.lead("file_name").over(order).alias("latter"))


def drift_report(lines: DataFrame) -> DataFrame:
    """``table_name, file_name, change, path, new_path``: every change of a file against the one before it in its table.

    Paths are attribute names through maps joined by '.'; lists aren't entered. ``retyped``: the sets of tags differ, NULL not
    counted, neither empty. ``renamed``: of at least 3 items of both files that have ``path`` in the former, four
    fifths have the same tagged value under ``new_path``, which only the latter file has, as only the former has ``path``.
    ``removed``, ``added``: the other paths only one file has. Lines without table, file or export time belong to no file and
    are left out; of an item on several lines of a file any line's value counts. Empty input gives no rows.
    """
    known = F.col("table_name").isNotNull() & F.col("file_name").isNotNull() & F.col("exported_us").isNotNull()
    # a table's lines meet in one task, where their counts fold; those of a large table are spread by item, lines without a key anyhow
    item = F.when(F.col("pk").isNull(), F.xxhash64("rescued")).otherwise(F.xxhash64("pk", "sk"))
    large = large_tables(lines)
    part = F.when(F.col("table_name").isin(*large), F.pmod(item, F.lit(SPREAD))) if large else F.lit(0)
    met = (
        rescue_ingest(lines)
        .where(known)
        .repartition("table_name", part)
        .sortWithinPartitions("table_name", "pk", "sk", "exported_us", "file_name")
        .select("table_name", "file_name", "pk", "sk", "rescued")
    )
    stats = met.mapInArrow(_count_changes, _STATS).groupBy("kind", "table_name", "former", "file_name", "path", "new_path")
    stats = materialize(stats.agg(F.sum("n").alias("n"), F.bit_or("types").alias("types")), "drift-stats")
    files = files_in_order(lines)

    here = stats.where("kind = 'path'").select("table_name", "file_name", "path", "types").join(files, ["table_name", "file_name"])
    none = F.lit(None).cast("int")
    pairs = materialize(
        here.where("former is not null").select("table_name", "file_name", "path", F.col("types").alias("new"), none.alias("old"))
        .unionByName(here.where("latter is not null").select("table_name", F.col("latter").alias("file_name"), "path", none.alias("new"), F.col("types").alias("old")))
        .groupBy("table_name", "file_name", "path")
        .agg(F.max("new").alias("new"), F.max("old").alias("old"))
        .where("new is null or old is null or (old <> new and old > 0 and new > 0)"),
        "drift-pairs",
    )
    file_path = ["table_name", "file_name", "path"]
    retyped = pairs.where("new is not null and old is not null").select(*file_path, F.lit("retyped").alias("change"), F.lit("").alias("new_path"))
    gone = pairs.where("new is null").select(*file_path)
    come = pairs.where("old is null").select("table_name", "file_name", F.col("path").alias("new_path"))

    between = ["table_name", "former", "file_name", "path"]
    renamed = materialize(
        stats.where("kind = 'match'").select(*between, "new_path", "n")
        .join(stats.where(f"kind = 'had' and n >= {LEAST_ITEMS}").select(*between, F.col("n").alias("items")), between)
        .where(F.col("n") * 5 >= F.col("items") * MATCH_FIFTHS)
        .join(files.select("table_name", "file_name", "former"), ["table_name", "file_name", "former"], "left_semi")
        .join(gone, file_path, "left_semi")
        .join(come, ["table_name", "file_name", "new_path"], "left_semi")
        .select(*file_path, F.lit("renamed").alias("change"), "new_path"),
        "drift-renamed",
    )
    removed = gone.join(renamed, file_path, "left_anti").select(*file_path, F.lit("removed").alias("change"), F.lit("").alias("new_path"))
    added = (
        come.join(renamed, ["table_name", "file_name", "new_path"], "left_anti")
        .select("table_name", "file_name", F.col("new_path").alias("path"), F.lit("added").alias("change"), F.lit("").alias("new_path"))
    )
    out = retyped.unionByName(renamed).unionByName(removed).unionByName(added)
    return out.select("table_name", "file_name", "change", "path", "new_path")
