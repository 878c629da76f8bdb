"""Queries over the physical tables of the store: one group per data problem, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import changefeed, drift, hotkeys, nested, orphans
from keyloom.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_keys(load(spark, sf_dir, "items")).select("table_name", "pk")


def p1_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.key_totals(load(spark, sf_dir, "items"))


def p1_key_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.key_load(load(spark, sf_dir, "items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(load(spark, sf_dir, "export_lines"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of all files in one table, a few approved attributes typed, the rest rescued."""
    approved = {"region": "bigint", "phone": "bigint", "loginCount": "bigint", "device": "bigint", "depot": "string", "total": "decimal(38,10)"}
    return drift.promote(drift.rescue_ingest(load(spark, sf_dir, "export_lines")), **approved)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = nested.documents(load(spark, sf_dir, "items"), "row_id", ("item_json", "items.item_json"))
    images = nested.documents(
        load(spark, sf_dir, "stream_records"), "id", ("new_image", "stream_records.new_image"), ("old_image", "stream_records.old_image")
    )
    return items.unionByName(images)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.element_rows(_documents(spark, sf_dir)).select("source_field", "record_id", "child_path", "parent_path")


def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.variants(nested.element_rows(_documents(spark, sf_dir), scalars=True))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtype table: the order lines of both images, all variants in typed columns."""
    return nested.subtype(nested.element_rows(_documents(spark, sf_dir), scalars=True), "lines[]", sku="string", qty="bigint").drop("variant")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables of all kinds, columns and types derived from the data: a row per element, a struct per kind."""
    return nested.all_subtypes(_documents(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.read_changes(load(spark, sf_dir, "stream_records"), load(spark, sf_dir, "table_catalog"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_state(_changes(spark, sf_dir)).select("table_name", "pk", "sk", F.col("seq").alias("sequence_number"))


def p4_distinct_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct changes per table and event."""
    changes = changefeed.distinct_changes(_changes(spark, sf_dir))
    return changes.groupBy("table_name", "event").agg(F.count(F.lit(1)).alias("n_changes"), F.max("seq").alias("last_seq"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, items = load(spark, sf_dir, "index_entries"), load(spark, sf_dir, "items")
    changes = _changes(spark, sf_dir)
    references = entries.select("entry_id", "table_name", F.col("table_pk").alias("pk"), F.col("table_sk").alias("sk"), orphans.micros(entries, "indexed_at").alias("at"))
    stored = items.select("table_name", "pk", "sk", orphans.micros(items, "loaded_at").alias("arrival"), F.lit(True).alias("present"))
    seen = changes.select("table_name", "pk", "sk", (F.col("created_at") * 1_000_000).alias("arrival"), F.lit(False).alias("present"))
    alive = changefeed.current_state(changes).select("table_name", "pk", "sk", F.lit(None).cast("bigint").alias("arrival"), F.lit(True).alias("present"))
    return orphans.find_orphans(references, stored.unionByName(seen).unionByName(alive))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("entry_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_key_totals, p1_key_load, p2_found, p2_table, p3_found, p3_variants, p3_lines, p3_tables, p4_found, p4_distinct_changes, p5_found, p5_report)
}

_CHANGES = """
changes as (
  select r.id, r.table_name, e.event, try_cast(case when regexp_full_match(trim(r.sequence_number), '[+-]?[0-9]+') then trim(r.sequence_number) end as bigint) as seq,
    coalesce(json_extract_string(r.keys_json, '$.' || h || '.S'), json_extract_string(r.keys_json, '$.' || h || '.N')) as pk,
    coalesce(json_extract_string(r.keys_json, '$.' || s || '.S'), json_extract_string(r.keys_json, '$.' || s || '.N'), '') as sk,
    r.created_at
  from stream_records r
  join (select table_name,
          json_extract_string(key_schema, '$[0].AttributeName') as h,
          coalesce(json_extract_string(key_schema, '$[1].AttributeName'), '-') as s from table_catalog) c on c.table_name = r.table_name
  cross join lateral (select case when upper(trim(r.event_name)) in ('INSERT', 'MODIFY', 'REMOVE') then upper(trim(r.event_name)) end as event) e),
usable as (select * from changes where event is not null and seq is not null and pk is not null),
alive as (
  select table_name, pk, sk, seq from (
    select *, row_number() over (partition by table_name, pk, sk order by seq desc, id) as n from usable) t
  where n = 1 and event <> 'REMOVE')"""

_ORPHANS = f"""
with {_CHANGES},
seen as (select table_name, pk, sk, min(created_at) as s from changes where pk is not null group by all),
stored as (select table_name, pk, coalesce(sk, '') as sk, min(loaded_at) as loaded_at from items where pk is not null group by all),
judged as (
  select e.entry_id, e.table_name, e.indexed_at,
    case when i.pk is null and a.pk is null then 'absent'
         when least(coalesce(epoch_us(i.loaded_at), 9223372036854775807), coalesce(s.s * 1000000, 9223372036854775807)) > epoch_us(e.indexed_at)
           and (i.loaded_at is not null or s.s is not null) then 'late' end as kind
  from index_entries e
  left join stored i on i.table_name = e.table_name and i.pk = e.table_pk and i.sk = coalesce(e.table_sk, '')
  left join alive a on a.table_name = e.table_name and a.pk = e.table_pk and a.sk = coalesce(e.table_sk, '')
  left join seen s on s.table_name = e.table_name and s.pk = e.table_pk and s.sk = coalesce(e.table_sk, '')
  where e.table_pk is not null)"""

_TREES = """
trees as (
  select 'items.item_json' as source_field, i.row_id as record_id, t.fullkey, t.type from (select * from items where json_valid(item_json)) i, json_tree(i.item_json) t
  union all
  select 'stream_records.new_image', r.id, t.fullkey, t.type from (select * from stream_records where json_valid(new_image)) r, json_tree(r.new_image) t
  union all
  select 'stream_records.old_image', r.id, t.fullkey, t.type from (select * from stream_records where json_valid(old_image)) r, json_tree(r.old_image) t),
maps as (
  select source_field, record_id, substr(fullkey, 3) as here, regexp_extract(substr(fullkey, 3), '^(.*\\.L\\[[0-9]+\\]\\.M)\\..*\\.L\\[[0-9]+\\]\\.M$', 1) as above
  from trees where type = 'OBJECT' and regexp_matches(fullkey, '\\.L\\[[0-9]+\\]\\.M$')),
bare as (
  select source_field, record_id,
    regexp_replace(replace(replace(here, '.L[', '['), '.M.', '.'), '\\.M$', '') as child_path,
    regexp_replace(replace(replace(above, '.L[', '['), '.M.', '.'), '\\.M$', '') as parent_path
  from maps)"""

_DRIFT = """
with objects as (
  select table_name, file_name, exported_at, line_id, case when json_type(item_json) = 'OBJECT' then
      case when json_keys(item_json) = ['Item'] then json_extract(item_json, '$.Item') else item_json::json end end as item
  from export_lines where json_valid(item_json)),
nodes as (
  select o.table_name, o.file_name, o.line_id, coalesce(o.item->>'$.pk.S', o.item->>'$.pk.N') as pk,
    coalesce(o.item->>'$.sk.S', o.item->>'$.sk.N', '') as sk, substr(t.fullkey, 3) as k, t.type, t.value
  from (select * from objects where json_type(item) = 'OBJECT') o, json_tree(o.item) t
  where not contains(t.fullkey, '[') and t.fullkey <> '$' and len(string_split(t.fullkey, '.')) % 2 = 0),
here as (
  select table_name, file_name, line_id, pk, sk, replace(replace(k, '.M.', '.'), '"', '') as path, value as v, json_keys(value)[1] as tag from nodes),
files as (
  select table_name, file_name, lag(file_name) over w as former, lead(file_name) over w as latter
  from (select table_name, file_name, min(exported_at) as x from export_lines group by all) f
  window w as (partition by table_name order by x, file_name)),
per_file as (
  select table_name, file_name, path, coalesce(list_sort(list(distinct tag) filter (where tag <> 'NULL')), []::varchar[]) as tags from here group by all),
olds as (select f.table_name, f.latter as file_name, p.path, p.tags from per_file p join files f using (table_name, file_name) where f.latter is not null),
news as (select f.table_name, f.file_name, p.path, p.tags from per_file p join files f using (table_name, file_name) where f.former is not null),
both_sides as (
  select coalesce(n.table_name, o.table_name) as table_name, coalesce(n.file_name, o.file_name) as file_name, coalesce(n.path, o.path) as path,
    n.tags as new_tags, o.tags as old_tags, n.path is not null as is_new, o.path is not null as is_old
  from news n full join olds o on n.table_name = o.table_name and n.file_name = o.file_name and n.path = o.path),
old_values as (
  select distinct b.table_name, b.file_name, b.path, h.pk, h.sk, h.v::varchar as v
  from both_sides b join files f on f.table_name = b.table_name and f.file_name = b.file_name
  join here h on h.table_name = b.table_name and h.file_name = f.former and h.path = b.path
  where b.is_old and not b.is_new and h.pk is not null),
new_values as (
  select distinct b.table_name, b.file_name, b.path, h.pk, h.sk, h.v::varchar as v
  from both_sides b join here h on h.table_name = b.table_name and h.file_name = b.file_name and h.path = b.path
  where b.is_new and not b.is_old and h.pk is not null),
shared as (
  select o.table_name, o.file_name, o.path, count(distinct (o.pk, o.sk)) as n
  from old_values o semi join (select distinct table_name, file_name, pk, sk from here) h
    on h.table_name = o.table_name and h.file_name = o.file_name and h.pk = o.pk and h.sk = o.sk group by all),
matches as (
  select o.table_name, o.file_name, o.path, n.path as new_path, count(distinct (o.pk, o.sk)) as n
  from old_values o join new_values n on o.table_name = n.table_name and o.file_name = n.file_name and o.pk = n.pk and o.sk = n.sk and o.v = n.v group by all),
renames as (
  select m.table_name, m.file_name, m.path, m.new_path from matches m join shared s using (table_name, file_name, path) where s.n >= 3 and m.n * 5 >= s.n * 4)
select table_name, file_name, 'retyped' as change, path, '' as new_path from both_sides
  where is_new and is_old and len(new_tags) > 0 and len(old_tags) > 0 and new_tags <> old_tags
union all select table_name, file_name, 'renamed', path, new_path from renames
union all select b.table_name, b.file_name, 'removed', b.path, '' from both_sides b anti join renames r
    on r.table_name = b.table_name and r.file_name = b.file_name and r.path = b.path where b.is_old and not b.is_new
union all select b.table_name, b.file_name, 'added', b.path, '' from both_sides b anti join renames r
    on r.table_name = b.table_name and r.file_name = b.file_name and r.new_path = b.path where b.is_new and not b.is_old
"""

ORACLES = {
    "p1_found": """
        with t as (select table_name, pk, count(*) as n, sum(coalesce(item_size, 0)) as b from items group by all)
        select table_name, pk from t where pk <> ''
          and (n * 100 >= (select sum(n) from t) or ((select sum(b) from t) > 0 and b * 100 >= (select sum(b) from t)))""",
    "p1_key_totals": "select table_name, pk, count(*) as n_rows, cast(sum(coalesce(item_size, 0)) as bigint) as n_bytes from items group by all",
    "p2_found": _DRIFT,
    "p3_found": f"with {_TREES} select source_field, record_id, child_path, parent_path from bare",
    "p3_lines": f"""
        with {_TREES},
        texts as (
          select 'items.item_json' as source_field, row_id as record_id, item_json as j from items where json_valid(item_json)
          union all select 'stream_records.new_image', id, new_image from stream_records where json_valid(new_image)
          union all select 'stream_records.old_image', id, old_image from stream_records where json_valid(old_image))
        select b.source_field, b.record_id, b.child_path, b.parent_path,
          json_extract_string(t.j, '$.lines.L[' || regexp_extract(b.child_path, '[0-9]+') || '].M.sku.S') as sku,
          try_cast(json_extract_string(t.j, '$.lines.L[' || regexp_extract(b.child_path, '[0-9]+') || '].M.qty.N') as bigint) as qty
        from bare b join texts t on t.source_field = b.source_field and t.record_id = b.record_id
        where regexp_full_match(b.child_path, 'lines\\[[0-9]+\\]')""",
    "p4_found": f"with {_CHANGES} select table_name, pk, sk, seq as sequence_number from alive",
    "p4_distinct_changes": f"""
        with {_CHANGES}
        select table_name, event, count(distinct seq) as n_changes, max(seq) as last_seq from usable group by all""",
    "p5_found": _ORPHANS + " select entry_id from judged where kind is not null",
    "p5_report": _ORPHANS + " select table_name, strftime(indexed_at, '%Y-%m') as month, kind, count(*) as n_entries from judged where kind is not null group by all",
}
