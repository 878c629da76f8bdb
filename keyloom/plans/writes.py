"""Queries of writes, change capture, expiry, capacity, ingest and anonymising, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.errors import TransactionCanceled
from keyloom.functions.sizes import index_units, write_units
from keyloom.model import TableDef
from keyloom.operators import anonymise, cdc, changefeed, writes
from keyloom.operators.anonymise import Rule
from keyloom.plans.reads import CUSTOMERS, ORDERS
from keyloom.session import load, scratch_dir
from keyloom.sources import exports
from keyloom.statements import Session
from keyloom.store import Store
from keyloom.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _puts(orders: DataFrame) -> DataFrame:
    """New images for every urgent order, and a new order beside every one of high priority."""
    changed = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1000).withColumn("o_orderstatus", F.lit("X"))
    added = orders.where("o_orderpriority = '2-HIGH'").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    return changed.unionByName(added)


_PUTS = f"""(select o_orderkey, o_custkey, 'X' as o_orderstatus, o_totalprice + 1000 as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderpriority = '1-URGENT'
  union all select o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderpriority = '2-HIGH')"""


@query(f"select {_COLUMNS} from orders where o_orderpriority <> '1-URGENT' union all select {_COLUMNS} from {_PUTS} p")
def put_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return writes.put(orders, ORDERS, _puts(orders)).table


@query(f"""select {_COLUMNS} from orders where not (o_orderpriority = '1-URGENT' and o_totalprice < 150000)
           union all select {_COLUMNS} from {_PUTS} p where o_orderkey >= 100000000 or o_totalprice < 151000""")
def put_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace where the stored price is low; absent items pass, as the condition sees an empty item."""
    orders = load(spark, sf_dir, "orders")
    return writes.put(orders, ORDERS, _puts(orders), "attribute_not_exists(o_custkey) OR o_totalprice < :p", values={":p": 150000}).table


@query("select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderpriority = '1-URGENT'")
def put_returns_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return writes.put(orders, ORDERS, _puts(orders)).returned("ALL_OLD").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""select o_orderkey, o_custkey, case when o_orderstatus = 'O' then 'DONE' else o_orderstatus end as o_orderstatus,
          case when o_orderstatus = 'O' then o_totalprice + 10.5 else o_totalprice end as o_totalprice, o_orderdate, case when o_orderstatus <> 'O' then o_orderpriority end as o_orderpriority from orders""")
def update_set_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    keys = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return writes.update(orders, ORDERS, keys, "SET o_orderstatus = :s REMOVE o_orderpriority ADD o_totalprice :n", values={":s": "DONE", ":n": 10.5}).table


@query("select c_custkey, c_acctbal as c_nationkey_was, cast(c_nationkey as double) as c_acctbal_was from customer where c_mktsegment = 'BUILDING'")
def update_snapshot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes swapped in one update: every right side reads the row before it."""
    c = load(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    out = writes.update(c, CUSTOMERS, c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), "SET c_acctbal = c_nationkey, c_nationkey = c_acctbal")
    return out.image("new").select("c_custkey", F.col("c_nationkey").alias("c_nationkey_was"), F.col("c_acctbal").alias("c_acctbal_was"))


@query("select c_custkey, cast(c_nationkey as double) as a, cast(c_nationkey as double) as b from customer where c_custkey = 8")
def update_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same swap as a statement: every SET sees the ones before it."""
    c = load(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    out = Session().register(CUSTOMERS, c).execute("UPDATE customer SET c_acctbal = c_nationkey SET c_nationkey = c_acctbal WHERE c_custkey = 8 RETURNING ALL NEW *")
    return out.select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))


@query("select vec_id, list_concat(case when label < 4 then embedding[2:] else embedding end, case when label < 4 then [cast(0.5 as float)] else [] end) as embedding from embeddings")
def update_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append to a list, then remove its first element."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = TableDef("embeddings", "vec_id")
    keys = load(spark, sf_dir, "embeddings").where("label < 4").select("vec_id")
    longer = writes.update(e, t, keys, "SET embedding = list_append(embedding, :x)", values={":x": [0.5]}).table
    return writes.update(longer, t, keys, "REMOVE embedding[0]").table


@query("select user_id, list_sort(list_distinct(list_concat(list(event_type), ['gift', 'visit']))) as kinds from events where event_type <> 'view' group by user_id")
def update_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD members to a set, DELETE others."""
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    sets = sets.where("exists(kinds, k -> k <> 'view')")
    t = TableDef("users", "user_id")
    added = writes.update(sets, t, sets.select("user_id"), "ADD kinds :a", values={":a": {"gift", "visit"}}).table
    return writes.update(added, t, sets.select("user_id"), "DELETE kinds :d", values={":d": {"view"}}).table


@query(f"select {_COLUMNS} from orders where not (o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F')")
def delete_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return writes.delete(orders, ORDERS, orders.where("o_orderpriority = '3-MEDIUM'"), "o_orderstatus = :f", values={":f": "F"}).table


@query(f"select {_COLUMNS} from orders where o_orderpriority <> '1-URGENT' and o_orderpriority <> '5-LOW' union all select {_COLUMNS} from {_PUTS} p")
def batch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return writes.batch_write(orders, ORDERS, _puts(orders), orders.where("o_orderpriority = '5-LOW'"), limit=None).table


_ACTIONS = [
    writes.Action("put", {"c_custkey": 1}, {"c_name": "new", "c_acctbal": 1.5}, condition="attribute_exists(c_custkey)"),
    writes.Action("update", {"c_custkey": 2}, expression="SET c_name = :n ADD c_acctbal :a", values={":n": "two", ":a": 100}),
    writes.Action("delete", {"c_custkey": 3}),
    writes.Action("check", {"c_custkey": 4}, condition="attribute_exists(c_name)"),
    writes.Action("put", {"c_custkey": 900_000_000}, {"c_name": "added"}, condition="attribute_not_exists(c_custkey)"),
]


@query("""select c_custkey, case c_custkey when 1 then 'new' when 2 then 'two' else c_name end as c_name, case when c_custkey <> 1 then c_nationkey end as c_nationkey,
          case c_custkey when 1 then 1.5 when 2 then c_acctbal + 100 else c_acctbal end as c_acctbal, case when c_custkey <> 1 then c_mktsegment end as c_mktsegment from customer where c_custkey <> 3
          union all select 900000000, 'added', null, null, null""")
def transact_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.transact(load(spark, sf_dir, "customer"), CUSTOMERS, _ACTIONS).table


@query("select * from (values (0, ''), (1, ''), (2, ''), (3, ''), (4, ''), (5, 'ConditionalCheckFailed')) t(action, reason)")
def transact_abort_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = [*_ACTIONS, writes.Action("delete", {"c_custkey": 5}, condition="c_acctbal > :x", values={":x": 1e12})]
    try:
        writes.transact(load(spark, sf_dir, "customer"), CUSTOMERS, actions)
        reasons: list[str] = []
    except TransactionCanceled as refused:
        reasons = refused.reasons
    return spark.createDataFrame(list(enumerate(reasons)), "action int, reason string")


@query("select c_custkey, c_name from customer where c_custkey not in (11, 12) union all values (12, 'twelve'), (910000000, 'made')")
def sql_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, UPDATE and DELETE statements, then the table."""
    s = Session().register(CUSTOMERS, load(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    s.execute("INSERT INTO customer VALUE {'c_custkey': 910000000, 'c_name': 'made'}")
    s.execute("INSERT INTO customer VALUE {'c_custkey': 12, 'c_name': 'never'} IF NOT EXISTS")
    s.execute("UPDATE customer SET c_name = ? WHERE c_custkey = ?", ["twelve", 12])
    s.execute("DELETE FROM customer WHERE c_custkey = 11")
    return s.rows("customer")


@query("select c_custkey, c_name from customer where c_custkey <> 21 union all select 920000000, 'in a transaction'")
def sql_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session().register(CUSTOMERS, load(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    s.transaction([("INSERT INTO customer VALUE {'c_custkey': 920000000, 'c_name': 'in a transaction'}", None), ("DELETE FROM customer WHERE c_custkey = 21", None)])
    return s.rows("customer")


# --- change capture
_LOG = """(select user_id, event_id, event_type, value, lag(event_type) over w as old_type, lag(value) over w as old_value, lag(event_id) over w as before from events window w as (partition by user_id order by event_id))"""


@query(f"""select user_id, event_id, case when before is null then 'INSERT' else 'MODIFY' end as event, old_type, old_value, event_type as new_type, value as new_value from {_LOG} l""")
def cdc_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    out = cdc.from_log(log, ["user_id"], "event_id")
    return out.select("user_id", "event_id", "event", F.col("old.event_type").alias("old_type"), F.col("old.value").alias("old_value"), F.col("new.event_type").alias("new_type"), F.col("new.value").alias("new_value"))


@query(f"""select o_custkey, o_orderkey, 'MODIFY' as event, o_totalprice as old_price, o_totalprice + 1000 as new_price from orders where o_orderpriority = '1-URGENT'
           union all select o_custkey, o_orderkey + 100000000, 'INSERT', null, o_totalprice from orders where o_orderpriority = '2-HIGH'
           union all select o_custkey, o_orderkey, 'REMOVE', o_totalprice, null from orders where o_orderpriority = '5-LOW'""")
def cdc_from_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    new = writes.batch_write(orders, ORDERS, _puts(orders), orders.where("o_orderpriority = '5-LOW'"), limit=None).table
    out = cdc.between_versions(orders, new, ORDERS)
    return out.select("o_custkey", "o_orderkey", "event", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query("""select o_custkey, o_orderkey, case when o_orderkey >= 100000000 then 'INSERT' else 'MODIFY' end as event, o_totalprice as new_price from """ + _PUTS + " p")
def cdc_new_image_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    out = cdc.viewed(writes.put(orders, ORDERS, _puts(orders)).changes(), "NEW_IMAGE")
    return out.where("old is null").select("o_custkey", "o_orderkey", "event", F.col("new.o_totalprice").alias("new_price"))


@query("select id, table_name, try_cast(sequence_number as bigint) as seq from stream_records where table_name = 'Orders' and try_cast(sequence_number as bigint) > 100 order by seq, id limit 1000")
def get_records_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "stream_records").where("table_name = 'Orders'").select("id", "table_name", changefeed.sequence_value(F.col("sequence_number")).alias("seq"))
    token = cdc.iterator("AFTER_SEQUENCE_NUMBER", 100, stream="Orders")
    return r.where(F.col("seq") > cdc.position(token)[1]).orderBy("seq", "id").limit(1000)


@query("select table_name, max(try_cast(sequence_number as bigint)) + 1 as next_sequence from stream_records group by all")
def next_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "stream_records").select("table_name", changefeed.sequence_value(F.col("sequence_number")).alias("seq"))
    return r.groupBy("table_name").agg((F.max("seq") + 1).alias("next_sequence"))


@query()
def list_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "table_catalog").where("stream_enabled = 1").select("table_name", "stream_view_type").collect()
    tables = [TableDef(r.table_name, "pk", stream_view=r.stream_view_type) for r in rows]
    return spark.createDataFrame([tuple(s.values()) for s in cdc.list_streams(tables)], "table_name string, stream string, view string, shard_id string")


_NOW = 1_706_000_000  # a fixed clock


@query(f"select event_id, user_id, floor(epoch(ts))::bigint as expires from events where not (floor(epoch(ts))::bigint < {_NOW} and floor(epoch(ts))::bigint >= 0)")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("expires"))
    return cdc.sweep(e, TableDef("events", "user_id", "event_id", ttl_attribute="expires"), _NOW)[0]


@query(f"""select event_id, user_id, 'REMOVE' as event, '{{"type":"Service","principalId":"ttl"}}' as user_identity from events where floor(epoch(ts))::bigint < {_NOW}""")
def ttl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("expires"))
    removed = cdc.sweep(e, TableDef("events", "user_id", "event_id", ttl_attribute="expires"), _NOW)[1]
    return removed.select("event_id", "user_id", "event", "user_identity")


# --- capacity
@query("""select user_id, event_id, greatest(ceil(coalesce(old, 0) / 1024.0), ceil(new / 1024.0), 1)::double as units
          from (select user_id, event_id, strlen(props) * 500 as new, lag(strlen(props) * 500) over (partition by user_id order by event_id) as old from events) t""")
def write_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").withColumn("new", F.octet_length("props") * 500)
    e = e.withColumn("old", F.lag("new").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("user_id", "event_id", write_units(F.col("old"), F.col("new")).alias("units"))


@query("""select user_id, event_id, case when old is null and new is null then 0.0 when old is null then greatest(ceil(new / 1024.0), 1) when new is null then greatest(ceil(old / 1024.0), 1)
            when old = new and old_key = new_key then 0.0 when old_key <> new_key then greatest(ceil(old / 1024.0), 1) + greatest(ceil(new / 1024.0), 1) else greatest(ceil(old / 1024.0), ceil(new / 1024.0), 1) end::double as units
          from (select user_id, event_id, new, new_key, lag(new) over w as old, lag(new_key) over w as old_key
                from (select *, event_type as new_key, case when event_type <> 'view' then strlen(props) * 300 end as new from events) e window w as (partition by user_id order by event_id)) t""")
def index_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").withColumn("new", F.when(F.col("event_type") != "view", F.octet_length("props") * 300))
    e = e.withColumn("old", F.lag("new").over(w)).withColumn("old_key", F.lag("event_type").over(w))
    moved = F.col("old_key") != F.col("event_type")
    return e.select("user_id", "event_id", index_units(F.col("old"), F.col("new"), (F.col("old") == F.col("new")) & ~moved, moved).alias("units"))


@query("select table_name, cast(sum(2 * greatest(ceil(coalesce(item_size, 0) / 1024.0), 1)) as double) as units from items group by all")
def transact_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = load(spark, sf_dir, "items")
    return i.groupBy("table_name").agg(F.sum(write_units(F.lit(None).cast("int"), F.col("item_size"), transactional=True)).alias("units"))


# --- ingest
@query()
def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read and skipped per file."""
    lines = exports.as_items(load(spark, sf_dir, "export_lines"), "item_json")
    return lines.groupBy("table_name", "file_name").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_skipped"))


@query("""select line_id, coalesce(json_extract_string(item_json, '$.Item.pk.S'), json_extract_string(item_json, '$.pk.S')) as pk, coalesce(json_extract_string(item_json, '$.Item.sk.S'), json_extract_string(item_json, '$.sk.S')) as sk
          from (select * from export_lines where json_valid(item_json) and json_type(item_json) = 'OBJECT') t""")
def import_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = exports.as_items(load(spark, sf_dir, "export_lines"), "item_json").where("not bad")
    return items.select("line_id", exports.attribute("item", "pk", "S").alias("pk"), exports.attribute("item", "sk", "S").alias("sk"))


@query()
def table_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key attributes and indexes of the catalog's tables, through the description reader."""
    import json

    out = []
    for r in load(spark, sf_dir, "table_catalog").orderBy("table_name").collect():
        t = TableDef.from_description({
            "TableName": r.table_name, "KeySchema": json.loads(r.key_schema), "AttributeDefinitions": json.loads(r.attribute_definitions),
            "GlobalSecondaryIndexes": json.loads(r.gsi_definitions or "[]"), "LocalSecondaryIndexes": json.loads(r.lsi_definitions or "[]"),
        })
        out.append((t.name, t.hash_key, t.range_key, [i.name for i in t.indexes]))
    return spark.createDataFrame(out, "table_name string, hash_key string, range_key string, indexes array<string>")


@query("select c_custkey, 'account#' || c_custkey || '/' || c_mktsegment as pk from customer")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", exports.render("account#${c_custkey}/${c_mktsegment}").alias("pk"))


@query("""select c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) as c_name, c_nationkey, sha256('salt' || c_acctbal) as c_acctbal, case when c_nationkey > 10 then '[REDACTED]' else c_mktsegment end as c_mktsegment from
          (select c_custkey, c_name, c_nationkey, c_mktsegment, cast(cast(c_acctbal * 100 as bigint) as varchar) as c_acctbal from customer) t""")
def anonymise_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").withColumn("c_acctbal", F.rint(F.col("c_acctbal") * 100).cast("bigint").cast("string"))
    rules = [Rule("c_name", "mask", keep_last=4), Rule("c_acctbal", "hash", salt="salt"), Rule("c_mktsegment", "redact", match="c_nationkey > :n", values={":n": 10}), Rule("nowhere.deep", "null")]
    return anonymise.apply_rules(c, rules, CUSTOMERS)[0]


@query("select c_custkey, case when c_nationkey <> 3 then c_name end as c_name from customer")
def anonymise_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return anonymise.apply_rules(c, [Rule("c_name", "null", match="c_nationkey = :n", values={":n": 3})])[0].drop("c_nationkey")


@query()
def anonymise_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent replacements: the same name gets the same one wherever it stands."""
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", *(anonymise.faked(F.col("c_name"), g).alias(g) for g in anonymise.GENERATORS))


# --- versions and streams
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"select {_COLUMNS} from orders where o_orderpriority <> '1-URGENT' union all select {_COLUMNS} from {_PUTS} p")
def store_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions with indexes and change records; the current one is read back."""
    store, orders = Store(spark, _scratch(spark, "store")), load(spark, sf_dir, "orders")
    store.publish(ORDERS, orders)
    store.commit(ORDERS, writes.put(store.read("orders"), ORDERS, _puts(store.read("orders"))))
    return store.read("orders")


@query("select o_orderstatus, count(*) as n from orders group by all")
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot restored over later writes; read through an index."""
    store, orders = Store(spark, _scratch(spark, "store")), load(spark, sf_dir, "orders")
    store.publish(ORDERS, orders)
    store.snapshot("before")
    store.publish(ORDERS, orders.where("o_orderstatus = 'F'"))
    store.restore("before")
    return store.read("orders", index="by_status").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""select table_name, count(*) as n_alive from (
            select table_name, upper(trim(event_name)) as e, row_number() over (partition by table_name, coalesce(json_extract_string(keys_json, '$.pk.S'), json_extract_string(keys_json, '$.UserId.S')),
              coalesce(json_extract_string(keys_json, '$.sk.N'), json_extract_string(keys_json, '$.Timestamp.S'), '') order by try_cast(sequence_number as bigint) desc, id) as n
            from stream_records where upper(trim(event_name)) in ('INSERT', 'MODIFY', 'REMOVE') and try_cast(sequence_number as bigint) is not null) t
          where n = 1 and e <> 'REMOVE' group by all""")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed applied as a stream; what it emits leaves as many items alive as the batch does."""
    records = load(spark, sf_dir, "stream_records")
    folder = _scratch(spark, "stream")
    changes = changefeed.read_changes(records, load(spark, sf_dir, "table_catalog"), "new_image")
    changes.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(changes.schema).parquet(f"{folder}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = live.apply_live(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if old:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.schema(live.OUT).parquet(f"{folder}/out")
    delta = F.when(F.col("event") == "INSERT", 1).when(F.col("event") == "REMOVE", -1).otherwise(0)
    return out.groupBy("table_name").agg(F.sum(delta).alias("n_alive"))
