"""Queries of keyed reads, predicates, paging, indexes and capacity, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.expr import parse
from keyloom.expr.compile import Compiler, Document, Typed, canonical_document, utf16_length
from keyloom.functions.numbers import canonical_number, number_size, number_sort_key
from keyloom.functions.sizes import item_size, read_units
from keyloom.model import IndexDef, TableDef
from keyloom.operators import ranking, reads
from keyloom.operators.reads import Request
from keyloom.session import load
from keyloom.statements import Session

ORDERS = TableDef(
    "orders", "o_custkey", "o_orderkey", (("o_custkey", "N"), ("o_orderkey", "N")),
    (
        IndexDef("by_status", "o_orderstatus", "o_orderdate"),
        IndexDef("by_status_keys", "o_orderstatus", "o_orderdate", "KEYS_ONLY"),
        IndexDef("by_status_price", "o_orderstatus", "o_orderdate", "INCLUDE", ("o_totalprice",)),
        IndexDef("by_price", "o_custkey", "o_totalprice", "KEYS_ONLY", local=True),
    ),
)
EVENTS = TableDef("events", "user_id", "event_id", (("user_id", "N"), ("event_id", "N")), (IndexDef("purchases", "purchase_value", "ts"),))
CUSTOMERS = TableDef("customer", "c_custkey", None, (("c_custkey", "N"),), (IndexDef("by_segment", "c_mktsegment", "c_acctbal"),))
ITEMS = TableDef("items", "row_id", None, (("row_id", "N"),))

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


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a sparse attribute and a nested map: shapes the flat tables don't have."""
    e = load(spark, sf_dir, "events")
    return e.withColumn("purchase_value", F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("props", F.from_json("props", "struct<k:bigint>"))


_EVENTS = "(select event_id, ts, user_id, event_type, value, case when event_type = 'purchase' then value end as purchase_value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


# --- keyed reads
@query("select * from orders where o_custkey = (select min(o_custkey) from orders) and o_orderkey = (select min(o_orderkey) from orders where o_custkey = (select min(o_custkey) from orders))")
def get_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    first = orders.orderBy("o_custkey", "o_orderkey").select("o_custkey", "o_orderkey").first()
    return reads.get_item(orders, ORDERS, first.asDict())


@query("select * from orders where o_custkey = 10 and o_orderkey > 100 order by o_orderkey limit 5")
def query_range_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_custkey = :c AND o_orderkey > :k", values={":c": 10, ":k": 100}, limit=5)
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("select * from orders where o_custkey = 10 and o_orderkey between 1 and 12000 order by o_orderkey desc limit 7")
def query_range_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_orderkey BETWEEN :a AND :b AND :c = o_custkey", values={":c": 10, ":a": 1, ":b": 12000}, limit=7, forward=False)
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("select * from (select * from orders where o_custkey = 10 order by o_orderkey limit 6) t where o_totalprice > 150000")
def query_limit_before_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_custkey = :c", filter="o_totalprice > :p", values={":c": 10, ":p": 150000}, limit=6)
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("""select * from orders where row(o_custkey, o_orderkey) > (select row(o_custkey, o_orderkey) from orders order by o_custkey, o_orderkey offset 99 limit 1) order by o_custkey, o_orderkey limit 100""")
def scan_page2_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    last = reads.scan(orders, ORDERS, Request(limit=100)).last_key()
    return reads.scan(orders, ORDERS, Request(limit=100, start=last)).rows


@query("""
    with sized as (select doc_id, text, 6 + 4 + 1 + cast(ceil(greatest(0, length(rtrim(cast(doc_id as varchar), '0'))) / 2.0) as int) + strlen(text) as b
                   from documents where text is not null),
    run as (select *, sum(b) over (order by doc_id rows unbounded preceding) as s, row_number() over (order by doc_id) as n from sized)
    select doc_id, text from run where s <= 1048576 or n = 1""")
def page_size_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    return reads.scan(docs, TableDef("documents", "doc_id"), Request(page_bytes=1 << 20)).rows


@query("select o_orderstatus, o_orderdate, o_custkey, o_orderkey, o_totalprice, o_orderpriority from orders where o_orderstatus = 'P' order by o_orderdate, o_custkey, o_orderkey limit 50")
def gsi_query_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, Request("o_orderstatus = :s", values={":s": "P"}, index="by_status", limit=50)).rows


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'")
def gsi_query_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    r = Request("o_orderstatus = :s AND o_orderdate >= :d", values={":s": "F", ":d": datetime(1997, 1, 1)}, index="by_status_keys")
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice < 100000")
def gsi_query_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_orderstatus = :s", filter="o_totalprice < :p", values={":s": "O", ":p": 100000}, index="by_status_price")
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query(f"select event_id, ts, user_id, event_type, value, purchase_value from {_EVENTS} where purchase_value is not null")
def gsi_sparse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(_events(spark, sf_dir), EVENTS, Request(index="purchases")).rows.drop("props")


@query("select * from orders where o_custkey = 10 order by o_totalprice, o_orderkey limit 4")
def lsi_all_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_custkey = :c", values={":c": 10}, index="by_price", select="ALL_ATTRIBUTES", limit=4)
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("select o_custkey, o_orderkey, o_totalprice from orders where o_totalprice is not null")
def lsi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(load(spark, sf_dir, "orders"), ORDERS, Request(index="by_price")).rows


@query("select * from items where cast('0x' || substr(md5('Outliers' || pk), 1, 3) as int) between 1024 and 2047")
def parallel_scan_seg1of4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "items").where(reads.in_segment(F.col("pk"), 1, 4))


@query()
def parallel_scan_index_seg0of3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "index_entries").where(reads.in_index_segment(F.col("table_pk"), 0, 3))


@query("select * from customer where c_custkey in (select i * 37 from range(1, 101) t(i))")
def batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.batch_get(load(spark, sf_dir, "customer"), CUSTOMERS, [{"c_custkey": i * 37} for i in range(1, 101)])


@query("""select cast(t.i - 1 as int) as position, c.c_custkey is not null as found, t.i * 37 as c_custkey, c.c_name, c.c_acctbal
          from range(1, 61) t(i) left join customer c on c.c_custkey = t.i * 37""")
def transact_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [{"c_custkey": i * 37} for i in range(1, 61)]
    return reads.transact_get(load(spark, sf_dir, "customer"), CUSTOMERS, keys, "c_name, c_acctbal")


@query("select d.doc_id, d.text from documents d where d.doc_id in (select doc_id from review_labels)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return reads.multi_get(docs, TableDef("documents", "doc_id"), load(spark, sf_dir, "review_labels"))


@query("select * from items where cached_at is not null order by cached_at, row_id limit 100")
def lru_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.least_recently_used(load(spark, sf_dir, "items"), ["row_id"])


@query("""select count(*) filter (where o_totalprice > 200000) as count, count(*) as scanned_count from orders where o_custkey = 10""")
def select_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("o_custkey = :c", filter="o_totalprice > :p", values={":c": 10, ":p": 200000}, select="COUNT")
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, r).rows


@query("select count(*) filter (where l_quantity < 24 and l_discount between 0.05 and 0.07) as count, count(*) as scanned_count from lineitem")
def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request(filter="l_quantity < :q AND l_discount BETWEEN :a AND :b", values={":q": 24, ":a": 0.05, ":b": 0.07}, select="COUNT")
    return reads.scan(load(spark, sf_dir, "lineitem"), TableDef("lineitem", "l_orderkey"), r).rows


# --- predicates: one scan each
def _scan(table: str, key: str, text: str, sql_where: str, values: dict | None = None, names: dict | None = None, source: str | None = None, columns: str = "*"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir) if source else load(spark, sf_dir, table)
        out = reads.scan(rows, TableDef(table, key), Request(filter=text, values=values or {}, names=names or {})).rows
        return out.drop("props") if source else out

    if source:
        columns = "event_id, ts, user_id, event_type, value, purchase_value"
    return run, f"select {columns} from {source or table} where {sql_where}"


_PREDICATES = {
    "filter_compare": _scan("lineitem", "l_orderkey", "l_quantity >= :q AND l_returnflag <> :f", "l_quantity >= 45 and l_returnflag <> 'N'", {":q": 45, ":f": "N"}),
    "filter_path_vs_path": _scan("lineitem", "l_orderkey", "l_discount < l_tax", "l_discount < l_tax"),
    "filter_between": _scan("orders", "o_custkey", "o_totalprice BETWEEN :a AND :b", "o_totalprice between 1000 and 50000", {":a": 1000, ":b": 50000}),
    "filter_in": _scan("orders", "o_custkey", "o_orderstatus IN (:a, :b, :c)", "o_orderstatus in ('F', 'P')", {":a": "F", ":b": "P", ":c": 7}),
    "filter_exists": _scan("items", "row_id", "attribute_exists(cached_at)", "cached_at is not null"),
    "filter_not_exists": _scan("items", "row_id", "attribute_not_exists(item_size) OR attribute_not_exists(nowhere.at_all)", "true"),
    "filter_type": _scan("items", "row_id", "attribute_type(item_size, :t) AND NOT attribute_type(pk, :t)", "item_size is not null", {":t": "N"}),
    "filter_begins_with": _scan("customer", "c_custkey", "begins_with(c_name, :p)", "starts_with(c_name, 'Customer#00000001')", {":p": "Customer#00000001"}),
    "filter_contains": _scan("part", "p_partkey", "contains(p_name, :p)", "contains(p_name, 'e')", {":p": "e"}),
    "filter_size": _scan("documents", "doc_id", "size(#t) > :n", "length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) > 1500", {":n": 1500}, {"#t": "text"}),
    "filter_boolean": _scan(
        "orders", "o_custkey", "NOT (o_orderstatus = :f OR o_totalprice < :p) AND (o_orderpriority = :u OR NOT o_orderstatus = :o)",
        "not (o_orderstatus = 'F' or o_totalprice < 100000) and (o_orderpriority = '1-URGENT' or not o_orderstatus = 'O')", {":f": "F", ":p": 100000, ":u": "1-URGENT", ":o": "O"},
    ),
    "filter_missing_unequal": _scan("events", "user_id", "purchase_value <> :v", "purchase_value is null or purchase_value <> 10", {":v": 10}, source=_EVENTS),
    "filter_missing_not_less": _scan("events", "user_id", "NOT purchase_value < :v", "purchase_value is null or not purchase_value < 50", {":v": 50}, source=_EVENTS),
    "filter_nested": _scan("events", "user_id", "#p.k > :k AND attribute_exists(#p)", "k > 50", {":k": 50}, {"#p": "props"}, source=_EVENTS),
    "filter_other_type": _scan("customer", "c_custkey", "c_name <> :n AND NOT c_acctbal = :s", "true", {":n": 5, ":s": "5"}),
}
for _name, (_run, _sql) in _PREDICATES.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


@query("select * from orders where o_totalprice >= 100000 and o_orderstatus in ('F', 'O') and contains(o_orderpriority, 'U')")
def legacy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {
        "o_totalprice": {"ComparisonOperator": "GE", "AttributeValueList": [100000]}, "o_orderstatus": {"ComparisonOperator": "IN", "AttributeValueList": ["F", "O"]},
        "o_orderpriority": {"ComparisonOperator": "CONTAINS", "AttributeValueList": ["U"]},
    }
    return reads.scan(load(spark, sf_dir, "orders"), ORDERS, Request(legacy_filter=conditions)).rows


@query("select * from orders where o_custkey = 10 and o_orderkey <= 9000")
def legacy_key_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"o_custkey": {"ComparisonOperator": "EQ", "AttributeValueList": [10]}, "o_orderkey": {"ComparisonOperator": "LE", "AttributeValueList": [9000]}}
    return reads.query(load(spark, sf_dir, "orders"), ORDERS, Request(key_conditions=conditions)).rows


@query("select vec_id, [embedding[1], embedding[4]] as embedding from embeddings")
def project_list_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request(projection="embedding[3], embedding[0], vec_id")
    return reads.scan(load(spark, sf_dir, "embeddings"), TableDef("embeddings", "vec_id"), r).rows


@query("select c_name, c_acctbal from customer")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(load(spark, sf_dir, "customer"), CUSTOMERS, Request(attributes=["c_name", "c_acctbal"])).rows


@query(f"select event_id, k from {_EVENTS} where k is not null")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request(projection="event_id, props.k", filter="attribute_exists(props.k)")
    return reads.scan(_events(spark, sf_dir), EVENTS, r).rows.select("event_id", "props.k")


# --- the statement dialect
def _select(text: str, parameters: list | None = None, table: TableDef = ORDERS, source: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir) if table is EVENTS else load(spark, sf_dir, table.name)
        out = Session().register(table, rows).execute(text, parameters)
        return out.drop("props") if table is EVENTS and "*" in text else out

    return run


_STATEMENTS = {
    "sql_key_range": (_select("SELECT * FROM orders WHERE o_custkey = ? AND o_orderkey BETWEEN 1 AND 9000", [10]), "select * from orders where o_custkey = 10 and o_orderkey between 1 and 9000"),
    "sql_or_not": (
        _select("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 150000) OR (o_custkey = 10 AND NOT o_orderstatus IN ['O', 'P'])"),
        "select * from orders where not (o_orderstatus = 'F' or o_totalprice < 150000) or (o_custkey = 10 and not o_orderstatus in ('O', 'P'))",
    ),
    "sql_in": (_select("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"), "select o_orderkey, o_orderstatus from orders where o_orderpriority in ('1-URGENT', '5-LOW')"),
    "sql_is_missing": (_select("SELECT * FROM events WHERE purchase_value IS MISSING", table=EVENTS), f"select event_id, ts, user_id, event_type, value, purchase_value from {_EVENTS} where purchase_value is null"),
    "sql_exists": (_select("SELECT * FROM events WHERE EXISTS(purchase_value) AND purchase_value >= 10", table=EVENTS), f"select event_id, ts, user_id, event_type, value, purchase_value from {_EVENTS} where purchase_value >= 10"),
    "sql_missing_unequal": (_select("SELECT * FROM events WHERE purchase_value <> 10", table=EVENTS), f"select event_id, ts, user_id, event_type, value, purchase_value from {_EVENTS} where purchase_value <> 10"),
    "sql_missing_not_equal": (_select("SELECT * FROM events WHERE NOT (purchase_value = 10)", table=EVENTS), f"select event_id, ts, user_id, event_type, value, purchase_value from {_EVENTS} where not coalesce(purchase_value = 10, false)"),
    "sql_begins_with": (_select("SELECT * FROM customer WHERE BEGINS_WITH(c_name, 'Customer#00000002') AND NOT BEGINS_WITH(c_mktsegment, 'A')", table=CUSTOMERS), "select * from customer where starts_with(c_name, 'Customer#00000002') and not starts_with(c_mktsegment, 'A')"),
    "sql_contains": (_select("SELECT c_custkey, c_name FROM customer WHERE CONTAINS(c_mktsegment, 'OB')", table=CUSTOMERS), "select c_custkey, c_name from customer where contains(c_mktsegment, 'OB')"),
    "sql_nested_path": (_select("SELECT event_id, value FROM events WHERE props.k < 10", table=EVENTS), f"select event_id, value from {_EVENTS} where k < 10"),
    "sql_index": (_select("SELECT o_orderkey, o_totalprice FROM orders.by_status WHERE o_orderstatus = 'P'"), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'"),
    "sql_local_index_reach_back": (_select("SELECT o_orderkey, o_orderpriority FROM orders.by_price WHERE o_custkey = 10 AND o_totalprice > 1000"), "select o_orderkey, o_orderpriority from orders where o_custkey = 10 and o_totalprice > 1000"),
}
for _name, (_run, _sql) in _STATEMENTS.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


@query("""select * from (select * from orders where row(o_custkey, o_orderkey) > (select row(o_custkey, o_orderkey) from orders order by o_custkey, o_orderkey offset 49 limit 1)
          order by o_custkey, o_orderkey limit 50) t where o_orderstatus = 'O'""")
def sql_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session().register(ORDERS, load(spark, sf_dir, "orders"))
    text = "SELECT * FROM orders WHERE o_orderstatus = 'O'"
    _, token = s.page(text, None, 50)
    return s.page(text, None, 50, token)[0]


# --- the document plane: tagged JSON as it is stored
_DOC_WHERE = {
    "doc_number_range": ("age >= :a AND age < :b", {":a": 30, ":b": 40}, "try_cast(json_extract_string(j, '$.age.N') as double) >= 30 and try_cast(json_extract_string(j, '$.age.N') as double) < 40"),
    "doc_missing_unequal": ("#s <> :s", {":s": "held"}, "json_extract_string(j, '$.status.S') is null or json_extract_string(j, '$.status.S') <> 'held'"),
    "doc_nested": ("begins_with(address.city, :c) AND attribute_type(active, :t)", {":c": "N", ":t": "BOOL"}, "starts_with(json_extract_string(j, '$.address.M.city.S'), 'N') and json_extract(j, '$.active.BOOL') is not null"),
    "doc_set_contains": ("contains(tags, :t) OR NOT attribute_exists(tags)", {":t": "active"}, "coalesce(list_contains(cast(json_extract(j, '$.tags.SS') as varchar[]), 'active'), false) or json_extract(j, '$.tags') is null"),
}


def _document_query(text: str, values: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # these predicates need no canonical form, so the stored text is parsed as it is
        items = load(spark, sf_dir, "items").withColumn("doc", F.try_parse_json("item_json")).where(F.try_variant_get("doc", "$", "map<string,variant>").isNotNull())
        node = parse.condition(text, parse.Scope({"#s": "status"} if "#s" in text else {}, values))
        return items.where(Compiler(Document("doc")).filter(node)).select("row_id", "table_name")

    return run


for _name, (_text, _values, _where) in _DOC_WHERE.items():
    QUERIES[_name] = _document_query(_text, _values)
    ORACLES[_name] = f"select row_id, table_name from (select row_id, table_name, cast(item_json as json) as j from items where json_valid(item_json) and json_type(item_json) = 'OBJECT') t where {_where}"


@query("""select row_id, table_name from items where json_valid(item_json) and json_type(item_json) = 'OBJECT'
          and list_sort(cast(json_extract(item_json, '$.tags.SS') as varchar[])) = ['active', 'group4']""")
def doc_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets are equal whatever the order of their members: canonical documents."""
    items = load(spark, sf_dir, "items").withColumn("doc", canonical_document(F.col("item_json"))).where("doc is not null")
    node = parse.condition("tags = :t", parse.Scope({}, {":t": {"SS": ["group4", "active"]}}))
    return items.where(Compiler(Document("doc")).filter(node)).select("row_id", "table_name")


# --- functions
@query("""select row_id, octet_length(encode(pk)) as pk_bytes, length(pk) + len(regexp_extract_all(pk, '[\\x{10000}-\\x{10FFFF}]')) as pk_units, md5('Outliers' || pk) as hash,
          cast('0x' || substr(md5('Outliers' || pk), 1, 3) as int) as bucket from items where pk is not null""")
def key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = load(spark, sf_dir, "items").where("pk is not null")
    return i.select("row_id", F.octet_length("pk").cast("bigint").alias("pk_bytes"), utf16_length(F.col("pk")).cast("bigint").alias("pk_units"), F.md5(F.concat(F.lit("Outliers"), "pk")).alias("hash"), reads.hash_bucket(F.col("pk")).alias("bucket"))


@query("""select distinct o_orderkey * 100 as n, rtrim(cast(o_orderkey as varchar), '0') as digits_text, cast(1 + ceil(length(rtrim(cast(o_orderkey as varchar), '0')) / 2.0) as int) as stored
          from orders where o_orderkey > 0""")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").where("o_orderkey > 0").select((F.col("o_orderkey") * 100).alias("n")).distinct()
    spelled = F.concat(F.lit("00"), F.col("n").cast("string"), F.lit(".00E0"))
    return n.select("n", F.rtrim(canonical_number(spelled), F.lit("0")).alias("digits_text"), number_size(spelled).alias("stored"))


def _places(orders: DataFrame) -> DataFrame:
    return ranking.with_rank(orders.select("o_orderkey", "o_totalprice"), number_sort_key(F.col("o_totalprice").cast("string")), "place").select("o_orderkey", "place")


@query("select o_orderkey, rank() over (order by o_totalprice) as place from orders")
def number_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by the order-preserving text are ranks by the number."""
    return _places(load(spark, sf_dir, "orders"))


# --- aggregates: sizes and capacity
@query("select table_name, pk, cast(sum(item_size) as bigint) as bytes, count(*) as n_items from items group by all")
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "items").groupBy("table_name", "pk").agg(F.sum("item_size").alias("bytes"), F.count(F.lit(1)).alias("n_items"))


@query("select table_name, count(*) as n_items, cast(sum(item_size) as bigint) as bytes from items group by all union all select table_name, count(*), cast(sum(strlen(coalesce(item_json, ''))) as bigint) from index_entries group by all")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum("item_size").alias("bytes"))
    entries = load(spark, sf_dir, "index_entries").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.octet_length(F.coalesce("item_json", F.lit("")))).alias("bytes"))
    return items.unionByName(entries)




@query("select table_name, pk, greatest(ceil(coalesce(sum(item_size), 0) / 4096.0), 1) * 0.5 as read_units from items where pk is not null group by all")
def read_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "items").where("pk is not null").groupBy("table_name", "pk").agg(F.sum("item_size").alias("bytes"))
    return sizes.select("table_name", "pk", read_units(F.col("bytes")).alias("read_units"))


@query("select n_nationkey, cast(11 + 6 + 11 + strlen(n_name) + case when n_nationkey = 0 then 1 else 1 + cast(ceil(length(rtrim(cast(n_nationkey as varchar), '0')) / 2.0) as int) end + case when n_regionkey = 0 then 1 else 2 end as int) as bytes from nation")
def item_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.select("n_nationkey", item_size(n.schema).alias("bytes"))
