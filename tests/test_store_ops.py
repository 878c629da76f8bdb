"""Reads, writes, statements, versions, capture, ingest: behaviour beyond the queries."""

import gzip
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keyloom.errors import ConditionFailed, DuplicateItem, IdempotencyMismatch, ResourceInUse, ResourceNotFound, TransactionCanceled, ValidationError
from keyloom.model import Catalog, IndexDef, TableDef
from keyloom.operators import anonymise, cdc, reads, writes
from keyloom.operators.anonymise import Rule
from keyloom.operators.reads import Request
from keyloom.sources import exports
from keyloom.statements import Session, check_growth, parse_statement
from keyloom.store import Store
from keyloom.streaming import live

T = TableDef("things", "pk", "sk", (("pk", "S"), ("sk", "N")), (IndexDef("by_x", "x", "sk"), IndexDef("local", "pk", "y", "KEYS_ONLY", local=True)), "NEW_AND_OLD_IMAGES")


@pytest.fixture()
def rows(spark):
    data = [(f"p{i % 3}", i, i % 2 if i % 5 else None, float(i % 4), f"n{i}") for i in range(40)]
    return spark.createDataFrame(data, "pk string, sk bigint, x int, y double, name string")


def pages(df, request_of, run):
    out, start = [], None
    for _ in range(100):
        read = run(df, T, request_of(start))
        out += [tuple(r) for r in read.rows.collect()]
        start = read.last_key()
        if start is None:
            return out
    raise AssertionError("the pages don't end")


@pytest.mark.parametrize("forward", [True, False])
def test_pages_are_the_whole(rows, forward):
    ask = lambda index: lambda start: Request(limit=7, start=start, forward=forward, index=index)
    whole = [tuple(r) for r in rows.collect()]
    assert sorted(pages(rows, ask(None), reads.scan), key=str) == sorted(whole, key=str)
    # tied index keys: the cursor goes on by the table's keys
    assert sorted(pages(rows, ask("by_x"), reads.scan), key=str) == sorted([r for r in whole if r[2] is not None], key=str)
    q = lambda start: Request("pk = :p", values={":p": "p1"}, limit=4, start=start, forward=forward)
    got = pages(rows, q, reads.query)
    assert got == sorted([r for r in whole if r[0] == "p1"], key=lambda r: r[1], reverse=not forward)


def test_limit_counts_rows_read(rows):
    read = reads.query(rows, T, Request("pk = :p", filter="y > :y", values={":p": "p0", ":y": 100}, limit=5))
    assert read.rows.count() == 0 and read.last_key() == {"sk": 12}
    assert tuple(read.counts().first()) == (0, 5)


def test_segments_partition(rows):
    for of in (lambda s: Request(segment=s, segments=5), lambda s: Request(segment=s, segments=5, index="by_x")):
        parts = [{(r.pk, r.sk) for r in reads.scan(rows, T, of(s)).rows.collect()} for s in range(5)]
        assert sum(map(len, parts)) == len(set.union(*parts))
    whole = rows.withColumn("pk", F.col("sk").cast("string"))
    assert sum(reads.scan(whole, T, Request(segment=s, segments=7)).rows.count() for s in range(7)) == 40


def test_fnv(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(reads.fnv1a(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


@pytest.mark.parametrize(
    "r",
    [Request(limit=0), Request(segment=1), Request(segment=5, segments=5), Request(index="by_x", consistent=True), Request(select="SPECIFIC_ATTRIBUTES"), Request(projection="x", select="COUNT"), Request(projection="x", attributes=["x"]), Request(start={"pk": "a"}), Request(projection="y.a, y")],
)
def test_bad_scans(rows, r):
    with pytest.raises(ValidationError):
        reads.scan(rows, T, r)


def test_query_filter_cannot_name_keys(rows):
    with pytest.raises(ValidationError):
        reads.query(rows, T, Request("pk = :p", filter="sk = :p", values={":p": "p0"}))
    with pytest.raises(ResourceNotFound):
        reads.query(rows, T, Request("pk = :p", values={":p": "p0"}, index="no"))
    with pytest.raises(ValidationError):
        reads.batch_get(rows, T, [{"pk": "a", "sk": 1}] * 2)
    with pytest.raises(ValidationError):
        reads.batch_get(rows, T, [{"pk": "a", "sk": i} for i in range(101)])


def test_transact_get_keeps_order_and_gaps(rows):
    got = reads.transact_get(rows, T, [{"pk": "p1", "sk": 1}, {"pk": "no", "sk": 1}, {"pk": "p0", "sk": 0}], "name").collect()
    assert [tuple(r) for r in got] == [(0, True, "p1", 1, "n1"), (1, False, "no", 1, None), (2, True, "p0", 0, "n0")]


def test_put_refuses_items_without_keys(rows, spark):
    bad = spark.createDataFrame([("", 1, 1, 1.0, "x")], rows.schema)
    with pytest.raises(Exception, match="lacks a key"):
        writes.put(rows, T, bad).table.collect()


def test_update_on_nested_columns(spark):
    df = spark.createDataFrame([("a", Row(x=1, l=[1, 2, 3]), {"k": 1}), ("b", None, None)], "pk string, s struct<x:int,l:array<int>>, m map<string,int>")
    t = TableDef("nested", "pk")
    one = spark.createDataFrame([("a",)], "pk string")
    new = writes.update(df, t, one, "SET s.x = s.x + :n, s.l[4] = :n, m.k2 = :n REMOVE s.l[0], s.l[1]", values={":n": 5}).image("new").first()
    assert new.s.x == 6 and new.s.l == [3, None, 5] and new.m == {"k": 1, "k2": 5}
    with pytest.raises(Exception, match="document path"):
        writes.update(df, t, spark.createDataFrame([("b",)], "pk string"), "SET s.x = :n", values={":n": 1}).image("new").collect()
    made = writes.update(df, t, spark.createDataFrame([("c",)], "pk string"), "SET m = :m", values={":m": {"q": 1}})
    assert made.table.count() == 3 and made.rows.first().existed is False


def test_sets_empty_to_missing(spark):
    df = spark.createDataFrame([("a", ["x"])], "pk string, tags array<string>")
    t = TableDef("sets", "pk")
    gone = writes.update(df, t, df.select("pk"), "DELETE tags :t", values={":t": {"x"}}).table.first()
    assert gone.tags is None
    more = writes.update(df, t, df.select("pk"), "ADD tags :t", values={":t": {"b", "x"}}).table.first()
    assert more.tags == ["b", "x"]


def test_conditions_see_the_empty_item(rows, spark):
    new = spark.createDataFrame([("zz", 1, None, None, "new")], rows.schema)
    assert writes.put(rows, T, new, "attribute_not_exists(pk) AND name <> :n", values={":n": "q"}).table.count() == 41
    old = rows.where("sk = 3")
    out = writes.put(rows, T, old, "attribute_not_exists(pk)")
    assert out.table.count() == 40 and out.rows.first().ok is False
    with pytest.raises(ConditionFailed):
        writes.require(out)


def test_transactions(rows):
    ok = [writes.Action("delete", {"pk": "p0", "sk": 0}), writes.Action("put", {"pk": "q", "sk": 1}, {"name": "q"})]
    assert writes.transact(rows, T, ok).table.count() == 40
    with pytest.raises(TransactionCanceled) as refused:
        writes.transact(rows, T, [*ok, writes.Action("check", {"pk": "p1", "sk": 1}, condition="attribute_not_exists(pk)")])
    assert refused.value.reasons == ["", "", "ConditionalCheckFailed"]
    with pytest.raises(ValidationError):
        writes.transact(rows, T, [ok[0], ok[0]])


def test_batch_limits(rows):
    with pytest.raises(ValidationError):
        writes.batch_write(rows, T, rows)
    with pytest.raises(ValidationError):
        writes.batch_write(rows, T, rows.where("sk = 1"), rows.where("sk = 1"))


def test_index_capacity(rows, spark):
    out = writes.put(rows, T, spark.createDataFrame([("p1", 1, 1, 1.0, "n1"), ("p2", 2, 1, 2.0, "n2"), ("p0", 0, 5, 0.0, "n0"), ("p1", 4, None, 0.0, "n4")], rows.schema))
    units = {r.sk: r.write_units for r in out.index_capacity(T.indexes[0]).collect()}
    assert units == {1: 0.0, 2: 2.0, 0: 1.0, 4: 1.0}
    assert {r.write_units for r in out.capacity(transactional=True).collect()} == {2.0}


def test_statements(rows):
    s = Session().register(T, rows)
    with pytest.raises(DuplicateItem):
        s.execute("INSERT INTO things VALUE {'pk': 'p0', 'sk': 0}")
    with pytest.raises(ConditionFailed):
        s.execute("UPDATE things SET name = 'x' WHERE pk = 'p0' AND sk = 0 AND name = 'other'")
    with pytest.raises(ConditionFailed):
        s.execute("UPDATE things SET name = 'x' WHERE pk = 'none' AND sk = 0")
    s.execute("DELETE FROM things WHERE pk = 'none' AND sk = 0")
    assert s.rows("things").count() == 40
    got = s.execute("UPDATE things SET name = 'x', y = y + 1 WHERE pk = 'p0' AND sk = 0 RETURNING MODIFIED OLD *").first()
    assert got.asDict() == {"name": "n0", "y": 0.0}
    reads_ = s.batch([("SELECT name FROM things WHERE pk = 'p0' AND sk = 0", None), ("SELECT * FROM things", None)])
    assert reads_[0].first().name == "x" and isinstance(reads_[1], ValidationError)
    with pytest.raises(TransactionCanceled) as refused:
        s.transaction([("DELETE FROM things WHERE pk = 'p0' AND sk = 0", None), ("INSERT INTO things VALUE {'pk': 'p1', 'sk': 1}", None)])
    assert refused.value.reasons == ["", "DuplicateItem"] and s.rows("things").count() == 40
    text = "SELECT sk FROM things WHERE y >= 0"
    seen, token = [], None
    while True:
        page, token = s.page(text, None, 9, token)
        seen += [r.sk for r in page.collect()]
        if token is None:
            break
    assert sorted(seen) == list(range(40))
    with pytest.raises(ValidationError):
        s.page("SELECT * FROM things", None, 9, s.page(text, None, 9)[1])


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM a.b.c", "SELECT COUNT(*) FROM t", "SELECT * FROM t ORDER BY x", "SELECT * FROM t LIMIT 5", "DELETE FROM t.i WHERE a = 1", "SELECT * FROM t WHERE a < TRUE", "SELECT * FROM t WHERE 5 IS MISSING", "INSERT INTO t VALUE 5", "UPDATE t WHERE a = 1", "DELETE FROM t WHERE a = 1 RETURNING ALL NEW *", "SELECT a, a.b FROM t", "SELECT * FROM t WHERE a = ?"],
)
def test_bad_statements(text):
    with pytest.raises(ValidationError):
        parse_statement(text)


def test_statement_literals_and_growth():
    s = parse_statement("INSERT INTO t VALUE {'a': 'it''s', 'n': -1.5, 'l': [1, <<'x','y'>>], 'm': {'b': NULL, 'c': true}}")
    assert s.item["a"].value == "it's" and s.item["n"].value == "-1.5" and s.item["l"].value[1].tag == "SS"
    wide = " AND ".join(f"(a{i} = 1 OR b{i} = 1)" for i in range(9))
    with pytest.raises(ValidationError):
        parse_statement(f"SELECT * FROM t WHERE {wide}")
    check_growth(parse_statement("SELECT * FROM t WHERE NOT (a = 1 OR b = 2)").where)


def test_catalog():
    c = Catalog()
    c.create(T)
    with pytest.raises(ResourceInUse):
        c.create(T)
    c.update("things", add_index=IndexDef("g2", "y"))
    assert [i.name for i in c.describe("things").indexes] == ["by_x", "local", "g2"]
    c.update("things", drop_index="g2", protected=True)
    with pytest.raises(ResourceInUse):
        c.delete("things")
    c.tag("things", {"a": "1", "b": "2"})
    c.untag("things", ["a"])
    assert c.describe("things").tags == (("b", "2"),)
    c.set_ttl("things", "y")
    for n in ("aaa", "zzz"):
        c.create(TableDef(n, "pk"))
    assert c.list(limit=2) == (["aaa", "things"], "things") and c.list("things") == (["zzz"], None)


def test_store(spark, rows, tmp_path):
    now = [1000.0]
    store = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    store.publish(T, rows, token="t1", request={"a": 1})
    assert store.publish(T, rows.limit(0), token="t1", request={"a": 1}).number == 1
    with pytest.raises(IdempotencyMismatch):
        store.publish(T, rows, token="t1", request={"a": 2})
    now[0] += 601
    store.snapshot("keep")
    out = writes.delete(store.read("things"), T, store.read("things").where("sk < 10"))
    assert store.commit(T, out, token="t1", request={"a": 2}).number == 2
    assert store.changes("things").groupBy("event").count().first()["count"] == 10
    assert store.read("things").count() == 30 and store.read("things", 1).count() == 40
    assert store.read("things", index="by_x").where("x is null").count() == 0
    assert store.vacuum("things") == []
    assert store.restore("keep") == {"things": 3} and store.read("things").count() == 40
    store.delete_snapshot("keep")
    for _ in range(12):
        store.snapshot()
    assert len(store.snapshots()) == 10
    with pytest.raises(ResourceNotFound):
        store.read("none")
    store.drop("things")
    assert store.tables() == []


def test_capture_and_expiry(spark, rows):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, None, True), ("a", 3, None, True), ("a", 4, "y", False), ("a", 5, "y", False)], "k string, seq int, v string, gone boolean")
    got = [(r.seq, r.event) for r in cdc.from_log(log, ["k"], "seq", F.col("gone")).orderBy("seq").collect()]
    assert got == [(1, "INSERT"), (2, "REMOVE"), (4, "INSERT"), (5, "MODIFY")]
    assert cdc.position(cdc.iterator("AT_SEQUENCE_NUMBER", 5, stream="s")) == ("s", 4)
    page = cdc.get_records(log, 2, 2)
    assert [r.seq for r in page.collect()] == [3, 4] and cdc.position(cdc.next_iterator(page, 2))[1] == 4
    assert cdc.next_sequence(log.limit(0)).first().next_sequence == 1
    t = TableDef("ttl", "pk", ttl_attribute="e")
    df = spark.createDataFrame([("a", 5.0), ("b", 5.5), ("c", -1.0), ("d", None), ("e", 99.0)], "pk string, e double")
    left, removed = cdc.sweep(df, t, 50)
    assert sorted(r.pk for r in left.collect()) == ["b", "c", "d", "e"] and removed.first().user_identity == cdc.SERVICE_IDENTITY
    assert cdc.sweep(df.withColumn("e", F.col("e").cast("string")), t, 50)[0].count() == 5


def test_exports(spark, tmp_path):
    (tmp_path / "Users" / "data").mkdir(parents=True)
    lines = ['{"Item":{"pk":{"S":"a"},"total":{"N":"5"}}}', '{"pk":{"S":"b"}}', "{bad", "", "[1]"]
    (tmp_path / "Users" / "data" / "x.json").write_text("\n".join(lines))
    with gzip.open(tmp_path / "Orders.json.gz", "wt") as f:
        f.write(lines[1] + "\n")
    found = exports.discover(spark, str(tmp_path)).collect()
    assert [r.table_name for r in found] == ["Orders", "Users"]
    items = exports.as_items(exports.read_lines(spark, [r.path for r in found]))
    assert tuple(exports.skipped(items).first()) == (6, 3)
    t = TableDef("Users", "pk", key_types=(("pk", "S"),))
    got = exports.typed(items, t, total=("N", "int")).orderBy("pk", "total").collect()
    assert [tuple(r) for r in got] == [("a", 5), ("b", None), ("b", None)]
    entities, indexes = exports.read_entities(json.dumps({"indexes": {"primary": {"hash": "pk"}}, "models": {"User": {"pk": {"type": "string", "value": "user#${id}"}, "id": {"type": "number"}}}}))
    assert entities[0].templates == {"pk": "user#${id}"} and "primary" in indexes


def test_anonymise(spark):
    df = spark.createDataFrame([("a", 12345, Row(city="Rome"), ["x"]), (None, None, None, None)], "s string, n int, m struct<city:string>, l array<string>")
    rules = [Rule("s", "mask", keep_last=5), Rule("n", "mask", keep_last=2), Rule("m.city", "fake", generator="city"), Rule("l", "redact")]
    out, warnings = anonymise.apply_rules(df, rules, TableDef("abc", "s"))
    a, b = out.collect()
    assert (a.s, a.n, a.l) == ("*", "***45", []) and a.m.city != "Rome" and tuple(b) == (None, None, None, None) and warnings
    same = anonymise.apply_rules(df, [Rule("s", "fake", generator="email")])[0].first().s
    assert same == anonymise.apply_rules(df, [Rule("s", "fake", generator="email")])[0].first().s and "@" in same
    with pytest.raises(ValidationError):
        anonymise.apply_rules(df, [Rule("s", "hash")])


def test_live_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "table_name string, pk string, sk string, image string, expires bigint, at timestamp"
    for n, data in enumerate([[("t", "a", "", "A", 100), ("t", "b", "", "B", 5000), ("t", "c", "", "C", None)], [("t", "z", "", "Z", 9000)], [("t", "y", "", "Y", 9000)]]):
        stamped = spark.createDataFrame(data, "table_name string, pk string, sk string, image string, expires bigint").withColumn("at", F.timestamp_seconds(F.lit(50 + n * 1000)))
        stamped.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.expire_live(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.pk for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a"]


def test_vacuum_keeps_the_folder_of_a_restored_version(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "pk string, sk bigint")
    table = TableDef("kept", "pk", "sk")
    store = Store(spark, f"file://{tmp_path}/s")
    store.publish(table, rows)
    store.snapshot("first")
    store.publish(table, rows.limit(0))
    store.restore("first")
    store.delete_snapshot("first")
    assert store.vacuum("kept") == [1, 2]
    assert store.read("kept").count() == 1


def test_statements_have_no_attribute_type():
    with pytest.raises(ValidationError):
        parse_statement("SELECT * FROM things WHERE ATTRIBUTE_TYPE(a, 'S')", [])
