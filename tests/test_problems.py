"""The five data problems on small awkward tables, against brute force."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import changefeed, drift, hotkeys, nested, orphans

ITEMS = "row_id bigint, table_name string, pk string, sk string, item_json string, item_size bigint, n_rows int, kind string"


def items(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "clash") for i, r in enumerate(rows)], ITEMS)


# --- a few keys holding most records
def test_heavy_keys(spark):
    rows = [("t", "hot", None, None, 1)] * 300 + [("t", f"k{i}", None, None, None) for i in range(600)] + [("u", "hot", None, None, 0)] * 9 + [("t", None, None, None, 5)] * 50 + [("t", "", None, None, 5)] * 50 + [("t", "fat", None, None, 10**12), (None, "x", None, None, 1)]
    got = {(r.table_name, r.pk): (r.n_rows, r.n_bytes) for r in hotkeys.heavy_keys(items(spark, rows)).collect()}
    assert got == {("t", "hot"): (300, 300), ("t", "fat"): (1, 10**12)}
    totals = hotkeys.key_totals(items(spark, rows)).collect()
    assert sum(r.n_rows for r in totals) == len(rows) and any(r.pk is None for r in totals)


def test_heavy_keys_of_nothing(spark):
    assert hotkeys.heavy_keys(items(spark, [])).count() == 0
    zero = items(spark, [("t", f"k{i}", None, None, 0) for i in range(300)])
    assert hotkeys.heavy_keys(zero).count() == 0
    tie = items(spark, [("t", f"k{i}", None, None, 1) for i in range(100)])
    assert hotkeys.heavy_keys(tie).count() == 100
    assert hotkeys.key_load(tie, tasks=4).agg(F.sum("raw_rows")).first()[0] == 100


# --- schemas that drift
LINES = "line_id bigint, table_name string, file_name string, exported_at timestamp, line_no int, item_json string, path string, change string"


def lines(spark, files):
    rows, n = [], 0
    for table, file, day, texts in files:
        for k, t in enumerate(texts):
            rows.append((n, table, file, f"2025-01-{day:02d} 00:00:00", k, t if t is None or isinstance(t, str) else json.dumps(t), "clash", "clash"))
            n += 1
    return spark.createDataFrame(rows, LINES.replace("timestamp", "string")).withColumn("exported_at", F.col("exported_at").cast("timestamp"))


def it(pk, **attributes):
    return {"pk": {"S": pk}, "sk": {"S": "1"}, **attributes}


def test_drift(spark):
    first = [it(f"i{n}", old={"S": f"v{n}"}, m={"M": {"x": {"N": "1"}, "gone": {"SS": ["b", "a"]}}}, kind={"N": "1"}, nul={"NULL": True}, l={"L": [{"M": {"deep": {"S": "x"}}}]}) for n in range(5)]
    second = [{"Item": it(f"i{n}", new={"S": f"v{n}" if n < 4 else "other"}, m={"M": {"x": {"N": "1"}, "back": {"SS": ["a", "b"]}}}, kind={"S": "1"}, nul={"S": "x"}, extra={"NULL": True})} for n in range(5)]
    third = [it(f"i{n}", new={"S": f"v{n}"}) for n in range(2)]
    df = lines(spark, [("t", "a", 1, [*first, first[0], None, "", "[1]", '{"cut', "5"]), ("t", "b", 2, second), ("t", "c", 3, ["null"]), ("t", "d", 4, third), ("u", "a", 2, first)])
    got = {tuple(r) for r in drift.drift_report(df).collect()}
    changes = defaultdict(set)
    for table, file, change, path, new in got:
        changes[table, file].add((change, path, new))
    assert changes["t", "b"] == {("renamed", "old", "new"), ("renamed", "m.gone", "m.back"), ("retyped", "kind", ""), ("removed", "l", ""), ("added", "extra", "")}
    assert changes["t", "c"] == {("removed", p, "") for p in ("pk", "sk", "new", "m", "m.x", "m.back", "kind", "nul", "extra")}
    assert changes["t", "d"] == {("added", p, "") for p in ("pk", "sk", "new")}
    assert ("u", "a") not in changes and len(got) == len(drift.drift_report(df).collect())


def test_drift_needs_three_items(spark):
    df = lines(spark, [("t", "a", 1, [it("x", p={"S": "1"}), it("y", p={"S": "2"})]), ("t", "b", 2, [it("x", q={"S": "1"}), it("y", q={"S": "2"})])])
    assert {(r.change, r.path) for r in drift.drift_report(df).collect()} == {("removed", "p"), ("added", "q")}


def test_drift_of_nothing_and_unplaced_lines(spark):
    assert drift.drift_report(lines(spark, [])).count() == 0
    df = lines(spark, [(None, "a", 1, [it("x")]), ("t", None, 1, [it("x")]), ("t", "only", 1, [it("x")])])
    assert drift.drift_report(df).count() == 0 and drift.rescue_ingest(df).count() == 3


def test_promotion_keeps_what_does_not_fit(spark):
    df = lines(spark, [("t", "a", 1, [it("x", n={"N": "5"}, o={"S": "q"}), it("y", n={"S": "five"}), {"pk": {"NULL": True}, "n": {"N": "7"}}])])
    got = {r.line_no: r for r in drift.promote(drift.rescue_ingest(df), n="bigint").collect()}
    assert (got[0].n, got[1].n, got[2].n) == (5, None, 7)
    assert "n" not in json.loads(got[0].rescued) and json.loads(got[0].rescued)["o"] == {"S": "q"} and json.loads(got[1].rescued)["n"] == {"S": "five"}
    assert got[2].pk is None and got[2].sk == ""


# --- nested records
def brute_elements(item):
    out = []

    def walk(v, path, parent):
        (tag, x), = v.items()
        if tag == "M":
            for k, c in x.items():
                walk(c, f"{path}.{k}" if path else k, parent)
        elif tag == "L":
            for i, c in enumerate(x):
                at = f"{path}[{i}]"
                if "M" in c:
                    out.append((at, parent))
                    walk(c, at, at)
                else:
                    walk(c, at, parent)

    walk({"M": item}, "", "")
    return out


def random_value(rng, depth=0):
    kind = rng.choice(["S", "N", "M", "L", "L"]) if depth < 5 else "S"
    if kind == "M":
        return {"M": {k: random_value(rng, depth + 1) for k in rng.sample("abML", rng.randint(0, 3))}}
    if kind == "L":
        return {"L": [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]}
    return {kind: "1"}


def test_nested_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [{k: random_value(rng) for k in "abc"} for _ in range(80)]
    rows = [("f", i, json.dumps(d), "x") for i, d in enumerate(docs)] + [("f", 900, None, "x"), ("f", 901, "", "x"), ("f", 902, '{"a":{"L":[{"M":{}', "x"), ("f", 903, "[1]", "x"), ("f", None, json.dumps({"a": {"\\u004c": 1}}), "x"), ("f", 905, '{"a":{"\\u004c":[{"M":{}}]}}', "x"), ("f", 906, '{"a":' * 5000 + "1" + "}" * 5000, "x")]
    df = spark.createDataFrame(rows, "source_field string, record_id bigint, text string, child_path string")
    got = Counter((r.record_id, r.child_path, r.parent_path) for r in nested.element_rows(df).collect())
    want = Counter((i, p, q) for i, d in enumerate(docs) for p, q in brute_elements(d)) + Counter([(905, "a[0]", "")])
    assert got == want
    full = nested.element_rows(df, scalars=True)
    assert full.count() == sum(want.values())
    assert {(r.record_id, r.child_path): r.variant for r in full.collect()} == {(r.record_id, r.child_path): r.variant for r in nested.element_rows(df).collect()}


def test_equal_shapes_are_one_variant(spark):
    docs = ['{"l":{"L":[{"M":{"a":{"S":"x"},"b":{"N":"1"}}},{"M":{"b":{"N":"2"},"a":{"S":"y"}}},{"M":{"a":{"S":"z"}}}]}}']
    df = spark.createDataFrame([("f", 1, d) for d in docs], "source_field string, record_id bigint, text string")
    rows = nested.element_rows(df, scalars=True)
    assert sorted(r.n_rows for r in nested.variants(rows).collect()) == [1, 2]
    table = nested.subtype(rows, "l[]", a="string", b="int").orderBy("child_path").collect()
    assert [(r.a, r.b) for r in table] == [("x", 1), ("y", 2), ("z", None)]
    assert nested.element_rows(df.limit(0)).count() == 0


def test_no_value_of_an_element_is_lost(spark):
    element = {
        "ship": {"M": {"carrier": {"S": "c"}, "to": {"M": {"zip": {"N": "7"}, "gone": {"NULL": True}}}, "stops": {"L": [{"M": {"hub": {"S": "h"}}}]}}},
        "a.b": {"S": "own"}, "a": {"M": {"b": {"S": "inner"}}}, "tags": {"L": [{"S": "x"}, {"M": {"in": {"S": "row"}}}, {"L": [{"N": "1.0"}]}]},
        "set": {"SS": ["p", "q"]}, "maps": {"L": [{"M": {}}]}, "odd": {"x": 1, "y": 2}, "half": {"S": "\ud800"},
    }
    df = spark.createDataFrame([("f", 1, json.dumps({"l": {"L": [{"M": element}]}}))], "source_field string, record_id bigint, text string")
    rows = nested.element_rows(df, scalars=True)
    got = {r.child_path: r.scalars for r in rows.collect()}
    assert got["l[0]"] == {
        "ship.carrier": "c", "ship.to.zip": "7", "`a.b`": "own", "a.b": "inner", "tags": '[{"S":"x"},null,{"L":[{"N":"1.0"}]}]', "set": '["p","q"]', "odd": '{"x":1,"y":2}', "half": "\ufffd",
    }
    assert got["l[0].ship.stops[0]"] == {"hub": "h"} and got["l[0].tags[1]"] == {"in": "row"} and got["l[0].maps[0]"] == {} and len(got) == 4
    assert nested.subtype(rows, "l[]", **{"ship.to.zip": "int"}).first()["ship.to.zip"] == 7


def test_every_kind_gets_its_typed_table(spark):
    docs = [
        {"l": {"L": [{"M": {"n": {"N": "5"}, "p": {"N": "7.50"}, "wide": {"N": "1E-130"}, "mix": {"S": "x"}, "ok": {"BOOL": True}, "set": {"NS": ["1"]}, "variant": {"S": "v"}, "nil": {"NULL": True}}}]}},
        {"l": {"L": [{"M": {"n": {"N": "-1.0e2"}, "p": {"N": "123"}, "wide": {"N": "9E125"}, "mix": {"N": "1"}, "N": {"S": "case"}, "kids": {"L": [{"M": {"m": {"M": {"deep": {"N": "1" * 20}}}}}, {"M": {}}]}}}]}},
        {"only": {"L": [{"M": {}}, {"L": [{"M": {"b": {"BOOL": "yes"}}}]}]}},
    ]
    df = spark.createDataFrame([("f", i, json.dumps(d)) for i, d in enumerate(docs)], "source_field string, record_id bigint, text string")
    kinds = nested.kind_columns(df)
    assert set(kinds) == {"l[]", "l[].kids[]", "only[]", "only[][]"}
    assert kinds["l[]"] == {"n": "bigint", "p": "decimal(4,1)", "wide": "string", "mix": "string", "ok": "boolean", "set": "array<string>", "variant": "string", "nil": "string", "N": "string"}
    assert kinds["l[].kids[]"] == {"m.deep": "decimal(20,0)"} and kinds["only[]"] == {} and kinds["only[][]"] == {"b": "string"}
    tables = nested.subtypes(df)
    first, second = tables["l[]"].orderBy("record_id").collect()
    assert (first["n_2"], str(first["p"]), first["wide"], first["mix"], first["ok"], first["set"], first["variant_2"], first["nil"]) == (5, "7.5", "1E-130", "x", True, ["1"], "v", None)
    assert (second["n_2"], str(second["p"]), second["mix"], second["N"]) == (-100, "123.0", "1", "case") and first["variant"] != second["variant"]
    assert tables["only[]"].count() == 1 and tables["only[][]"].first()["b"] == "yes"
    everything = nested.all_subtypes(df).collect()
    assert Counter((r.record_id, r.child_path, r.parent_path) for r in everything) == Counter((i, p, q) for i, d in enumerate(docs) for p, q in brute_elements(d))
    assert {r.child_path: str(r["l[].kids[]"]["m.deep"]) for r in everything if r.kind == "l[].kids[]"} == {"l[0].kids[0]": "1" * 20, "l[0].kids[1]": "None"}
    assert all((r["l[]"] is None) == (r.kind != "l[]") for r in everything)
    assert nested.all_subtypes(df.limit(0)).count() == 0


def test_typed_tables_hold_every_value_of_the_data(spark):
    from keyloom.plans import general

    docs = general._documents(spark, "/root/testdata/sf0.001")
    kinds = nested.kind_columns(docs)
    assert len(kinds) > 20
    want = nested.element_rows(docs, scalars=True).groupBy("kind").agg(F.sum(F.size("scalars")).alias("n")).collect()
    tables = nested.subtypes(docs, kinds)
    for r in want:
        values = tables[r.kind].columns[5:]
        got = tables[r.kind].select(F.sum(sum((F.col(f"`{c.replace('`', '``')}`").isNotNull().cast("int") for c in values), F.lit(0)))).first()[0]
        assert got == r.n, r.kind


def test_depth_beyond_the_recursion_limit(spark):
    path, wants = "", []
    for _ in range(700):
        wants.append((path + ".l[0]" if path else "l[0]", path))
        path = wants[-1][0]
    nest = '{"L":[' * 1500 + '{"S":"x"}' + "]}" * 1500
    text = '{"pk":{"S":"1"},"l":{"L":[' + '{"M":{"l":{"L":[' * 699 + '{"M":{"z":{"N":"1"}}}' + "]}}}" * 699 + "]}}"
    df = spark.createDataFrame([("f", 1, text), ("f", 2, '{"m":{"L":[{"M":{"n":' + nest + "}}]}}")], "source_field string, record_id bigint, text string")
    rows = nested.element_rows(df, scalars=True).collect()
    assert [(r.child_path, r.parent_path) for r in rows if r.record_id == 1] == wants
    assert [(r.child_path, r.scalars["n"].count("[")) for r in rows if r.record_id == 2] == [("m[0]", 1500)]
    assert nested.element_rows(df).count() == 701
    maps = json.loads('{"pk":{"S":"x"},"m":' + '{"M":{"m":' * 1200 + '{"N":"1"}' + "}}" * 1200 + "}")
    paths: dict = {}
    drift._paths(maps, "", paths)
    assert len(paths) == 1202


def test_deep_walk_equals_the_plain_one():
    rng = random.Random(8)
    for _ in range(200):
        item = {k: random_value(rng) for k in "abc"}
        deep: list = []
        plain, other = nested.ShapeAutomaton(True), nested.ShapeAutomaton(True)
        for name, value in item.items():
            other._deep(value, name, deep)
        assert deep[::-1] == plain.read(item)


# --- change feeds
CHANGES = "id bigint, table_name string, event_name string, keys_json string, sequence_number string, created_at bigint, pk string"
CATALOG = "table_name string, key_schema string"


def feed(spark, rows):
    return spark.createDataFrame([(i, *r, 100 + i, "clash") for i, r in enumerate(rows)], CHANGES)


@pytest.fixture(scope="module")
def catalog(spark):
    schema = '[{"KeyType":"RANGE","AttributeName":"b"},{"KeyType":"HASH","AttributeName":"a"}]'
    return spark.createDataFrame([("t", schema), ("h", '[{"AttributeName":"a","KeyType":"HASH"}]'), ("z", None)], CATALOG)


def key(a, b=None):
    return json.dumps({"a": {"S": a}} | ({"b": {"N": b}} if b is not None else {}))


def test_changefeed(spark, catalog):
    rows = [
        ("t", "INSERT", key("x", "1"), "10"), ("t", " remove ", key("x", "1.0"), "000000000000000000012"), ("t", "INSERT", key("x", "1"), "11"), ("t", "INSERT", key("x", "1"), "11"),
        ("t", "Modify", key("y", "2"), "3"), ("t", "HEARTBEAT", key("y", "2"), "9"), ("t", None, key("y", "2"), "9"), ("t", "REMOVE", key("y", "2"), "n/a"), ("t", "REMOVE", key("y", "2"), ""), ("t", "REMOVE", key("y", "2"), None),
        ("t", "REMOVE", key("w", "1"), "50"), ("h", "INSERT", key("x"), "1"), ("h", "INSERT", "{broken", "2"), ("h", "INSERT", None, "3"), (None, "INSERT", key("q"), "1"), ("t", "REMOVE", key("y", "2"), "1.5"), ("z", "INSERT", '{"pk":{"S":"p"}}', "+7"),
    ]
    got = {(r.table_name, r.pk, r.sk, r.seq) for r in changefeed.current_state(changefeed.read_changes(feed(spark, rows), catalog)).collect()}
    assert got == {("t", "y", "2", 3), ("h", "x", "", 1), ("z", "p", "", 7)}
    assert changefeed.current_state(changefeed.read_changes(feed(spark, []), catalog)).count() == 0


def test_changefeed_equals_replay_in_any_order(spark, catalog):
    rng = random.Random(8)
    log = [(n, rng.choice(["INSERT", "MODIFY", "REMOVE"]), f"k{rng.randint(0, 6) if rng.random() < 0.6 else 0}", str(rng.randint(0, 3))) for n in range(400)]
    state = {}
    for n, e, a, b in log:
        state.pop((a, b), None)
        if e != "REMOVE":
            state[a, b] = n
    sent = log + rng.sample(log, 100)
    rng.shuffle(sent)
    df = changefeed.read_changes(feed(spark, [("t", e, key(a, b), str(n).zfill(rng.randint(1, 25))) for n, e, a, b in sent]), catalog)
    assert {(r.pk, r.sk): r.seq for r in changefeed.current_state(df).collect()} == state
    assert changefeed.distinct_changes(df).count() == 400
    # in two parts, the first as a base
    base = changefeed.current_state(df.where("seq < 200"))
    assert {(r.pk, r.sk): r.seq for r in changefeed.current_state(df.where("seq >= 200"), base).collect()} == state


# --- references to records that do not exist
def test_orphans_equal_brute_force(spark):
    rng = random.Random(2)
    month = 30 * 86_400_000_000
    parents = [("t", f"p{rng.randint(0, 60)}", rng.choice([None, "", "s"]), rng.choice([None, rng.randint(0, 12 * month)]), rng.random() < 0.8) for _ in range(150)]
    refs = [(i, rng.choice(["t", "t", "u", None]), "p0" if i % 3 == 0 else rng.choice([None, "", *(f"p{n}" for n in range(80))]), rng.choice([None, "", "s"]), rng.choice([None, rng.randint(0, 12 * month)])) for i in range(600)]
    known = defaultdict(list)
    for t, p, s, at, present in parents:
        known[t, p, s or ""].append((at, present))
    want = {}
    for i, t, p, s, at in refs:
        if t is None or p is None:
            continue
        own = known.get((t, p, s or ""), [])
        arrival = min((a for a, _ in own if a is not None), default=None)
        if not any(x for _, x in own):
            want[i] = "absent"
        elif arrival is not None and at is not None and arrival > at:
            want[i] = "late"
    r = spark.createDataFrame(refs, "entry_id bigint, table_name string, pk string, sk string, at bigint").withColumn("month", F.lit("clash"))
    p = spark.createDataFrame(parents, "table_name string, pk string, sk string, arrival bigint, present boolean").withColumn("months", F.lit(1))
    found = orphans.find_orphans(r, p)
    assert {x.entry_id: x.kind for x in found.collect()} == want
    report = orphans.orphan_report(found)
    assert report.agg(F.sum("n_entries")).first()[0] == len(want)
    assert orphans.find_orphans(r, p.limit(0)).count() == sum(t is not None and q is not None for _, t, q, _, _ in refs)
    assert orphans.find_orphans(r.limit(0), p).count() == 0


def test_code_sets():
    rng = np.random.default_rng(1)
    for n, m in ((10, 10), (5000, 10), (10, 5000), (30000, 50000), (0, 5)):
        a, b = rng.choice(orphans.RANGE, n, replace=False), rng.choice(orphans.RANGE, m, replace=False)
        assert orphans.CodeSet(a).and_not(orphans.CodeSet(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def test_shape_does_not_depend_on_the_memory_of_states(monkeypatch):
    item = {"a": {"L": [{"M": {"b": {"L": [{"M": {"c": {"S": "x"}}}, {"M": {"d": {"N": "1"}}}]}}}]}}
    whole = nested.ShapeAutomaton(False).read(item)
    monkeypatch.setattr(nested, "KNOWN_STATES", 1)
    small = nested.ShapeAutomaton(False)
    small.read({"z": {"L": [{"M": {"q": {"S": "x"}}}]}})
    assert small.read(item) == whole
