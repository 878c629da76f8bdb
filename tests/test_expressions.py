"""The compiler against the interpreter on random items and predicates, in both planes."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyloom.errors import ValidationError
from keyloom.expr import parse
from keyloom.expr.ast import And, BeginsWith, Between, Compare, Contains, Exists, In, Literal, Not, Or, Path, Size, TypeIs, literal
from keyloom.expr.compile import Compiler, Document, Typed, canonical_document
from keyloom.expr.interpret import evaluate
from keyloom.model import IndexDef, TableDef

VALUES = [
    {"S": "abc"}, {"S": "ab"}, {"S": ""}, {"S": "5"}, {"S": "😀x"}, {"N": "5"}, {"N": "5.0"}, {"N": "-0"}, {"N": "0"}, {"N": "-12.5"}, {"N": "1E-130"}, {"N": "9.99E125"}, {"N": "100"},
    {"B": "YWI="}, {"B": "YWJj"}, {"B": "/w=="}, {"BOOL": True}, {"BOOL": False}, {"NULL": True}, {"SS": ["a", "b"]}, {"SS": ["b", "a"]}, {"SS": ["abc"]}, {"NS": ["1", "2.0"]}, {"NS": ["2", "1.0"]}, {"NS": ["5"]},
    {"BS": ["YWI="]}, {"L": [{"S": "abc"}, {"N": "5.0"}]}, {"L": []}, {"L": [{"N": "5"}]}, {"M": {"x": {"N": "1"}, "y": {"S": "ab"}}}, {"M": {"y": {"S": "ab"}, "x": {"N": "1.00"}}}, {"M": {}}, None,
]
PATHS = [Path(("a",)), Path(("b",)), Path(("a", "x")), Path(("a", 0)), Path(("b", 1)), Path(("nowhere",))]


def random_predicate(rng, depth=0):
    kind = rng.choice(["and", "or", "not", *["leaf"] * 5]) if depth < 3 else "leaf"
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)(tuple(random_predicate(rng, depth + 1) for _ in range(rng.randint(2, 3))))
    if kind == "not":
        return Not(random_predicate(rng, depth + 1))
    path = lambda: rng.choice(PATHS)
    value = lambda: literal(rng.choice(VALUES[:-1]))
    operand = lambda: rng.choice([path, value, lambda: Size(path())])()
    return rng.choice([
        lambda: Compare(rng.choice(["=", "<>", "<", "<=", ">", ">="]), path(), operand()),
        lambda: Compare(rng.choice(["=", "<>", "<", ">="]), Size(path()), Literal("N", str(rng.randint(0, 3)))),
        lambda: Between(path(), value(), value()),
        lambda: In(path(), tuple(value() for _ in range(3))),
        lambda: Exists(path(), rng.random() < 0.5),
        lambda: TypeIs(path(), rng.choice(["S", "N", "L", "M", "SS", "NULL", "BOOL", "B"])),
        lambda: BeginsWith(path(), rng.choice([literal({"S": "ab"}), literal({"B": "YWI="}), path()])),
        lambda: Contains(path(), value()),
    ])()


@pytest.mark.parametrize("dialect", ["condition", "statement"])
def test_document_plane_equals_interpreter(spark, dialect):
    rng = random.Random(5)
    items = [{k: v for k, v in (("a", rng.choice(VALUES)), ("b", rng.choice(VALUES))) if v} for _ in range(90)]
    canonical = [json.loads(json.dumps(i)) for i in items]
    df = spark.createDataFrame([(n, json.dumps(i)) for n, i in enumerate(items)], "n int, j string").withColumn("doc", canonical_document(F.col("j"))).cache()
    assert df.where("doc is null").count() == 0
    for _ in range(5):
        trees = [random_predicate(rng) for _ in range(4)]
        if dialect == "statement":  # lists compare by structure there, which canonical numbers blur
            trees = [t for t in trees if "Contains" not in repr(t)]
        if not trees:
            continue
        compiler = Compiler(Document("doc"), dialect)
        got = df.select("n", *(compiler.value(t).alias(f"v{i}") for i, t in enumerate(trees)), *(F.coalesce(compiler.filter(t), F.lit(False)).alias(f"f{i}") for i, t in enumerate(trees))).orderBy("n").collect()
        for i, t in enumerate(trees):
            want = [evaluate(t, item, dialect) for item in canonical]
            assert [r[f"v{i}"] for r in got] == want, t
            assert [r[f"f{i}"] for r in got] == want, t


def test_typed_plane_equals_interpreter(spark):
    rng = random.Random(9)
    rows = [(n, rng.choice([None, 1, 5, 7]), rng.choice([None, 0.5, 5.0]), rng.choice([None, "", "ab", "abc", "😀"]), rng.choice([None, True, False]), rng.choice([None, [], [1, 5], [5]])) for n in range(120)]
    df = spark.createDataFrame(rows, "n int, i bigint, d double, s string, t boolean, l array<bigint>")
    names = ["i", "d", "s", "t", "l", "none"]

    def tagged(row):
        out = {}
        for name, v in zip(names, row[1:]):
            if v is not None:
                out[name] = {"BOOL": v} if isinstance(v, bool) else {"N": str(Decimal(str(v)))} if isinstance(v, (int, float)) else {"S": v} if isinstance(v, str) else {"L": [{"N": str(x)} for x in v]}
        return out

    items = [tagged(r) for r in rows]
    values = [literal(v) for v in (1, 5, 5.0, 7.5, "ab", "", True, "5", {"L": [{"N": "5"}]})]

    def leaf():
        p, q = Path((rng.choice(names),)), Path((rng.choice(names),))
        return rng.choice([
            lambda: Compare(rng.choice(["=", "<>", "<", "<=", ">", ">="]), p, rng.choice([*values, q])), lambda: In(p, tuple(rng.sample(values, 3))), lambda: Exists(p, rng.random() < 0.5),
            lambda: Between(p, values[0], values[3]), lambda: BeginsWith(p, literal("ab")), lambda: Contains(p, rng.choice([v for v in values if v.value != "5.0"])),  # native numbers have no spelling
            lambda: Compare(">", Size(p), literal(1)), lambda: TypeIs(p, rng.choice("SNL")),
        ])()

    for dialect in ("condition", "statement"):
        compiler = Compiler(Typed(df.schema), dialect)
        for _ in range(8):
            trees = [Not(leaf()), And((leaf(), Not(Or((leaf(), Not(leaf())))))), Or((leaf(), leaf())), leaf()]
            got = df.select("n", *(compiler.value(t).alias(f"v{i}") for i, t in enumerate(trees)), *(F.coalesce(compiler.filter(t), F.lit(False)).alias(f"f{i}") for i, t in enumerate(trees))).orderBy("n").collect()
            for i, t in enumerate(trees):
                want = [evaluate(t, item, dialect) for item in items]
                assert [r[f"v{i}"] for r in got] == want, (dialect, t)
                assert [r[f"f{i}"] for r in got] == want, (dialect, t)


def test_bare_leaves_are_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    scope = parse.Scope({}, {":a": 5, ":p": "1"})
    plan = df.where(Compiler(Typed(df.schema)).filter(parse.condition("id > :a AND begins_with(s, :p)", scope)))._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan and "StringStartsWith(s,1)" in plan


@pytest.mark.parametrize("text", ["", "a =", "a = :x AND", "((a = :x))", "begins_with(a, :n)", "contains(a, a)", "a BETWEEN :n AND :m", "foo(a)", "a = :nope", "#q = :x", "attribute_type(a, :x)", "a = :x b", "a $ b"])
def test_bad_conditions(text):
    with pytest.raises(ValidationError):
        parse.condition(text, parse.Scope({}, {":x": "x", ":n": 5, ":m": 1}))


def test_scope_rejects_unused_and_reserved():
    s = parse.Scope({"#a": "a"}, {":x": 1, ":y": 2})
    parse.condition("#a = :x", s)
    with pytest.raises(ValidationError):
        s.close()
    with pytest.raises(ValidationError):
        parse.condition("size = :x", parse.Scope({}, {":x": 1}, frozenset({"SIZE"})))


def test_key_conditions():
    s = lambda: parse.Scope({}, {":a": 1, ":b": 2})
    assert parse.key_condition(":a < sk AND pk = :b", s(), "pk", "sk").parts[1].op == ">"
    for bad in ("pk > :a", "sk = :a", "pk = :a AND pk = :b", "pk = :a AND other = :b", "pk = :a AND sk <> :b", "pk = :a OR sk = :b", "pk.x = :a"):
        with pytest.raises(ValidationError):
            parse.key_condition(bad, s(), "pk", "sk")


def test_updates_are_validated():
    t = TableDef("tab", "pk")
    for bad in ("SET pk = :n", "SET a = :n SET b = :n", "SET a = :n REMOVE a.b", "ADD a :s", "DELETE a :n", "SET a.b = :n, a[0] = :n", "SET a"):
        with pytest.raises(ValidationError):
            parse.update(bad, parse.Scope({}, {":n": 1, ":s": "x"}), t)
    assert len(parse.update("SET a = if_not_exists(a, :n) + :n, b = list_append(b, :l) REMOVE c[0]", parse.Scope({}, {":n": 1, ":l": [1]}), t).paths) == 3


def test_definitions():
    t = TableDef("orders", "pk", "sk", (("pk", "S"), ("sk", "N")), (IndexDef("g", "x", None, "INCLUDE", ("y",)), IndexDef("l", "pk", "z", "KEYS_ONLY", local=True)), "NEW_IMAGE")
    assert TableDef.from_description({"Table": t.describe()}) == t
    assert t.index_columns(t.index("g"), ["y", "sk", "pk", "x", "other"]) == ["y", "sk", "pk", "x"]
    for bad in (lambda: TableDef("x", "pk"), lambda: TableDef("abc", "pk", "pk"), lambda: TableDef("abc", "pk", indexes=(IndexDef("l", "pk", "z", local=True),)), lambda: TableDef("abc", "pk", indexes=tuple(IndexDef(f"i{n}", "x") for n in range(21)))):
        with pytest.raises(ValidationError):
            bad()
