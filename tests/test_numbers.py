"""Number text: spelling, size and order, against Decimal."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from keyloom.expr.compile import plain_number
from keyloom.functions.numbers import canonical_number, is_number, number_size, number_sort_key, sort_key_text
from keyloom.functions.sizes import item_size, native_number_size
from keyloom.operators.ranking import with_rank


def texts():
    rng = random.Random(3)
    out = ["0", "-0", "0.0", "00", "1", "1.0", "001.500", "-42", "100", "1E-130", "9.99E125", "-9.99e+125", "1e5", "0.001", "-0.00120", "123456789012345678901234567890.12345678", "12e-3"]
    for _ in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 30)))
        out.append(rng.choice(["", "-", "+"]) + digits + (f".{rng.randint(0, 99999)}" if rng.random() < 0.5 else "") + (f"E{rng.randint(-40, 40)}" if rng.random() < 0.3 else ""))
    return out


def test_spelling_size_and_order(spark):
    ts = texts()
    df = spark.createDataFrame([(t,) for t in ts], "t string")
    rows = df.select("t", canonical_number(F.col("t")).alias("c"), number_size(F.col("t")).alias("z"), number_sort_key(F.col("t")).alias("k"), is_number(F.col("t")).alias("ok")).collect()
    for r in rows:
        assert r.c == plain_number(r.t), r.t
        assert Decimal(r.c) == Decimal(r.t)
        assert r.k == sort_key_text(r.t)
        digits = "".join(map(str, Decimal(r.t).as_tuple().digits)).strip("0")
        assert r.ok == (len(digits) <= 38)
    assert [r.c for r in sorted(rows, key=lambda r: (r.k, r.c))] == [r.c for r in sorted(rows, key=lambda r: (Decimal(r.t), r.c))]
    size = {r.t: r.z for r in rows}
    assert (size["42"] if "42" in size else 2, size["-42"], size["0"], size["-0"], size["100"], size["1.0"]) == (2, 3, 1, 1, 2, 2)


def test_text_that_is_no_number(spark):
    df = spark.createDataFrame([("x",), ("",), ("1.2.3",), (None,), ("1e",), (" 1",)], "t string")
    rows = df.select("t", is_number(F.col("t")).alias("ok"), canonical_number(F.col("t")).alias("c")).collect()
    assert [r.ok for r in rows] == [False] * 6 and all(r.c == r.t for r in rows)


def test_native_sizes_equal_text_sizes(spark):
    df = spark.createDataFrame([(0.0, 0), (1.5, 10), (-2.25, -7), (1e20, 123456), (1e-7, 100), (None, None), (1200.0, 5)], "d double, i bigint")
    for c in ("d", "i"):
        kind = df.schema[c].dataType
        for r in df.select(native_number_size(F.col(c), kind).alias("a"), number_size(F.col(c).cast("string")).alias("b")).collect():
            assert r.a == r.b


def test_item_size(spark):
    df = spark.createDataFrame([("é", [1, 20], {"k": "v"}, b"abc", True, None)], "s string, l array<int>, m map<string,string>, b binary, t boolean, gone string")
    # names 5, s 2, l 3+2+2+2, m 3+1+1+1, b 3, t 1
    assert df.select(item_size(df.schema).alias("n")).first().n == 5 + 2 + 9 + 6 + 3 + 1


def test_ranks_of_a_whole_table(spark):
    rng = random.Random(5)
    values = [None, None] + [rng.choice(["7", "7.0", "-3", "1e3", str(rng.randint(-400, 400))]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, n string").repartition(7)
    ranked = with_rank(df, number_sort_key(F.col("n")), "place")
    plain = sorted(Decimal(v) for v in values if v is not None)
    first = {v: i for i, v in reversed(list(enumerate(plain)))}
    want = {i: 1 if v is None else 3 + first[Decimal(v)] for i, v in enumerate(values)}
    assert {r.id: r.place for r in ranked.collect()} == want and ranked.columns == ["id", "n", "place"]
    assert with_rank(df.limit(0), F.col("n"), "place").count() == 0


def test_every_order_gets_a_rank(spark):
    from keyloom.plans import reads

    sf = "/root/testdata/sf0.001"
    got = reads.QUERIES["number_order_all"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
