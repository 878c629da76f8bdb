"""Stored sizes and the capacity they cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.numbers import number_size


def native_number_size(column: Column, kind: T.DataType) -> Column:
    """``number_size`` of a native number, in plain string functions unless its text has an exponent."""
    text = F.ltrim(column.cast("string"), F.lit("-"))
    sign = F.when(column < 0, 1).otherwise(0)
    half = lambda t: F.ceil(F.length(t) / 2)
    if isinstance(kind, T.IntegralType):
        return F.when(column == 0, 1).otherwise(1 + half(F.rtrim(text, F.lit("0"))) + sign)
    whole = F.ltrim(F.substring_index(text, ".", 1), F.lit("0"))
    part = F.when(text.contains("."), F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise("")
    left = F.when(part == "", F.rtrim(whole, F.lit("0"))).otherwise(whole)
    right = F.when(whole == "", F.ltrim(part, F.lit("0"))).otherwise(part)
    return F.when(text.contains("E"), number_size(column.cast("string"))).when(column == 0, 1).otherwise(1 + half(left) + half(right) + sign)


def value_size(column: Column, kind: T.DataType) -> Column:
    """Stored bytes of a native value, 0 where it is missing."""
    zero = F.lit(0)
    if isinstance(kind, T.StringType):
        size = F.octet_length(column)
    elif isinstance(kind, T.BinaryType):
        size = F.octet_length(column)
    elif isinstance(kind, T.BooleanType):
        size = F.lit(1)
    elif isinstance(kind, T.NumericType):
        size = native_number_size(column, kind)
    elif isinstance(kind, T.ArrayType):
        inner = F.aggregate(column, zero.cast("int"), lambda a, x: a + value_size(x, kind.elementType))
        size = F.lit(3) + F.size(column) + inner
    elif isinstance(kind, T.StructType):
        size = F.lit(3)
        for f in kind.fields:
            part = column.getField(f.name)
            size = size + F.when(part.isNotNull(), F.lit(len(f.name.encode()) + 1) + value_size(part, f.dataType)).otherwise(zero)
    elif isinstance(kind, T.MapType):
        pairs = F.map_entries(column)
        size = F.lit(3) + F.aggregate(pairs, zero.cast("int"), lambda a, e: a + F.octet_length(e["key"]) + 1 + value_size(e["value"], kind.valueType))
    else:
        size = F.octet_length(column.cast("string"))
    return F.when(column.isNotNull(), size).otherwise(zero).cast("int")


def item_size(schema: T.StructType) -> Column:
    """Stored bytes of a row: names and values of the attributes it has."""
    total = F.lit(0)
    for f in schema.fields:
        column = F.col(f"`{f.name}`")
        total = total + F.when(column.isNotNull(), F.lit(len(f.name.encode())) + value_size(column, f.dataType)).otherwise(F.lit(0))
    return total.cast("int")


def read_units(bytes_: Column, consistent: bool = False, transactional: bool = False) -> Column:
    """Read capacity: 4 KB units of the evaluated bytes, one at least; halved if eventual, doubled in transactions."""
    units = F.greatest(F.ceil(F.coalesce(bytes_, F.lit(0)) / 4096), F.lit(1)).cast("double")
    return units * (2.0 if transactional else 1.0 if consistent else 0.5)


def write_units(old: Column, new: Column, transactional: bool = False) -> Column:
    """Write capacity: 1 KB units of the larger image, one at least; doubled in transactions."""
    of = lambda b: F.ceil(F.coalesce(b, F.lit(0)) / 1024)
    return F.greatest(of(old), of(new), F.lit(1)).cast("double") * (2.0 if transactional else 1.0)


def index_units(old: Column, new: Column, same: Column, key_moved: Column) -> Column:
    """Write capacity of one index: nothing if its copy is unchanged, both images if its key moves, the larger if changed in place.

    ``old`` and ``new`` are the sizes of the copy before and after, NULL where the row isn't in the index.
    """
    of = lambda b: F.greatest(F.ceil(b / 1024), F.lit(1)).cast("double")
    return (
        F.when(old.isNull() & new.isNull(), 0.0)
        .when(old.isNull(), of(new))
        .when(new.isNull(), of(old))
        .when(same, 0.0)
        .when(key_moved, of(old) + of(new))
        .otherwise(F.greatest(of(old), of(new)))
    )
