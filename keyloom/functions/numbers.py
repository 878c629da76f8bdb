"""Numbers of the document plane: text of up to 38 significant digits, beyond what a decimal column holds.

All functions are plain column expressions on the number's text, so they stay in generated code.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and exponents a number may have.
MAX_DIGITS, MIN_EXPONENT, MAX_EXPONENT = 38, -130, 125

_NUMBER = r"^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_parts(text: Column, body) -> Column:
    """``body(negative, digits, exponent)``: the significant digits without zeros at either end ('' for zero) of 0.digits times ten to the exponent."""
    split = F.struct(
        (F.regexp_extract(text, _NUMBER, 1) == "-").alias("negative"),
        F.regexp_extract(text, _NUMBER, 2).alias("whole"),
        F.concat(F.regexp_extract(text, _NUMBER, 2), F.regexp_extract(text, _NUMBER, 3)).alias("digits"),
        F.coalesce(F.regexp_extract(text, _NUMBER, 4).try_cast("int"), F.lit(0)).alias("power"),
    )

    def bare(p: Column) -> Column:
        tail = F.ltrim(p["digits"], F.lit("0"))
        return F.struct(
            p["negative"].alias("negative"),
            F.rtrim(tail, F.lit("0")).alias("digits"),
            (F.length(p["whole"]) - (F.length(p["digits"]) - F.length(tail)) + p["power"]).alias("exponent"),
        )

    return _let(split, lambda p: _let(bare(p), lambda q: body(q["negative"], q["digits"], q["exponent"])))


def is_number(text: Column) -> Column:
    """Whether ``text`` is a number the store accepts: at most 38 significant digits, magnitude 1E-130 to below 1E+126."""
    fits = lambda _, digits, exponent: (digits == "") | (
        (F.length(digits) <= MAX_DIGITS) & exponent.between(MIN_EXPONENT + 1, MAX_EXPONENT + 1)
    )
    return text.rlike(_NUMBER) & F.coalesce(_with_parts(text, fits), F.lit(False))


def canonical_number(text: Column) -> Column:
    """The one plain spelling of a number (no exponent, no superfluous zeros, no ``-0``); other text is returned as it is."""

    def spell(negative: Column, digits: Column, exponent: Column) -> Column:
        n = F.length(digits)
        plain = (
            F.when(exponent <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent), digits))
            .when(exponent >= n, F.concat(digits, F.repeat(F.lit("0"), exponent - n)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), exponent), F.lit("."), F.substring(digits, exponent + 1, n)))
        )
        return F.when(digits == "", F.lit("0")).otherwise(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), plain))

    # most numbers are plain already: the first branch spares them the work
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]*)$") | ~text.rlike(_NUMBER), text).otherwise(_with_parts(text, spell))


def number_size(text: Column) -> Column:
    """Stored bytes: one, one per two significant digits left and right of the point (rounded up each), one for a minus sign."""

    def size(negative: Column, digits: Column, exponent: Column) -> Column:
        n = F.length(digits)
        left = F.greatest(F.lit(0), F.least(exponent, n))
        sign = F.when(negative & (digits != ""), 1).otherwise(0)
        return (F.lit(1) + F.ceil(left / 2) + F.ceil((n - left) / 2) + sign).cast("int")

    return _with_parts(F.btrim(text), size)


def number_sort_key(text: Column) -> Column:
    """Text whose byte order is the numeric order: sign 0/1/2, exponent plus 5000 in four digits, mantissa in forty; negatives in nines complement."""

    def encode(negative: Column, digits: Column, exponent: Column) -> Column:
        up = F.concat(F.lpad((exponent + 5000).cast("string"), 4, "0"), F.rpad(digits, 40, "0"))
        down = F.translate(up, "0123456789", "9876543210")
        return F.when(digits == "", F.lit("1" + "0" * 44)).when(negative, F.concat(F.lit("0"), down)).otherwise(F.concat(F.lit("2"), up))

    return _with_parts(text, encode)


def sort_key_text(text: str) -> str:
    """``number_sort_key`` of one number, for literals."""
    d = Decimal(text)
    if not d:
        return "1" + "0" * 44
    sign, digits, exponent = d.as_tuple()
    bare = "".join(map(str, digits)).rstrip("0")
    up = f"{len(digits) + exponent + 5000:04d}{bare.ljust(40, '0')}"
    return "0" + up.translate(str.maketrans("0123456789", "9876543210")) if sign else "2" + up
