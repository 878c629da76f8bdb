"""Anonymising rules, applied in order to native or tagged columns.

Replacements are pure functions of seed and value, so equal values become equal ones in all tables of a run, with
no map of past replacements to share or to cap.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ValidationError
from keyloom.expr import parse
from keyloom.expr.ast import Path
from keyloom.expr.compile import Compiler, Typed
from keyloom.model import TableDef

#: What generated replacements are made of.
FAKES = {
    "first_name": ["Alex", "Billie", "Casey", "Devon", "Emery", "Frankie", "Gale", "Harper", "Indigo", "Jules", "Kit", "Lane", "Morgan", "Noel", "Oakley", "Quinn"],
    "last_name": ["Ashby", "Birch", "Croft", "Dale", "Elm", "Forde", "Glen", "Hollis", "Irving", "Joss", "Keld", "Lowe", "Marsh", "Nye", "Orme", "Pike"],
    "city": ["Alderton", "Brookfield", "Crestwick", "Dunmore", "Easthaven", "Fairbridge", "Glenmoor", "Highcliff"],
    "company": ["Amber Works", "Birch & Co", "Cedar Group", "Delta Partners", "Ember Labs", "Fern Trading", "Grove Ltd", "Harbor Union"],
    "word": ["amber", "birch", "cedar", "delta", "ember", "fern", "grove", "harbor"],
}
GENERATORS = ("first_name", "last_name", "full_name", "email", "phone", "address", "city", "company", "word")


@dataclass(frozen=True)
class Rule:
    """One rule: where ``match`` holds and ``path`` exists, ``action`` replaces the value."""

    path: str
    action: str
    match: str | None = None
    names: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    keep_last: int = 0
    mask: str = "*"
    salt: str | None = None
    generator: str | None = None
    seed: str = "0"


def masked(value: Column, keep_last: int = 0, mask: str = "*") -> Column:
    """All but the last ``keep_last`` characters as mask characters; a value that is shorter is masked whole."""
    text = value.cast("string")
    n = F.length(text)
    kept = F.when(n > keep_last, F.lit(keep_last)).otherwise(F.lit(0))
    return F.concat(F.repeat(F.lit(mask), n - kept), F.when(kept > 0, F.right(text, kept)).otherwise(F.lit("")))


def hashed(value: Column, salt: str) -> Column:
    """SHA-256 of salt and value, in hex."""
    if not salt:
        raise ValidationError("hashing needs a salt")
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def redacted(value: Column, kind: T.DataType) -> Column:
    """``[REDACTED]`` for text and numbers, the empty value for binaries, lists and maps."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.StructType):
        return F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
    return F.lit("[REDACTED]")


def faked(value: Column, generator: str, seed: str = "0") -> Column:
    """A made-up value that depends on seed and value alone."""
    if generator not in GENERATORS:
        raise ValidationError(f"unknown generator {generator}")
    draw = lambda n, part: F.pmod(F.xxhash64(F.lit(seed), F.lit(part), value.cast("string")), F.lit(n)).cast("int")
    pick = lambda name, part: F.element_at(F.array(*(F.lit(x) for x in FAKES[name])), draw(len(FAKES[name]), part) + 1)
    if generator == "full_name":
        return F.concat(pick("first_name", "a"), F.lit(" "), pick("last_name", "b"))
    if generator == "email":
        return F.concat(F.lower(pick("first_name", "a")), F.lit("."), F.lower(pick("last_name", "b")), draw(100_000, "c").cast("string"), F.lit("@example.com"))
    if generator == "phone":
        return F.format_string("555-%03d-%04d", draw(1000, "a"), draw(10_000, "b"))
    if generator == "address":
        return F.concat((draw(998, "a") + 1).cast("string"), F.lit(" "), pick("last_name", "b"), F.lit(" Road"))
    return pick(generator, "a")


def apply_rules(df: DataFrame, rules: list[Rule], table: TableDef | None = None) -> tuple[DataFrame, list[str]]:
    """Rows after all rules, each seeing the effects of the ones before, and warnings about rules on key attributes.

    A rule whose path the table or the row doesn't have changes nothing. Masking, hashing and redacting turn other
    scalars into text, as they can't stay what they were.
    """
    warnings: list[str] = []
    for rule in rules:
        path = parse.projection(rule.path, parse.Scope(rule.names))[0]
        found = Typed(df.schema).resolve(path)
        if found is None:
            continue
        if table is not None and path.top in table.keys:
            warnings.append(f"rule on key attribute {path.top}")
        value, kind = found
        applies = value.isNotNull()
        if rule.match:
            applies = applies & Compiler(Typed(df.schema)).value(parse.condition(rule.match, parse.Scope(rule.names, rule.values)))
        new = _replacement(rule, value, kind)
        df = df.withColumn(path.top, _put(df, path, F.when(applies, new).otherwise(value.cast("string") if _becomes_text(rule, kind) else value)))
    return df, warnings


def _becomes_text(rule: Rule, kind: T.DataType) -> bool:
    scalar = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    return scalar and rule.action in ("mask", "hash", "redact") and not isinstance(kind, T.StringType)


def _replacement(rule: Rule, value: Column, kind: T.DataType) -> Column:
    if rule.action == "mask":
        return masked(value, rule.keep_last, rule.mask)
    if rule.action == "hash":
        return hashed(value, rule.salt or "")
    if rule.action == "redact":
        return redacted(value, kind)
    if rule.action == "null":
        return F.lit(None).cast(kind)
    if rule.action == "fake":
        made = faked(value, rule.generator or "word", rule.seed)
        if isinstance(kind, T.NumericType):
            return F.pmod(F.xxhash64(F.lit(rule.seed), value), F.lit(1_000_000)).cast(kind)
        return made
    raise ValidationError(f"unknown action {rule.action}")


def _put(df: DataFrame, path: Path, value: Column) -> Column:
    if len(path.parts) == 1:
        return value
    if not all(isinstance(p, str) for p in path.parts):
        raise ValidationError("rules reach into maps, not into lists")
    return F.col(f"`{path.top}`").withField(".".join(f"`{p}`" for p in path.parts[1:]), value)
