"""References to records that do not exist, found with bitmaps per key range and period.

References and parents are folded to one row per key in a single shuffle: the months a key is referenced in, the
moment its parent arrives, whether it has one at all. The rows of a shuffle partition are numbered, which
makes the row's place its dictionary code; the codes of one Arrow batch (10,000 rows unless the
session says otherwise, cut beyond 65,536) are a key range. Per range and month a compressed
bitmap (sorted codes while sparse, packed bits otherwise) holds the referenced keys, another the keys whose parent was
there before the month began; reference AND-NOT parent leaves the suspects, whose bits are decoded to keys where the
dictionary still is in memory. Only suspects meet the references again, where the exact moments decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of one range at most, so that codes fit 16 bits; a range ends with its Arrow batch, so it mostly has fewer.
RANGE = 1 << 16
#: A set of more codes than this is smaller as packed bits.
SPARSE = 1 << 12
#: Month given to references without a time; earlier than any real one, so that their keys are always looked at.
NO_MONTH = -(1 << 30)

_KEY = ["table_name", "pk", "sk"]


class CodeSet:
    """A set of 16-bit codes, as sorted codes or as packed bits, whichever is smaller."""

    __slots__ = ("codes", "bits")

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = self.bits = None
        if len(codes) <= SPARSE:
            self.codes = np.unique(codes.astype(np.uint16))
        else:
            flags = np.zeros(RANGE, dtype=bool)
            flags[codes] = True
            self.bits = np.packbits(flags)

    def _packed(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(RANGE, dtype=bool)
        flags[self.codes] = True
        return np.packbits(flags)

    def and_not(self, other: CodeSet) -> np.ndarray:
        """The codes that are here and not in ``other``, in order."""
        if self.codes is not None and other.codes is not None:
            return np.setdiff1d(self.codes, other.codes, assume_unique=True)
        if self.codes is not None:
            held = (other.bits[self.codes >> 3] >> (7 - (self.codes & 7)).astype(np.uint8)) & 1
            return self.codes[held == 0]
        return np.flatnonzero(np.unpackbits(self.bits & ~other._packed()))


def suspects(months: pa.ListArray, arrived: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and months of one key range whose parent wasn't there when the month began.

    ``months``: per code the months it is referenced in; ``arrived``: per code the month its parent arrives in, the
    largest integer if never, ``NO_MONTH - 1`` if it always was there.
    """
    refs = np.repeat(np.arange(len(months)), np.asarray(months.value_lengths().fill_null(0)))
    periods = np.asarray(months.flatten())
    codes_out, months_out = [], []
    for month in np.unique(periods):
        left = CodeSet(refs[periods == month]).and_not(CodeSet(np.flatnonzero(arrived < month)))
        codes_out.append(left)
        months_out.append(np.full(len(left), month))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(codes_out), join(months_out)


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    never = np.iinfo(np.int64).max
    for batch in batches:
        for start in range(0, batch.num_rows, RANGE):
            part = batch.slice(start, RANGE)
            present = np.asarray(part.column("present").fill_null(False).to_numpy(zero_copy_only=False))
            arrival_month = np.asarray(part.column("arrival_month").fill_null(NO_MONTH - 1).to_numpy(zero_copy_only=False)).astype(np.int64)
            codes, months = suspects(part.column("months"), np.where(present, arrival_month, never))
            take = pa.array(codes.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(k).take(take) for k in _KEY]
                + [pa.array(months.astype(np.int32)), part.column("arrival").take(take), part.column("present").take(take)],
                names=[*_KEY, "month", "arrival", "present"],
            )


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column with or without a zone (without: UTC)."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def month_of(us: Column) -> Column:
    """Months since January of year 0 of microseconds since the epoch (UTC)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent doesn't exist or arrives only later, with the reason in ``kind`` (absent, late).

    ``references``: ``entry_id``, ``table_name``, ``pk``, ``sk``, ``at`` (microseconds). ``parents``: ``table_name``,
    ``pk``, ``sk``, ``arrival`` (microseconds, null if unknown), ``present`` (whether this row vouches for the parent);
    any number of rows a key. A reference with a null table or pk refers to nothing and is never an orphan, a null sk reads as
    ''. A reference without a time is an orphan only if its parent is absent; a present parent without a known
    arrival always was there. Equal moments are in time. References repeated under other ids are all returned.
    """
    refs = references.where(F.col("table_name").isNotNull() & F.col("pk").isNotNull()).select(
        "entry_id", "table_name", "pk", F.coalesce("sk", F.lit("")).alias("sk"), "at", F.coalesce(month_of(F.col("at")), F.lit(NO_MONTH)).alias("month")
    )
    none = lambda kind: F.lit(None).cast(kind)
    both = refs.select(*_KEY, "month", none("bigint").alias("arrival"), F.lit(False).alias("present")).unionByName(
        parents.where(F.col("table_name").isNotNull() & F.col("pk").isNotNull()).select(
            "table_name", "pk", F.coalesce("sk", F.lit("")).alias("sk"), none("int").alias("month"), "arrival", "present"
        )
    )
    dictionary = (
        both.groupBy(*_KEY)
        .agg(F.collect_set("month").alias("months"), F.min("arrival").alias("arrival"), F.max("present").alias("present"))
        .where(F.size("months") > 0)
        .withColumn("arrival_month", month_of(F.col("arrival")))
    )
    left = dictionary.mapInArrow(_surviving, "table_name string, pk string, sk string, month int, arrival bigint, present boolean")
    return (
        refs.join(left, [*_KEY, "month"])
        .where(~F.col("present") | (F.col("arrival") > F.col("at")))
        .select("entry_id", *_KEY, "at", "month", F.when(F.col("present"), "late").otherwise("absent").alias("kind"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month (``yyyy-MM``, null without a time) and kind."""
    month = F.when(F.col("month") != NO_MONTH, F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), F.pmod("month", F.lit(12)) + 1))
    return orphans.groupBy("table_name", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_entries"))
