"""Per-key totals that stay balanced when a few keys hold most records.

Every key state here is algebraic (a sum, a count, a minimum, a maximum), so each input partition folds its
rows into a bounded hash table of key states (Spark's partial HashAggregate, which spills to a sort when the
table outgrows its memory) and only one compact state per key and partition is shuffled. A key with a third of
all rows therefore reaches the reducer as at most one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_by_key(df: DataFrame, keys: list[str], **states: Column) -> DataFrame:
    """Fold rows into one row per key; ``states`` are mergeable aggregates named by keyword.

    Null keys form a group of their own; an empty input gives an empty result; columns other than ``keys`` and
    those the states read are pruned from the scan, so extra columns with clashing names do no harm.
    """
    return df.groupBy(*keys).agg(*(state.alias(name) for name, state in states.items()))


def key_totals(items: DataFrame, keys: tuple[str, ...] = ("table_name", "pk"), size: str = "item_size") -> DataFrame:
    """``keys``, ``n_rows`` and ``n_bytes`` (null sizes count 0) for every key, the null key included."""
    return combine_by_key(
        items, list(keys), n_rows=F.count(F.lit(1)), n_bytes=F.sum(F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    )


def heavy_keys(
    items: DataFrame,
    keys: tuple[str, ...] = ("table_name", "pk"),
    size: str = "item_size",
    percent: int = 1,
) -> DataFrame:
    """The keys with at least ``percent`` of all rows or of all bytes, with their totals.

    All stored rows count towards the totals, repeated ones and those without a key included. A key whose last
    part is null or empty is never reported. When every size is 0 or null, bytes make no key heavy.
    """
    totals = key_totals(items, keys, size)
    everything = totals.agg(F.struct(F.sum("n_rows").alias("rows"), F.sum("n_bytes").alias("bytes")).alias("all")).scalar()
    name = F.col(keys[-1])
    heavy = (F.col("n_rows") * 100 >= everything["rows"] * percent) | ((everything["bytes"] > 0) & (F.col("n_bytes") * 100 >= everything["bytes"] * percent))
    # one condition on keys and states together: were the key's part pushed to the scan, its exchange could not serve the totals too
    return totals.where(F.when(name.isNotNull() & (name.cast("string") != ""), heavy).otherwise(F.lit(False)))


def key_load(items: DataFrame, keys: tuple[str, ...] = ("table_name", "pk"), tasks: int = 64) -> DataFrame:
    """How evenly the work falls on ``tasks`` reducers: rows each would get unfolded, and states it gets folded.

    ``task``, ``raw_rows`` (what a plain shuffle by key would send it) and ``states`` (keys it merges).
    """
    totals = key_totals(items, keys)
    return (
        totals.withColumn("task", F.pmod(F.hash(*(F.col(k) for k in keys)), F.lit(tasks)))
        .groupBy("task")
        .agg(F.sum("n_rows").alias("raw_rows"), F.count(F.lit(1)).alias("states"))
    )
