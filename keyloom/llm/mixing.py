"""Mix the documents of several sources to target weights, exactly and without a global shuffle.

Every source's documents fall into blocks of about equal tokens by hash. Quotas are whole blocks (and one block cut at a
document), copies of a source drawn one after the other in permuted order. A splitting tree deals the drawn
blocks to output shards: at each node the blocks of each source that go left are one draw of a multivariate
hypergeometric distribution, seeded by the node, so the deal is what a shuffle of all blocks would give, yet any
task finds a block's shard alone by walking down the tree. Within a shard, documents are ordered by a keyed hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.tokens import TOKENIZERS, count_tokens
from keyloom.session import materialize

#: Tokens a shard should hold; decides the number of shards where none is given.
SHARD_TOKENS = 1 << 24
#: Blocks a shard should be dealt.
SHARD_BLOCKS = 32
#: Shards at least, and at most.
SHARDS = (16, 1 << 14)


def source_key(source: Column) -> Column:
    """A source's name without regard to case and surrounding blanks; null and blank ones are null."""
    return F.nullif(F.lower(F.btrim(source, F.lit(" \t\r\n\f\v"))), F.lit(""))


def deal(counts: tuple[int, ...], shards: int, seed: int, source: int, ranks: np.ndarray) -> np.ndarray:
    """The shard of the blocks of one source with these ranks; ``counts`` are the drawn blocks of every source."""

    @lru_cache(maxsize=None)
    def left_of(node: int, here: tuple[int, ...], n: int) -> tuple[int, ...]:
        take = sum(here) * (n // 2) // n
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        return tuple(rng.multivariate_hypergeometric(here, take).tolist())

    out = np.empty(len(ranks), dtype=np.int64)
    todo = [(1, counts, 0, shards, 0, np.arange(len(ranks)))]
    while todo:
        node, here, first, n, base, members = todo.pop()
        if not len(members):
            continue
        if n == 1:
            out[members] = first
            continue
        left = left_of(node, here, n)
        goes = ranks[members] - base < left[source]
        todo.append((2 * node, left, first, n // 2, base, members[goes]))
        right = tuple(h - x for h, x in zip(here, left))
        todo.append((2 * node + 1, right, first + n // 2, n - n // 2, base + left[source], members[~goes]))
    return out


def _deal_batches(names: list[str], counts: tuple[int, ...], shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = np.array(batch.column("source").to_pylist(), dtype=object)
            ranks = batch.column("rank").to_numpy()
            shard = np.zeros(len(ranks), dtype=np.int64)
            for k, name in enumerate(names):
                own = np.flatnonzero(sources == name)
                shard[own] = deal(counts, shards, seed, k, ranks[own])
            columns = {c: batch.column(c) for c in ("source", "block", "copy", "room")}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(shard.astype(np.int32))], names=[*columns, "shard"])

    return run


def quotas(wanted: list[tuple[str, float, int]], sizes: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source. ``wanted``: source, weight, how often it may be used in all.

    Weights count relative to their sum over sources that have documents, a positive weight and at least one allowed use. Without ``total``, the
    largest total at which every source has its exact share; with it, sources that can't give their share give
    all they may, and the rest is shared by the others in proportion, as far as they reach.
    """
    usable = {s: (w, r * sizes[s]) for s, w, r in wanted if w > 0 and r > 0 and sizes.get(s, 0) > 0}
    if not usable:
        return {}
    everything = sum(w for w, _ in usable.values())
    if total is None:
        scale = min(cap / w for w, cap in usable.values())
        return {s: min(cap, int(w * scale)) for s, (w, cap) in usable.items()}
    out: dict[str, int] = {}
    left, open_ = total, dict(usable)
    while open_ and left > 0:
        everything = sum(w for w, _ in open_.values())
        full = {s: cap for s, (w, cap) in open_.items() if cap * everything <= left * w}
        if not full:
            return out | {s: int(left * w / everything) for s, (w, _) in open_.items()}
        out |= full
        left -= sum(full.values())
        open_ = {s: x for s, x in open_.items() if s not in full}
    return out


class Mixture:
    """A mixture of ``docs`` by ``targets``: ``rows()`` are the drawn documents, ``shares()`` what was reached.

    ``docs``: ``doc_id, source, text``; ``targets``: ``source, target_weight, max_repeats`` (a small table; several
    rows of one source add their weights and keep the largest repeat). Sizes are tokens of a public tokenizer. Documents
    without tokens, without a source or of sources without a target are not drawn; null weights read as 0, null repeats as 1.
    A document is drawn at most ``max_repeats`` times. Each source gets within one document of its quota, never more.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", root: str = TOKENIZERS, total: int | None = None, shards: int | None = None, seed: int = 17) -> None:
        keyed = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text", F.xxhash64("doc_id", "text").alias("h"))
        #: one pass over the texts; all that follows reads sizes only
        self.sized = materialize(count_tokens(keyed, tokenizer, root, ("doc_id", "source", "h")), "mix-sizes")
        self.sizes = self.sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        self.targets = (
            targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
            .where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("repeats").alias("repeats"))
        )
        # one row per target: as small as the table of wanted weights
        known = self.targets.join(self.sizes, "source", "left").orderBy("source").collect()
        sizes = {r.source: r.tokens or 0 for r in known}
        self.quota = {s: q for s, q in quotas([(r.source, r.weight, r.repeats) for r in known], sizes, total).items() if q > 0}
        drawn = sum(self.quota.values())
        self.shards = shards or min(SHARDS[1], max(SHARDS[0], -(-drawn // SHARD_TOKENS)))
        block = max(1, drawn // (self.shards * SHARD_BLOCKS))
        self.plan = [(s, max(1, sizes[s] // block), q // sizes[s], q % sizes[s]) for s, q in sorted(self.quota.items())]
        self.seed = seed
        self.wanted = {r.source: r.weight for r in known}

    def _blocks(self) -> DataFrame:
        spark = self.sized.sparkSession
        plan = spark.createDataFrame(self.plan, "source string, n_blocks bigint, whole int, rest bigint")
        return self.sized.where("n_tokens > 0").join(plan, "source").withColumn("block", F.pmod(F.xxhash64("h", F.lit(self.seed)), F.col("n_blocks")).cast("int"))

    def _draws(self, blocks: DataFrame) -> DataFrame:
        """One row per drawn block and copy: ``room`` is null for a whole block, else the tokens still wanted of it."""
        sized = blocks.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("tokens"))
        copies = sized.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        order = Window.partitionBy("source", "copy").orderBy(F.xxhash64(F.lit(self.seed), "copy", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("tokens").over(order), F.lit(0))
        room = F.col("rest") - F.col("before")
        cut = (F.col("copy") == F.col("whole")) & (F.col("tokens") > room)
        drawn = copies.withColumn("before", before).where((F.col("copy") < F.col("whole")) | (room > 0)).withColumn("room", F.when(cut, room))
        rank = Window.partitionBy("source").orderBy("copy", F.xxhash64(F.lit(self.seed), "copy", "block"), "block")
        return drawn.select("source", "block", "copy", "room", (F.row_number().over(rank) - 1).cast("bigint").alias("rank"))

    def rows(self) -> DataFrame:
        """``shard, position, source, doc_id, copy, n_tokens``: the mixture in training order."""
        blocks = self._blocks()
        draws = materialize(self._draws(blocks), "mix-draws")
        counts = {r.source: r.n for r in draws.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per target
        names = sorted(counts)
        dealt = draws.mapInArrow(
            _deal_batches(names, tuple(counts[n] for n in names), self.shards, self.seed), "source string, block int, copy int, room bigint, shard int"
        )
        met = blocks.select("source", "block", "doc_id", "h", "n_tokens").join(dealt, ["source", "block"])
        whole = met.where("room is null").drop("room")
        # the last block of a source is cut where its quota is reached; such blocks are few and small
        inside = Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64("h", F.lit(self.seed + 1)), "doc_id", "n_tokens")
        part = met.where("room is not null").withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= room").drop("room", "upto")
        place = Window.partitionBy("shard").orderBy(F.xxhash64("h", "copy", F.lit(self.seed + 2)), "doc_id", "copy")
        return whole.unionByName(part).select("shard", F.row_number().over(place).alias("position"), "source", "doc_id", "copy", "n_tokens")

    def shares(self) -> DataFrame:
        """Per source of the corpus or the targets: its size, wanted share, quota, what was drawn, and the share reached."""
        spark = self.sized.sparkSession
        everything = sum(self.wanted[s] for s in self.quota)
        goal = spark.createDataFrame(
            [(s, float(w), float(w) / everything if s in self.quota else 0.0, self.quota.get(s, 0)) for s, w in self.wanted.items()],
            "source string, weight double, target_share double, quota_tokens bigint",
        )
        drawn = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_docs"), (F.max("copy") + 1).alias("most_repeats"))
        drawn = materialize(drawn, "mix-shares")
        total = drawn.agg(F.sum("drawn_tokens").alias("t")).select("t").scalar()
        zero = lambda name: F.coalesce(name, F.lit(0))
        return goal.join(self.sizes, "source", "full").join(drawn, "source", "left").select(
            "source", zero("tokens").alias("source_tokens"), zero("docs").alias("source_docs"), zero("weight").cast("double").alias("weight"),
            zero("target_share").cast("double").alias("target_share"), zero("quota_tokens").alias("quota_tokens"), zero("drawn_tokens").alias("drawn_tokens"),
            zero("drawn_docs").alias("drawn_docs"), zero("most_repeats").alias("most_repeats"),
            F.coalesce(F.col("drawn_tokens") / total, F.lit(0.0)).alias("actual_share"),
        )
