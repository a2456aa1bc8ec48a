"""Mixing sources to target weights.

The words of each source form one stream, cut into blocks of BLOCK words. Every output shard has a fixed number of
slots; how many of them a source gets is a multinomial draw, conditioned on the source's total (a multivariate
hypergeometric draw, made by splitting the shards in halves), so that over all shards a source is taken exactly as
often as its target says. A half is drawn by binomials and then corrected to its size by a uniform draw of the
difference, which is exact for populations of any size. A source's slots run through its blocks in pseudorandom order, a new permutation for every
round, and blocks are joined to the slots by index. A block is thus taken at most ceil(slots / blocks) times.

Draws and permutations depend on the seed and the numbers of blocks alone: reruns agree, and a lost task is redrawn
alike. Word offsets come from sums over chunks of a source, over groups of chunks, and inside a chunk, so a source that
holds a third of all rows is no single task. What is collected is the recipe: one row of five numbers a source, for
which SOURCES is the bound; a table of more sources is refused before anything is collected.

Defined results: null and empty texts have size 0 and nothing is taken from them; null is a source like any other,
last in order; texts of any length are counted whole; rows that repeat an id are documents of their own, equal rows take the
same words or an equal number; an empty table gives no rows. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.llm.common import cut, cut_few, small

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64
SLOTS = 4096
CHUNK_ROWS = 512
#: Chunks whose sums are added up together.
CHUNKS = 1024
#: Sources that a recipe may name.
SOURCES = 1_000_000
#: Draws of at most so many items are made one by one.
FEW = 64


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, no, source_size, target) of sized (source, size): one row a source.

    Sources in code point order, null last, weigh as listed, repeating; a target is at most `most` times its source,
    and what is above is reshared by weight. This is water-filling: below some level each target is weight x level.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    named = sums.withColumn("no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("no") % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(most))
    full = every.orderBy(F.col("cap") / F.col("w"), "no")
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing))
    # The level if this source is the first that its cap does not hold back; the true level is the greatest of them.
    level = (F.sum("source_size").over(every) - before) / rest
    named = named.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return named.select("source", "no", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at the given indexes: a four-round Feistel network, walked into range."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = (right + np.uint64((key * 4 + r) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(bits)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def drawn(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among `take` items drawn without replacement: a uniform subset of that size, exactly.

    Items that enter by independent coins of one probability are, given their number, a uniform subset of that number.
    What the coins bring too many is drawn out of it again, what they bring too few out of the rest; that difference is
    about the square root of the draw, so a few turns lead to a draw of a handful.
    """
    total = int(counts.sum())
    if 2 * take > total:
        return counts - drawn(counts, total - take, rng)
    if take <= FEW:
        ends, out = np.cumsum(counts), np.zeros_like(counts)
        # Different places among all items, drawn again on a repeat.
        places: set[int] = set()
        while len(places) < take:
            places.add(int(rng.integers(total)))
        np.add.at(out, np.searchsorted(ends, np.array(sorted(places), np.int64), side="right"), 1)
        return out
    got = rng.binomial(counts, take / total)
    over = int(got.sum()) - take
    if over > 0:
        return got - drawn(got, over, rng)
    return got + drawn(counts - got, -over, rng) if over else got


@dataclass(frozen=True)
class Recipe:
    """Blocks and slots of each source, by number."""

    blocks: tuple[int, ...]
    slots: tuple[int, ...]
    seed: int = 42

    @property
    def shards(self) -> int:
        return -(-sum(self.slots) // SLOTS)

    def draw(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(source counts of a shard, slots that each source has in the shards before it)."""
        lo, hi = 0, self.shards
        counts = np.array(self.slots, dtype=np.int64)
        before = np.zeros_like(counts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = drawn(counts, (mid - lo) * SLOTS, np.random.default_rng([self.seed, lo, hi]))
            if shard < mid:
                counts, hi = left, mid
            else:
                counts, before, lo = counts - left, before + left, mid
        return counts, before

    def sequence(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(source number, block) of each slot of a shard."""
        counts, before = self.draw(shard)
        no = np.repeat(np.arange(len(counts)), counts)
        block = np.zeros(len(no), np.int64)
        for s in np.flatnonzero(counts):
            n = self.blocks[s]
            at = np.arange(before[s], before[s] + counts[s])
            for turn in range(int(at[0] // n), int(at[-1] // n) + 1):
                own = at // n == turn
                block[np.flatnonzero(no == s)[own]] = permuted(at[own] % n, n, (self.seed << 40) + (int(s) << 8) + turn)
        order = np.random.default_rng([self.seed, shard, 1, 1]).permutation(len(no))
        return no[order], block[order]


@dataclass(frozen=True)
class Mix:
    """sized: (id, no, size, at, source_size, target), at being the first word's place in the source's stream;
    pieces: (no, block, at, start, words), the parts of blocks that a document holds; slots: (shard, slot, no, block)."""

    sized: DataFrame
    pieces: DataFrame
    slots: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 42) -> Mix:
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    if (many := sized.select("source").distinct().limit(SOURCES + 1).count()) > SOURCES:
        raise ValueError(f"a recipe names at most {SOURCES} sources, here are {many} or more")
    plan = cut_few(targets(sized, weights, most))
    rows = plan.orderBy("no").collect()
    blocks = tuple(-(-r["source_size"] // block) for r in rows)
    # As many slots as bring the target with blocks of the source's mean length.
    slots = tuple(min(most * n, round(r["target"] * n / r["source_size"])) if n else 0 for n, r in zip(blocks, rows, strict=True))
    recipe = Recipe(blocks, slots, seed)

    chunks = max(1, -(-sized.count() // CHUNK_ROWS))
    named = sized.join(small(plan), sized["source"].eqNullSafe(plan["source"])).select("id", "no", "size", "source_size", "target", F.pmod(F.xxhash64("id", "size"), F.lit(chunks)).alias("chunk"))
    # Offsets of chunks: of their group in the source, and in their group.
    ahead = lambda by, at: W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    own = cut(named.groupBy("no", "chunk").agg(F.sum("size").alias("own")).withColumn("group", F.floor(F.col("chunk") / CHUNKS)))
    groups = own.groupBy("no", "group").agg(F.sum("own").alias("own")).select("no", "group", F.coalesce(F.sum("own").over(ahead(["no"], "group")), F.lit(0)).alias("far"))
    sums = own.withColumn("near", F.coalesce(F.sum("own").over(ahead(["no", "group"], "chunk")), F.lit(0))).join(groups, ["no", "group"]).select("no", "chunk", (F.col("far") + F.col("near")).alias("base"))
    inside = W.partitionBy("no", "chunk").orderBy("id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = named.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["no", "chunk"])
    placed = cut(placed.select("id", "no", "size", (F.col("base") + F.col("inner")).alias("at"), "source_size", "target"))

    end = F.col("at") + F.col("size")
    pieces = placed.where("size > 0").select("no", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("block"))
    low, high = F.greatest("at", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = pieces.select("no", "block", "at", (low - F.col("at")).alias("start"), (high - low).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                no, own = recipe.sequence(shard)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), shard)), pa.array(np.arange(len(no))), pa.array(no.astype(np.int32)), pa.array(own)], ["shard", "slot", "no", "block"])

    shards = spark.range(0, recipe.shards, 1, max(1, min(recipe.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return Mix(placed, pieces, shards.mapInArrow(run, "shard long, slot long, no int, block long"))


def taken(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    # The planner sees the few shard numbers that the slots come from and would broadcast them: they grow with the data.
    times = mixed.slots.groupBy("no", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    words = mixed.pieces.join(times, ["no", "block"]).groupBy("no", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Among documents that share a place all but the last are empty.
    out = mixed.sized.join(words, ["no", "at"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_texts(mixed: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, text): the words of every slot's block, joined by one space. Ids must be unique."""
    refs = mixed.slots.hint("merge").join(mixed.pieces, ["no", "block"]).join(mixed.sized.where("size > 0").select("no", "at", "id"), ["no", "at"])
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    parts = refs.join(docs.select(F.col(id_col).alias("id"), words.alias("w")), "id").select("shard", "slot", "at", F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("at", "part")))
    return parts.groupBy("shard", "slot").agg(F.array_join(F.transform(whole, lambda p: p["part"]), " ").alias("text"))
