"""Mixing sources to target weights by packed blocks, drawn counts and index permutations.

* A source's documents are laid end to end and cut into blocks of `block_words` words, so a
  block is found by its number; only the last block of a source is shorter.
* Sources' targets become whole numbers of slots. A shard of the output has a fixed number
  of slots; how many go to each source is a multinomial draw, taken under the condition
  that all shards together use up each source's slots. Such draws split along a tree over
  the shards, so every shard finds its own counts, and how many slots of each source lie
  before it, from the seed alone.
* Slot k of a source stands for block permuted(k mod blocks) in epoch k div blocks, by a
  keyed permutation of the block numbers (a Feistel network that walks until it is in
  range). So no block is taken more than one time more than another, and none over `most`.
* Slots and blocks are joined by source and block number; both sides have few rows a key.

What goes to the driver is a row per source (its size and target), held to `MOST_SOURCES`.
Results depend on the rows and the seed only, not on partitions or the order of files.

Defined results: every row is a document, repeated or not; a null or empty text has size 0
and is never taken; a null source is a source of its own and comes last; an empty table, or
one without words, has targets of 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.common import doc_key, mix, stage_table

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, over and over.
WEIGHTS = (5, 2, 1)
#: Times that a block, and so a document, may be taken.
MOST = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
SEED = 12
#: A row per source goes to the driver and to every task (24 bytes each); a mix of more sources is refused.
MOST_SOURCES = 1 << 20
#: Documents of a source between two sums of sizes, about.
BUCKET_ROWS = 512
#: numpy draws from urns of up to this many slots; a larger part of the tree is split in proportion.
URN = 10**9


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Each source's words in the mix: shares of all sizes by weight, at most `most` times its size.

    What goes over a source's limit is shared by the others in their weights until none is
    over: every target is the smaller of its limit and one common level times its weight.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), sum(sizes)
    while open_:
        weight = sum(w[i] for i in open_)
        full = [i for i in open_ if left * w[i] > most * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = left * w[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


@dataclass
class Plan:
    """Sources in order: name, words, target, number of blocks and of slots."""

    names: list
    sizes: list[int]
    targets: list[float]
    blocks: np.ndarray
    slots: np.ndarray
    block_words: int
    shard_slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-int(self.slots.sum()) // self.shard_slots)


def plan(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Plan:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)  # Python orders text by code point
    n = [sizes[s] for s in names]
    t = targets(n, weights, most)
    blocks = [-(-x // block_words) for x in n]
    slots = [min(most * b, round(b * y / x)) if x else 0 for b, x, y in zip(blocks, n, t)]
    return Plan(names, n, t, np.array(blocks, np.int64), np.array(slots, np.int64), block_words, shard_slots, seed)


def draw(quotas: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of n slots go to each source, of all that are left of them."""
    total = int(quotas.sum())
    if total < URN:
        return np.random.default_rng(key).multivariate_hypergeometric(quotas, n, method="marginals")
    exact = [int(q) * n for q in quotas]
    out = np.array([e // total for e in exact], np.int64)
    rest = sorted(range(len(exact)), key=lambda i: (-(exact[i] % total), i))[: n - int(out.sum())]
    out[rest] += 1
    return out


def shard_counts(p: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it."""
    low, high, quotas, before = 0, p.shards, p.slots.copy(), np.zeros(len(p.slots), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(quotas, (mid - low) * p.shard_slots, (p.seed, low, high))
        if shard < mid:
            quotas, high = left, mid
        else:
            quotas, before, low = quotas - left, before + left, mid
    return quotas, before


def permuted(at: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A one-to-one map of 0..n-1 for each key: four Feistel rounds over the next power of 4, repeated until in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, key = at.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right, k = x[todo] >> half, x[todo] & low, key[todo]
        for r in range(4):
            left, right = right, left ^ (mix(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1342543DE82EF95 * (r + 1) & (1 << 64) - 1)) & low)
        x[todo] = left << half | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def shard_slots(p: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Source and block of every slot of a shard, in the order of the output."""
    counts, before = shard_counts(p, shard)
    source, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(counts):
        k, n = before[i] + np.arange(counts[i]), int(p.blocks[i])
        with np.errstate(over="ignore"):
            key = mix((k // n).astype(np.uint64) + np.uint64((p.seed * 0x9E3779B97F4A7C15 + int(i) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1))
            block.append(permuted(k % n, n, key))
        source.append(np.full(counts[i], i))
    source, block = np.concatenate(source), np.concatenate(block)
    order = np.random.default_rng((p.seed, shard, 1)).permutation(len(source))
    return source[order], block[order]


def slots(spark: SparkSession, p: Plan) -> DataFrame:
    """shard, slot, at (the source's place in the order) and block of the whole mix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                source, block = shard_slots(p, shard)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(source), shard), "slot": np.arange(len(source)), "at": source, "block": block})

    return spark.range(p.shards).mapInArrow(run, "shard long, slot long, at long, block long")


def packed(docs: DataFrame, **how) -> tuple[DataFrame, Plan]:
    """Documents with their place in their source, and the plan of the mix.

    Columns: at (the source), doc_id, doc_key, size, copies (equal rows, one after the
    other) and start (words of the source before the first copy). The order of a source's
    documents is by hash; sizes are summed up by ranges of the hash, so no task sees a
    whole source.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")
    rows = stage_table(docs.select("source", "doc_id", doc_key().alias("doc_key"), size.alias("size")).groupBy("source", "doc_id", "doc_key", "size").agg(F.count("*").alias("copies")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
    found = by_source.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    p = plan({r["source"]: r["size"] for r in found}, **how)
    names = spark.createDataFrame([(x, i) for i, x in enumerate(p.names)], "source string, at long")
    bits = max(0, (max([r["rows"] for r in found], default=1) // BUCKET_ROWS).bit_length())
    placed = rows.join(F.broadcast(names.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    placed = placed.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "doc_key"), 1)).withColumn("bucket", F.shiftright("h", 63 - bits))
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("at", "bucket").agg(F.sum(words).alias("w"))
    earlier = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("at", "bucket", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("at", "bucket").orderBy("h", "doc_id", "doc_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(sums, ["at", "bucket"]).withColumn("start", F.col("before") + F.sum(words).over(own) - words).select("at", "doc_id", "doc_key", "size", "copies", "start"), p


def copies_of(placed: DataFrame) -> DataFrame:
    """A row for every copy, with a start of its own."""
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies", "copy")


def segments(rows: DataFrame, block_words: int) -> DataFrame:
    """rows (start, size) once for every block that they reach into, with `block` and the words there."""
    end = F.col("start") + F.col("size")
    each = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    return each.withColumn("words", F.least(end, (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words))


def mixed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: shard, slot, source, block and the block's text (words joined by one space)."""
    placed, p = packed(docs, **how)
    texts = docs.select("source", "doc_id", "text", doc_key().alias("doc_key")).groupBy("source", "doc_id", "doc_key").agg(F.first("text").alias("text"))
    names = F.broadcast(docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(p.names)], "source string, at long"))
    named = texts.join(names.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    same = [named[c].eqNullSafe(placed[c]) for c in ("at", "doc_id", "doc_key")]
    rows = placed.join(named.select("at", "doc_id", "doc_key", "text"), same).select(placed.at, placed.size, placed.copies, placed.start, "text")
    rows = copies_of(rows.where("size > 0")).withColumn("ws", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    first, last = F.floor(F.col("start") / p.block_words), F.floor((F.col("start") + F.col("size") - 1) / p.block_words)

    def piece(block):
        begin = F.greatest(F.col("start"), block * p.block_words)
        n = F.least(F.col("start") + F.col("size"), (block + 1) * p.block_words) - begin
        return F.struct(block.alias("block"), begin.alias("begin"), F.array_join(F.slice("ws", (begin - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("piece"))

    pieces = rows.select("at", F.explode(F.transform(F.sequence(first, last), piece)).alias("x")).select("at", "x.*")
    whole = pieces.groupBy("at", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return slots(docs.sparkSession, p).hint("merge").join(whole, ["at", "block"]).join(names, "at").select("shard", "slot", "source", "block", "text")


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns: each document's size, its source's size and target, and how many of its words the mix takes."""
    placed, p = packed(docs, **how)
    rows = copies_of(placed)
    times = slots(docs.sparkSession, p).groupBy("at", "block").agg(F.count("*").alias("times"))
    # Slots grow with the table, but Spark takes them for as many as shards: without the hint it would broadcast them.
    held = segments(rows, p.block_words).select("at", "doc_id", "size", "start", "block", "words").join(times.hint("merge"), ["at", "block"], "left")
    taken = held.groupBy("at", "doc_id", "size", "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    every = taken.select("at", "doc_id", "size", "taken").unionByName(rows.where("size = 0").select("at", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    told = F.broadcast(docs.sparkSession.createDataFrame([(i, x, float(t)) for i, (x, t) in enumerate(zip(p.sizes, p.targets))], "at long, source_size long, target double"))
    return every.join(told, "at").select("doc_id", "size", "source_size", "target", "taken")
