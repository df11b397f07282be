"""Prefix trie of conversations by truncation peeling.

The work goes from the deepest turns to the root. At a depth, conversations that end
there are merged with what is left of longer ones; a merged group is a node and is
counted at once; its last turn is stripped, and the stripped rows are regrouped as the
depth above. No node is listed before it is reached and no prefix is expanded twice.

* A prefix is named by the first 128 bits of a SHA-256 chain over its turns. A row holds
  the names of one band of depths only (`BANDS`), so long conversations cost their length,
  not its square; between bands the names are fetched by the smallest member's id.
* Depths of the first band, and parts of a deeper band that start with a prefix of over
  `HOT` conversations, are peeled by exchanges with sums made before the shuffle, a job
  per depth. Everything deeper is peeled inside tasks, a job per band.
* Ids of conversations that end together are sorted in runs of bounded id ranges and
  hashed as a stream of runs, so equal conversations, however many, are never one list.

Defined results: rows without conv_id take no part; null role or text is empty; turns
that tie are ordered by role, then text, by code point; every row is a turn, repeated or
not. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.common import discard, shared_dir, stage_table

#: Depths of the first band, and of every band after it.
BANDS = (8, 32)
#: Prefixes at the start of a band with more conversations are peeled by exchange.
HOT = 20_000
#: Width of the ranges of ids that are joined to one string before they are hashed.
RUN = 4096
#: Bytes of a prefix's name.
NAME = 16
ROOT = b"\x00" * NAME
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

STATE = "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
NODE = f"name binary, parent binary, depth long, {STATE}"


def band_start(band: int) -> int:
    """Depth above the first one of a band."""
    return 0 if band == 0 else BANDS[0] + BANDS[1] * (band - 1)


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, in order), turn (a hash of role and text) and words of its text.

    Texts do not travel, but for turns that tie: these are ranked by role and text.
    """
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = plain.withColumn("turn", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    rows = stage_table(named.select("conv_id", "at", "turn", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "turns")
    tied = rows.groupBy("conv_id", "at").agg(F.min("turn").alias("low"), F.max("turn").alias("high")).where("low <> high")
    tied = stage_table(tied.select(F.col("conv_id").alias("c"), F.col("at").alias("a")), "tied")
    if tied.isEmpty():
        rows = rows.withColumn("rank", F.lit(0))
    else:
        among = named.join(tied, (F.col("conv_id") == F.col("c")) & F.col("at").eqNullSafe(F.col("a"))).select("c", "a", "role", "text", F.col("turn").alias("t")).distinct()
        ranked = among.select("c", "a", "t", F.row_number().over(Window.partitionBy("c", "a").orderBy("role", "text")).alias("rank"))
        rows = rows.join(ranked, (F.col("conv_id") == F.col("c")) & F.col("at").eqNullSafe(F.col("a")) & (F.col("turn") == F.col("t")), "left").drop("c", "a", "t")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "rank")
    return rows.withColumn("pos", F.row_number().over(order)).drop("at", "rank")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The contract's conversations: the first turns of a family's first one, then those of one's own.

    A family has at most `family` ids on either side of zero and shares fewer than `most`
    turns, so no key of the join grows with the table. Rows with pos 0 stand for
    conversations, also for those that are left without turns.
    """
    first = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    own = turns.withColumn("h", first)
    shared = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    convs = turns.where("pos = 1").select("conv_id", first.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lent = convs.join(shared, "base").where("pos <= h").select("conv_id", "pos", "turn", "words")
    marks = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return own.where("pos > h").select("conv_id", "pos", "turn", "words").unionByName(lent).unionByName(marks)


def as_written(turns: DataFrame) -> DataFrame:
    """Conversations as they are, for prefix_nodes."""
    marks = turns.where("pos = 1").select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return turns.select("conv_id", "pos", "turn", "words").unionByName(marks)


BAND_ROWS = "conv_id long, band int, start binary, names binary, words array<long>, ended boolean"


def banded(rows: DataFrame) -> DataFrame:
    """BAND_ROWS: for each conversation and band the names of its prefixes there, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("band", pa.int32()), ("start", pa.binary()), ("names", pa.binary()), ("words", pa.list_(pa.int64())), ("ended", pa.bool_())])
        conv = chain = None
        band, start, names, words = 0, ROOT, [], []
        for batch in batches:
            out = []
            for c, turn, n in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "words"))):
                if c != conv:
                    if conv is not None:
                        out.append((conv, band, start, b"".join(names), words, True))
                    conv, chain, band, start, names, words = c, hashlib.sha256(), 0, ROOT, [], []
                if turn is None:
                    continue
                if len(names) == BANDS[band > 0]:
                    out.append((conv, band, start, b"".join(names), words, False))
                    band, start, names, words = band + 1, names[-1], [], []
                chain.update(turn)
                names.append(chain.copy().digest()[:NAME])
                words.append(n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[conv], [band], [start], [b"".join(names)], [words], [True]], schema)], schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "turn", "words").mapInArrow(run, BAND_ROWS)


def last_name(names: Column, start: Column) -> Column:
    return F.when(F.length(names) > 0, F.substring(names, -NAME, NAME)).otherwise(start)


def endings(bands: DataFrame) -> DataFrame:
    """A row for each different whole conversation: band, start, names, words, and the state of those that end so.

    Ids are joined within ranges of RUN (each id is there once), and the joined runs of a
    conversation are hashed in order, as a stream.
    """
    ended = bands.where("ended").withColumn("name", last_name(F.col("names"), F.col("start")))
    runs = ended.groupBy("name", F.floor(F.col("conv_id") / RUN).alias("run")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        *[F.first(c).alias(c) for c in ("band", "start", "names", "words")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("band", pa.int32()), ("start", pa.binary()), ("names", pa.binary()), ("words", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.string())])
        name, held, sha = None, None, None
        done = lambda: (*held, sha.hexdigest())
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["name"] != name:
                    if held:
                        out.append(done())
                    name, sha, held = r["name"], hashlib.sha256(r["ids"].encode()), [r["band"], r["start"], r["names"], r["words"], r["conv_id"], r["n"]]
                else:
                    sha.update(b"," + r["ids"].encode())
                    held[4], held[5] = min(held[4], r["conv_id"]), held[5] + r["n"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), schema)], schema=schema)

    told = runs.repartition("name").sortWithinPartitions("name", "run").mapInArrow(run, "band int, start binary, names binary, words array<long>, conv_id long, n_convs long, ends string")
    return told.select("band", "start", "names", "words", "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], "ends")


def peeled_in_tasks(rows: DataFrame, top: int) -> DataFrame:
    """NODE rows of one band; those with depth `top` are the sums that go on to the band above."""

    def peel(start: bytes, group: list[dict]) -> list[tuple]:
        ending: dict[int, list] = {}
        for r in group:
            ending.setdefault(len(r["names"]) // NAME, []).append(r)
        out, survivors = [], {}

        def add(level: dict, names: bytes, words: list, conv: int, n: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
            s = level.get(names)
            if s is None:
                level[names] = [words, conv, n, children, leaves, saved, ends]
            else:
                s[1] = min(s[1], conv)
                s[2] += n
                s[3] += children
                s[4] += leaves
                s[5] += saved
                s[6] = s[6] or ends

        for depth in range(max(ending), 0, -1):
            for r in ending.get(depth, ()):
                add(survivors, r["names"], r["words"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"])
            above: dict = {}
            for names, (words, conv, n, children, leaves, saved, ends) in survivors.items():
                leaves, saved = leaves if children else 1, saved + (n - 1) * words[depth - 1]
                stripped = names[:-NAME]
                out.append((names[-NAME:], stripped[-NAME:] or start, top + depth, conv, n, children, leaves, saved, ends))
                add(above, stripped, words, conv, n, 1, leaves, saved, None)
            survivors = above
        for words, conv, n, children, leaves, saved, ends in survivors.values():
            out.append((start, None, top, conv, n, children, leaves, saved, ends))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), *[(c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.string())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        start, group = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["start"] != start:
                    if group:
                        out += peel(start, group)
                    start, group = r["start"], []
                group.append(r)
            if out:
                yield batch_of(out)
        if group:
            yield batch_of(peel(start, group))

    return rows.repartition("start").sortWithinPartitions("start").mapInArrow(run, NODE)


def peeled_by_exchange(rows: DataFrame, top: int) -> tuple[list[DataFrame], DataFrame | None]:
    """NODE tables of one band, depth by depth, and the rows that go on to the band above.

    rows is a written table, so each depth reads it again for those that enter there.
    """
    state = lambda names, words: [
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends")
    ]
    deepest = (rows.agg(F.max(F.length("names"))).first()[0] or 0) // NAME
    columns = ["start", "names", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes, survivors = [], None
    for depth in range(deepest, 0, -1):
        entering = rows.where(F.length("names") == depth * NAME).select(columns)
        level = (entering if survivors is None else survivors.unionByName(entering)).groupBy("start", "names", "words").agg(*state("names", "words"))
        level = level.withColumns({
            "n_leaves": F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("words", -1),
            "name": F.substring("names", -NAME, NAME),
            "parent": last_name(F.expr(f"substring(names, 1, {(depth - 1) * NAME})"), F.col("start")),
            "depth": F.lit(top + depth).cast("long"),
        })
        level = stage_table(level, "level")
        nodes.append(level.select([c.split()[0] for c in NODE.split(", ")]))
        survivors = level.select("start", F.expr(f"substring(names, 1, {(depth - 1) * NAME})").alias("names"), F.expr(f"slice(words, 1, {depth - 1})").alias("words"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    whole = rows.where(F.length("names") == 0).select(columns)
    left = whole if survivors is None else survivors.unionByName(whole)
    sums = left.groupBy(F.col("start").alias("name")).agg(*state("names", "words"))
    return nodes, sums


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """NODE rows with parent_conv_id: the whole trie of rows (conv_id, pos, turn, words; pos 0 stands for a conversation)."""
    spark: SparkSession = rows.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    discard(spark, folder, at_exit=True)

    def by_band(df: DataFrame, name: str) -> DataFrame:
        df.write.partitionBy("band").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    bands = by_band(banded(rows), "bands")
    ends = by_band(endings(bands), "ends")
    deepest = bands.agg(F.max("band")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], f"{NODE}, parent_conv_id long")
    hot = stage_table(bands.where("band > 0").groupBy("band", "start").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("band", "start"), "hot")
    hot_bands = {r.band for r in hot.select("band").distinct().collect()} if deepest else set()
    columns = ["start", "names", "words", *[c.split()[0] for c in STATE.split(", ")]]
    nodes, survivors = [], None
    for band in range(deepest, -1, -1):
        entering = ends.where(F.col("band") == band).select(columns)
        if survivors is not None:
            names = bands.where(F.col("band") == band).select("conv_id", "start", "names", "words")
            entering = survivors.join(names, "conv_id").select(columns).unionByName(entering)
        top, state = band_start(band), [c.split()[0] for c in STATE.split(", ")]
        parts = []
        if band in hot_bands or band == 0:
            entering = stage_table(entering, "entering")
            of_band = hot.where(F.col("band") == band).select("start")
            exchanged, sums = peeled_by_exchange(entering if band == 0 else entering.join(of_band, "start", "left_semi"), top)
            nodes += exchanged
            if band == 0:
                root = sums.withColumns({"parent": F.lit(None).cast("binary"), "depth": F.lit(0).cast("long"), "n_leaves": F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1)})
                nodes.append(root.select([c.split()[0] for c in NODE.split(", ")]))
                break
            parts.append(sums.select(state))
            entering = entering.join(of_band, "start", "left_anti")
        told = stage_table(peeled_in_tasks(entering, top), "band")
        nodes.append(told.where(F.col("depth") > top))
        parts.append(told.where(F.col("depth") == top).select(state))
        # A band's sums are what its nodes' parents get: each is one child or more of a node above, which is counted there.
        survivors = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    above = every.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(above, "parent", "left")


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for each node of the rebuilt conversations."""
    nodes = prefix_nodes(rebuilt(hashed_turns(conversations)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
