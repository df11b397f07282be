"""Hard negatives by inner product, with segment summaries that bound scores before they are computed.

* A vector is cut into segments; of each segment its mean and its deviation (the length of
  what is left without the mean) are stored. The scores of a pair lie between the sum of
  length * mean * mean minus, and plus, the sum of deviation * deviation. One segment, then
  four, then sixteen are tried; a pair goes on only while its bounds leave it in question,
  and what is left at the end is scored exactly, in integers.
* Anchors are a stated query set. Anchors and rows are dealt to cells of a grid (a group of
  anchors by a group of rows); a cell holds its anchors and streams its rows, and keeps the
  best few for each anchor, which also tighten the bounds for the rows to come. The best of
  all cells are then ranked by anchor: a few rows per anchor and cell.
* First pass: each anchor's positives. Second pass: for each positive the best rows of other
  labels whose score lies in the positive's range.

Bounds only ever leave out pairs that can't be among the results (there is a slack for
rounding), so results are those of scoring all pairs.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows that are equal in id, label and floored vector are one row;
vectors of different lengths are padded with zeros; an anchor without positives or a
positive without negatives gives no rows. Scores must fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import released, stage_table

#: Numbers of segments, from coarse to fine.
LEVELS = (1, 4, 16)
#: Anchors and rows of one cell, at most about.
CELL_ANCHORS, CELL_ROWS = 8192, 1 << 20
#: Anchors and rows that are bounded in one step.
STEP_ANCHORS, STEP_ROWS = 512, 2048
#: Below this share of a step's pairs, pairs are bounded and scored one by one instead of as a matrix.
SPARSE = 0.05

ROW = "id long, label long, key long, anchor boolean, q binary, means binary, deviations binary"


def segment_edges(dim: int) -> list[np.ndarray]:
    """Begins and ends of the segments of each level (no empty ones)."""
    return [np.unique(np.linspace(0, dim, min(n, max(dim, 1)) + 1).astype(int)) for n in LEVELS]


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the root of the segment's length) and deviations of all levels' segments, side by side."""
    means, deviations = [], []
    for edges in segment_edges(q.shape[1]):
        for a, b in zip(edges[:-1], edges[1:]):
            part = q[:, a:b].astype(np.float64)
            m = part.mean(axis=1)
            means.append(m * np.sqrt(b - a))
            deviations.append(np.sqrt(np.square(part - m[:, None]).sum(axis=1)))
    if not means:
        return np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), np.float32)
    return np.stack(means, axis=1).astype(np.float32), np.stack(deviations, axis=1).astype(np.float32)


def vector_table(vectors: DataFrame, is_anchor: Column) -> tuple[DataFrame, dict]:
    """ROW table of vectors (id, label, q array<long>), written once, and its measures."""
    largest = F.coalesce(F.array_max(F.transform("q", lambda x: F.abs(x))), F.lit(0))
    size = vectors.agg(F.max(F.size("q")).alias("dim"), F.max(largest).alias("largest")).first()
    dim, largest = size["dim"] or 0, size["largest"] or 0
    kind = next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("q")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            q = np.zeros((len(lengths), dim), np.int64)
            q[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            m, d = summaries(q)
            blobs = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.astype(kind), m, d)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "key", "anchor")), *blobs], names=[c.split()[0] for c in ROW.split(", ")])

    rows = vectors.distinct().select("id", "label", F.xxhash64("id", "label", "q").alias("key"), is_anchor.alias("anchor"), "q")
    table = stage_table(rows.mapInArrow(released(run), ROW), "vectors")
    n = table.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    return table, {"dim": dim, "kind": kind, "exact": float(largest) ** 2 * max(dim, 1) < 2**53, "rows": n["rows"], "anchors": n["anchors"]}


class Side:
    """Vectors and their summaries as arrays."""

    def __init__(self, batch: pa.RecordBatch, about: dict):
        n = batch.num_rows
        of = lambda c, kind, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, width)
        widths = [len(e) - 1 for e in segment_edges(about["dim"])]
        self.id, self.label, self.key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "key"))
        self.q = of("q", about["kind"], about["dim"]).astype(np.float64 if about["exact"] else np.int64)
        cut = np.cumsum(widths)[:-1]
        self.means, self.deviations = (np.split(of(c, np.float32, sum(widths)), cut, axis=1) for c in ("means", "deviations"))
        self.norm = np.sqrt(np.square(self.q.astype(np.float64)).sum(axis=1))

    def __len__(self) -> int:
        return len(self.id)


def bounds(a: Side, x: Side, level: int, i: np.ndarray | slice, j: np.ndarray | slice, paired: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centre and half width of the range that holds the scores of anchors i and rows j: as a matrix, or pair by pair."""
    m, n, d, e = a.means[level][i], x.means[level][j], a.deviations[level][i], x.deviations[level][j]
    if paired:
        return np.einsum("ij,ij->i", m, n), np.einsum("ij,ij->i", d, e) + 1e-5 * a.norm[i] * x.norm[j] + 1
    return m @ n.T, d @ e.T + (1e-5 * a.norm[i]).astype(np.float32)[:, None] * x.norm[j].astype(np.float32) + 1


def in_question(a: Side, x: Side, i: slice, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of a step that no level of segments can leave out.

    low and high have a row per anchor and a column per range: a pair stays while, for some
    range, its upper bound reaches low and its lower bound does not pass high.
    """
    alive, pairs = allowed, None
    for level in range(len(LEVELS)):
        if pairs is None and alive.mean() < SPARSE:
            pairs = np.nonzero(alive)
        if pairs is None:
            centre, half = bounds(a, x, level, i, slice(None), False)
            top, bottom = centre + half, centre - half
            keep = np.zeros_like(alive)
            for r in range(low.shape[1]):
                fits = top >= low[:, r, None]
                keep |= fits if high is None else fits & (bottom <= high[:, r, None])
            alive = alive & keep
        else:
            p, q = pairs
            centre, half = bounds(a, x, level, i.start + p, q, True)
            fits = (centre + half)[:, None] >= low[p]
            keep = (fits if high is None else fits & ((centre - half)[:, None] <= high[p])).any(axis=1)
            pairs = p[keep], q[keep]
        if stats is not None:
            stats[LEVELS[level]] = stats.get(LEVELS[level], 0) + (int(alive.sum()) if pairs is None else len(pairs[0]))
    return np.nonzero(alive) if pairs is None else pairs


def scores_of(a: Side, x: Side, p: np.ndarray, q: np.ndarray, shape: tuple[slice, int]) -> np.ndarray:
    """Exact integer scores of pairs."""
    i, n = shape
    if len(p) > SPARSE * (i.stop - i.start) * n:
        return (a.q[i] @ x.q.T)[p, q].astype(np.int64)
    return np.einsum("ij,ij->i", a.q[i.start + p], x.q[q]).astype(np.int64)


class Best:
    """The first `most` (score descending, then id, then key) of each list, over many steps."""

    def __init__(self, lists: int, most: int):
        self.lists, self.most = lists, most
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # list, score, id, key
        self.least = np.full(lists, -np.inf)  # the score that a further row has to reach

    def add(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray, key: np.ndarray) -> None:
        if not len(at):
            return
        at, score, id_, key = (np.concatenate(x) for x in zip(self.rows, (at, score, id_, key)))
        order = np.lexsort((key, id_, -score, at))
        at, score, id_, key = at[order], score[order], id_[order], key[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.most
        last = place == self.most - 1
        self.least[at[last]] = score[last]
        self.rows = [x[keep] for x in (at, score, id_, key)]


FOUND = "anchor long, anchor_key long, positive long, positive_key long, positive_score long, score long, id long, key long"


def positives_of(a: Side, x: Side, best: Best, stats: dict | None = None) -> None:
    """Add x's rows of an anchor's label to its best."""
    for begin in range(0, len(a), STEP_ANCHORS):
        i = slice(begin, min(begin + STEP_ANCHORS, len(a)))
        allowed = (a.label[i, None] == x.label) & ((a.key[i, None] != x.key) | (a.id[i, None] != x.id))
        p, q = in_question(a, x, i, allowed, best.least[i, None], None, stats)
        best.add(begin + p, scores_of(a, x, p, q, (i, len(x))), x.id[q], x.key[q])


def negatives_of(a: Side, x: Side, low: np.ndarray, high: np.ndarray, best: Best, stats: dict | None = None) -> None:
    """Add x's rows of other labels to the best of each of an anchor's ranges (low and high: anchors by ranges)."""
    ranges = low.shape[1]
    for begin in range(0, len(a), STEP_ANCHORS):
        i = slice(begin, min(begin + STEP_ANCHORS, len(a)))
        allowed = a.label[i, None] != x.label
        reach = np.maximum(low[i], best.least.reshape(-1, ranges)[i])
        p, q = in_question(a, x, i, allowed, reach, high[i], stats)
        score = scores_of(a, x, p, q, (i, len(x)))
        pair, r = np.nonzero((score[:, None] >= reach[p]) & (score[:, None] >= low[i][p]) & (score[:, None] <= high[i][p]))
        best.add((begin + p[pair]) * ranges + r, score[pair], x.id[q[pair]], x.key[q[pair]])


def in_cells(rows: DataFrame, anchors: DataFrame, about: dict, run, schema: str) -> DataFrame:
    """run(anchors, batches of rows) for every cell of the grid, each in one task that holds its anchors and streams its rows.

    Cells are as many as the sizes ask for, and at least as many as keep the cluster busy;
    a row is sent to as many cells as there are groups of anchors, and the other way round.
    """
    spark = rows.sparkSession
    groups = max(1, -(-about["anchors"] // CELL_ANCHORS))
    parts = max(1, -(-about["rows"] // CELL_ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")
    ranges = [c for c in ("low", "high", "positive", "positive_key", "positive_score") if c in anchors.columns]
    left = anchors.withColumns({"side": F.lit(0), "g": own(groups)}).withColumn("p", everywhere(parts))
    right = rows.withColumns({"side": F.lit(1), "p": own(parts)} | {c: F.lit(None).cast("array<long>") for c in ranges}).withColumn("g", everywhere(groups))
    both = left.unionByName(right).withColumn("cell", F.col("g") * parts + F.col("p")).drop("g", "p")
    dealt = both.repartitionById(groups * parts, F.col("cell")).sortWithinPartitions("cell", "side")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, work = [], None, None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                step = batch.slice(at, STEP_ROWS)
                number = step.column("cell").to_numpy() * 2 + step.column("side").to_numpy()
                cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)]
                for begin, end in zip(cuts[:-1], cuts[1:]):
                    part, c, side = step.slice(begin, end - begin), int(number[begin]) // 2, int(number[begin]) % 2
                    if c != cell:
                        if work:
                            yield from work.done()
                        held, cell, work = [], c, None
                    if side == 0:
                        held.append(part)
                    elif held:
                        work = work or run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                        work.add(Side(part, about))
        if work:
            yield from work.done()

    return dealt.mapInArrow(released(cells), schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor, positive, rank, id and both scores: each anchor's best rows of its own label, and for each of them the
    best rows of other labels whose score is between low and high hundredths of the positive's.

    vectors: id, label and q, whole numbers. is_anchor: a condition over id and label.
    """
    table, about = vector_table(vectors, is_anchor)
    plain = ["id", "label", "key", "q", "means", "deviations"]
    rows, anchors = table.select(plain), table.where("anchor").select(plain)

    class Positives:
        def __init__(self, batch: pa.RecordBatch):
            self.a = Side(batch, about)
            self.best = Best(len(self.a), positives)

        def add(self, x: Side) -> None:
            positives_of(self.a, x, self.best)

        def done(self) -> Iterator[pa.RecordBatch]:
            at, score, id_, key = self.best.rows
            yield pa.RecordBatch.from_pydict({"anchor": self.a.id[at], "anchor_key": self.a.key[at], "score": score, "id": id_, "key": key})

    found = in_cells(rows, anchors, about, Positives, "anchor long, anchor_key long, score long, id long, key long")
    first = Window.partitionBy("anchor", "anchor_key").orderBy(F.desc("score"), "id", "key")
    best = stage_table(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n"), "positives")

    hundredths = lambda n: f"((score * {n}L) - pmod(score * {n}L, 100L)) div 100L"  # noqa: E731  rounded down
    ranged = best.withColumns({"low_end": -F.expr(hundredths(-low)), "high_end": F.expr(hundredths(high))}).where("low_end <= high_end")
    lists = ranged.groupBy(F.col("anchor").alias("id"), F.col("anchor_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("score", F.col("id").alias("positive"), F.col("key").alias("positive_key"), "low_end", "high_end"))).alias("x"))
    asked = anchors.join(lists, ["id", "key"]).select(
        *plain, F.col("x.low_end").alias("low"), F.col("x.high_end").alias("high"), F.col("x.positive").alias("positive"), F.col("x.positive_key").alias("positive_key"), F.col("x.score").alias("positive_score")
    )

    class Negatives:
        def __init__(self, batch: pa.RecordBatch):
            self.a = Side(batch, about)
            lists = {c: batch.column(c).to_pylist() for c in ("low", "high", "positive", "positive_key", "positive_score")}
            self.width = max(len(x) for x in lists["low"])
            filled = lambda c, empty: np.array([x + [empty] * (self.width - len(x)) for x in lists[c]], np.int64)
            self.low, self.high = filled("low", 1), filled("high", 0)
            self.none = self.low > self.high
            self.told = [filled(c, 0).ravel() for c in ("positive", "positive_key", "positive_score")]
            self.best = Best(self.low.size, negatives)
            self.best.least[self.none.ravel()] = np.inf

        def add(self, x: Side) -> None:
            negatives_of(self.a, x, self.low, self.high, self.best)

        def done(self) -> Iterator[pa.RecordBatch]:
            at, score, id_, key = self.best.rows
            a, (p, pk, ps) = at // self.width, self.told
            yield pa.RecordBatch.from_pydict({"anchor": self.a.id[a], "anchor_key": self.a.key[a], "positive": p[at], "positive_key": pk[at], "positive_score": ps[at], "score": score, "id": id_, "key": key})

    found = in_cells(rows, asked, about, Negatives, FOUND)
    order = Window.partitionBy("anchor", "anchor_key", "positive", "positive_key").orderBy(F.desc("score"), "id", "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor", "positive", "rank", "id", "positive_score", "score")


def floored(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: id, label (moved on by one where the id is divisible by 7) and q, components times 256, floored."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))


def negatives_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: anchors are the rows whose id is divisible by 100."""
    found = mine(floored(embeddings), F.col("id") % 100 == 0)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
