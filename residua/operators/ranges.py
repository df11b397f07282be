"""Orders over whole tables without one task that sees all rows: numbers, ranks and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.graph import dropped, written


def numbered_by_range(rows: DataFrame, *keys: str, number: str = "number") -> DataFrame:
    """rows with their place from 0 in the order of the keys.

    Rows are dealt by ranges of the keys and written; each task numbers its range, and the
    counts of the ranges before it, a row per partition, are added. Rows with equal keys
    are of one range.
    """
    dealt = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(number, F.col("_start") + F.col("_own") - 1).drop("_part", "_own", "_start")


def least_by_hash(rows: DataFrame, n: Column | int, *keys: str, seed: int = 42, by: tuple[str, ...] = (), bits: int = 12) -> DataFrame:
    """Per group `by`, the n rows (a number, or a column that is equal within a group) that come first in a seeded hash order of the keys.

    The hash's upper bits cut the rows into ranges that are counted (map-side); whole
    ranges are taken up to the one that holds the n-th row, and only that range is ranked.
    """
    h = rows.withColumns({"_h": F.xxhash64(*keys, F.lit(seed)), "_n": n if isinstance(n, Column) else F.lit(n)})
    h = h.withColumn("_range", F.shiftright("_h", 64 - bits))
    sizes = h.groupBy(*by, "_range").agg(F.count("*").alias("_size"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_range")  # at most 2^bits rows a group
    sizes = sizes.withColumn("_end", F.sum("_size").over(upto)).withColumn("_begin", F.col("_end") - F.col("_size"))
    cuts = F.broadcast(sizes.where("_begin < _n").select(*by, "_range", "_begin", F.col("_end") <= F.col("_n")).toDF(*by, "_range", "_begin", "_whole"))
    near = h.join(cuts, [*by, "_range"])
    edge = near.where("not _whole").withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", *keys)) + F.col("_begin")).where("_at <= _n")
    return near.where("_whole").select(*rows.columns).unionByName(edge.select(*rows.columns))


def quantiles(rows: DataFrame, value: str, shares: list[float], most: int = 20_000, accuracy: int = 2048, stored: bool = False) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, by brackets that a mergeable sketch draws.

    Each wanted rank has an open interval of values that holds it. While one holds more than
    `most` rows, a sketch of what is inside draws two values close to the rank; counts below,
    at, between and above them say in which part the rank is, whatever the sketch's error. A
    part excludes the drawn values, so intervals shrink by some hundred times a step, and
    values that very many rows share are found as such. The driver gets the counts of the
    different values in the last intervals, at most `most` a rank. Nothing is sorted. The values are
    read several times, so they are written first, unless rows are a stored table; what gives
    them runs once. Null and NaN are missing.
    """
    v = rows.select(F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    if not stored:
        v = written(v)
        try:
            return quantiles(v, "_v", shares, most, accuracy, stored=True)
        finally:
            dropped(rows.sparkSession, v)
    x, gap = F.col("_v"), 4 / accuracy
    total = v.count()
    if not total:
        return [None] * len(shares)
    ranks = sorted({r for s in shares for r in (int(s * (total - 1)), min(int(s * (total - 1)) + 1, total - 1))})
    inside = {r: (None, None, 0, total) for r in ranks}  # lower and upper end, rows up to the lower end, rows inside
    found: dict[int, float] = {}

    def within(r: int) -> Column:
        low, high, _, _ = inside[r]
        c = F.lit(True) if low is None else x > low
        return c if high is None else c & (x < high)

    while wide := [r for r in inside if inside[r][3] > most]:
        place = {r: (r - inside[r][2] + 0.5) / inside[r][3] for r in wide}
        drawn = v.agg(*[F.percentile_approx(F.when(within(r), x), [max(0.0, place[r] - gap), min(1.0, place[r] + gap)], accuracy).alias(f"e{r}") for r in wide]).first()
        parts = lambda r, a, b: (within(r) & (x < a), x == a, within(r) & (x > a) & (x < b), (x == b) & (x > a))
        n = v.agg(*[F.count_if(c).alias(f"{k}_{r}") for r in wide for k, c in enumerate(parts(r, *drawn[f"e{r}"]))]).first()
        for r in wide:
            low, high, under, rows_in = inside.pop(r)
            a, b = drawn[f"e{r}"]
            before, at_a, between, at_b = (n[f"{k}_{r}"] for k in range(4))
            at = r - under
            if at < before:
                inside[r] = (low, a, under, before)
            elif at < before + at_a:
                found[r] = a
            elif at < before + at_a + between:
                inside[r] = (a, b, under + before + at_a, between)
            elif at < before + at_a + between + at_b:
                found[r] = b
            else:
                passed = before + at_a + between + at_b
                inside[r] = (b, high, under + passed, rows_in - passed)
    if inside:
        near = F.lit(False)
        for r in inside:
            near |= within(r)
        counts = sorted((r["_v"], r["n"]) for r in v.where(near).groupBy("_v").agg(F.count("*").alias("n")).collect())
        for r, (low, high, under, _) in inside.items():
            for y, n in counts:
                if (low is None or y > low) and (high is None or y < high):
                    under += n
                    if under > r:
                        found[r] = y
                        break
    out = []
    for s in shares:
        place = s * (total - 1)
        low, high = found[int(place)], found[min(int(place) + 1, total - 1)]
        out.append(low + (high - low) * (place - int(place)))
    return out


def group_quantiles(rows: DataFrame, by: str, value: str, share: float = 0.5, accuracy: int = 2048) -> DataFrame:
    """by, quantile: exact quantiles per group, interpolated between neighbours, without a buffer of a group's values.

    Mergeable sketches bracket the wanted rank per group (a bracket of four times the
    sketch's error on both sides). Values in the bracket are then counted by value and those
    below it as one number, both before the shuffle, and ranks are read off these counts:
    less than one value in two hundred of a large group. Groups of few values are counted
    whole. A group without values gives no row.
    """
    present = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    gap = 4 / accuracy
    sketch = F.percentile_approx("_v", [max(0.0, share - gap), min(1.0, share + gap)], accuracy)
    known = present.groupBy(by).agg(F.count("*").alias("_n"), sketch.alias("_ends"))
    few = F.col("_n") <= 2 * accuracy
    ends = known.select(by, "_n", F.when(few, float("-inf")).otherwise(F.col("_ends")[0]).alias("_low"), F.when(few, float("inf")).otherwise(F.col("_ends")[1]).alias("_high"))
    ends = written(ends)
    near = present.join(ends.select(by, "_low", "_high"), by).where(F.col("_v") <= F.col("_high"))
    counts = near.groupBy(by, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(by).orderBy(F.asc_nulls_first("_v"))
    place = F.lit(share) * (F.col("_n") - 1)
    ranked = counts.withColumn("_end", F.sum("_c").over(upto)).join(ends.select(by, "_n"), by)
    at = lambda p: F.max(F.when((F.col("_end") > p) & (F.col("_end") - F.col("_c") <= p), F.col("_v")))
    found = ranked.groupBy(by, "_n").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    part = place - F.floor(place)
    return found.select(by, F.when(part == 0, F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part).alias("quantile"))
