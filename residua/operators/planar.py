"""Points of the plane in boxes of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators.ranges import numbered_by_range


def _cut(rows: DataFrame, by: list[str], keys: list[str], parts: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with `name`: which of the equal parts, in the order of keys within `by`, a row is in; `_n` is the size of its group."""
    numbered = numbered_by_range(rows.drop("_n"), *by, *keys, number="_at")
    sizes = numbered.groupBy(*by).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    both = numbered.join(sizes, by) if by else numbered.crossJoin(F.broadcast(sizes))
    place = F.floor((F.col("_at") - F.col("_from")) * parts(F.col("_n")) / F.col("_n"))
    return both.withColumn(name, place.cast("long")).drop("_at", "_from")


def kd_leaves(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """rows (z1, z2, ...) with `strip` and `leaf`: within each group `by`, strips by z1 and leaves by z2 within a strip.

    A leaf has about `size` rows, or the root of the group's size where that is more, so a
    group has no more pairs of leaves than rows. Both cuts go by counted ranges of the
    whole order: no task sorts a group, whatever its size.
    """
    most = F.greatest(F.lit(size), F.ceil(F.sqrt("_n"))).cast("long")
    strips = _cut(rows, list(by), ["z1", "z2"], lambda n: F.ceil(F.sqrt(n / F.greatest(F.lit(size), F.ceil(F.sqrt(n))))), "strip")
    strips = strips.withColumn("_size", most)
    return _cut(strips, [*by, "strip"], ["z2", "z1"], lambda n: F.ceil(n / F.col("_size")), "leaf").drop("_n", "_size")
