"""Counts, shares, cross-tabulations and class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of each non-null value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def top_categories(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n most frequent values (ties by value) and the rest together as Other; shares are of all non-null rows."""
    counts = value_counts(df, column)
    top = counts.orderBy(F.desc("n"), "value").limit(n).select("value", F.lit(True).alias("top"))
    named = counts.join(F.broadcast(top), "value", "left").withColumn("value", F.when(F.col("top"), F.col("value").cast("string")).otherwise("Other"))
    return named.groupBy("value").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))


def top_shown(df: DataFrame, column: str, n: int = 10, without: str | None = None) -> DataFrame:
    """The n most frequent values only; shares are of the rows shown. `without` names a value to leave out."""
    rows = df.where(F.col(column) != without) if without is not None else df
    top = value_counts(rows, column).select("value", "n").orderBy(F.desc("n"), "value").limit(n)
    return top.crossJoin(F.broadcast(top.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True) -> DataFrame:
    """a, b, n in long form; margins are rows named Total."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    if not margins:
        return rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    cube = rows.cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return cube.select(F.when(F.col("ga") == 1, "Total").otherwise(F.col("a")).alias("a"), F.when(F.col("gb") == 1, "Total").otherwise(F.col("b")).alias("b"), "n")


def percentages(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per cell: its count, and its percentage of the row's and of the column's total."""
    cells = crosstab(df, a, b, margins=False)
    of = lambda c: F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(c))
    return cells.select("a", "b", "n", of("a").alias("row_pct"), of("b").alias("col_pct"))


def enrichment(df: DataFrame, cluster: str, active: Column, threshold: float = 10.0) -> DataFrame:
    """Per cluster: percentage active, its difference from all rows', and the status beyond +-threshold points."""
    rows = df.select(F.col(cluster).alias("cluster"), active.cast("int").alias("active"))
    by = rows.groupBy("cluster").agg(F.count("*").alias("n"), (F.avg("active") * 100).alias("pct"))
    overall = rows.agg((F.avg("active") * 100).alias("overall"))
    out = by.crossJoin(F.broadcast(overall)).withColumn("diff", F.col("pct") - F.col("overall"))
    status = F.when(F.col("diff") > threshold, "enriched").when(F.col("diff") < -threshold, "depleted").otherwise("similar")
    return out.select("cluster", "n", "pct", "diff", status.alias("status"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows and of those that meet each condition; one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def label_distribution(df: DataFrame, label: str = "label", structure: str = "structure") -> DataFrame:
    """Rows and distinct structures per label; -1 and null are Unlabelled."""
    name = F.when(F.col(label).isNull() | (F.col(label) == -1), "Unlabelled").otherwise(F.col(label).cast("string"))
    return df.groupBy(name.alias("label")).agg(F.count("*").alias("n_rows"), F.countDistinct(structure).alias("n_structures"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts per bin of [low, high]; the upper edge belongs to the last bin, values outside to none."""
    rows = df.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def class_statistics(long: DataFrame, feature: str = "feature", label: str = "label", value: str = "value") -> DataFrame:
    return long.where(F.col(value).isNotNull()).groupBy(feature, label).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, n_correct, accuracy, and precision and recall weighted by the classes' sizes (0 where undefined)."""
    cells = confusion(df, label, prediction)
    true = cells.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    told = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("told"))
    both = true.join(told, "c", "left")
    total = F.sum("actual")
    return both.agg(
        total.alias("n"), F.sum("hit").alias("n_correct"), (F.sum("hit") / total).alias("accuracy"),
        (F.sum(F.col("actual") * F.coalesce(F.col("hit") / F.col("told"), F.lit(0.0))) / total).alias("precision"),
        (F.sum(F.col("actual") * (F.col("hit") / F.col("actual"))) / total).alias("recall"),
    )


def funnel(stages: dict[str, DataFrame], structure: str = "structure") -> DataFrame:
    """stage and its number of distinct structures."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.countDistinct(structure).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for several columns in one pass."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def ranking(scores: DataFrame, feature: str = "feature", score: str = "importance", n: int = 20, fallback: int = 5) -> DataFrame:
    """The n best features of positive score with their rank; if there is none, the first few."""
    rank = F.row_number().over(Window.orderBy(F.desc(score), feature))  # a row per feature
    ranked = scores.withColumn("rank", rank)
    any_ = scores.agg(F.coalesce(F.max(F.col(score)) > 0, F.lit(False)).alias("any"))
    return ranked.crossJoin(F.broadcast(any_)).where((F.col("any") & (F.col(score) > 0) & (F.col("rank") <= n)) | (~F.col("any") & (F.col("rank") <= fallback))).drop("any")


def touched_positions(pairs: DataFrame) -> DataFrame:
    """Distinct positions that (pos1, pos2) rows touch."""
    return pairs.select(F.explode(F.array("pos1", "pos2")).alias("pos")).distinct()
