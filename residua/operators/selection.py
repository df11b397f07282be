"""Feature statistics and selection over a long table (structure, feature, value, label)."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from residua.operators.ranges import least_by_hash


def anova_f(long: DataFrame, feature: str = "feature", label: str = "label", value: str = "value") -> DataFrame:
    """One-way ANOVA F per feature over rows with a value and a label.

    Features with fewer than three rows or two classes get F = 0; no spread within
    classes gives NaN, which ranks first. Two aggregations: classes are summarised by
    count, mean and squared deviation, which combine map-side, so the second one reads
    one row per feature and class.
    """
    rows = long.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    by_class = rows.groupBy(feature, label).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("ss")
    )
    whole = by_class.groupBy(feature).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum("ss").alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.collect_list(F.struct("n", "m")).alias("classes"),
    )
    mean = F.col("s1") / F.col("n")
    between = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c.n * (c.m - mean) * (c.m - mean))
    usable = (F.col("n") >= 3) & (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return whole.select(feature, "n", "k", F.when(usable, F.coalesce(f, F.lit(float("nan")))).otherwise(0.0).alias("f"))


def top_features(scores: DataFrame, n: int, feature: str = "feature", score: str = "f") -> DataFrame:
    """The n features of highest score (NaN first, ties by feature id)."""
    return scores.orderBy(F.desc(score), feature).limit(n)


def mask_large(long: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Values over the threshold become null."""
    return long.withColumn("value", F.when(F.col("value") <= threshold, F.col("value")))


def large_values(long: DataFrame, threshold: float = 70.0, n: int | None = None) -> DataFrame:
    """Rows with a value over the threshold, largest first; n of them if given."""
    rows = long.where(F.col("value") > threshold).orderBy(F.desc("value"), "structure", "feature")
    return rows.limit(n) if n else rows


def large_by_feature(long: DataFrame, threshold: float, n: int = 10) -> DataFrame:
    """The features with most values over the threshold, and how many of their values remain."""
    by = long.groupBy("feature").agg(F.count_if(F.col("value") > threshold).alias("n_large"), F.count_if(F.col("value") <= threshold).alias("n_left"))
    return by.where("n_large > 0").orderBy(F.desc("n_large"), "feature").limit(n)


def without_neighbours(pairs: DataFrame) -> DataFrame:
    """Rows whose positions are not consecutive."""
    return pairs.where(F.abs(F.col("pos2") - F.col("pos1")) != 1)


def keep_features(long: DataFrame, features: DataFrame, feature: str = "feature") -> DataFrame:
    """Rows of the chosen features."""
    return long.join(features.select(feature).distinct(), feature, "left_semi")


def feature_statistics(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """mean, population std and variance, and number of values per feature."""
    return long.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("variance"), F.count(value).alias("n"))


def drop_missing(dense: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows of features whose share of missing values is at most `most`, then of structures, over the features left."""
    share = lambda key, df: df.groupBy(key).agg(F.avg(F.col("value").isNull().cast("int")).alias("m")).where(F.col("m") <= most).select(key)
    kept = dense.join(share("feature", dense), "feature", "left_semi")
    return kept.join(share("structure", kept), "structure", "left_semi")


def cleanup(dense: DataFrame, threshold: float = 50.0, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Masked and reduced rows, and a table of step, structures, features and values."""
    masked = mask_large(dense, threshold)
    kept = drop_missing(masked, most)
    size = lambda name, df: df.agg(F.countDistinct("structure").alias("structures"), F.countDistinct("feature").alias("features"), F.count("value").alias("values")).select(F.lit(name).alias("step"), "*")
    return kept, size("before", dense).unionByName(size("masked", masked)).unionByName(size("reduced", kept))


def representatives(groups: DataFrame, stats: DataFrame, group: str = "component") -> DataFrame:
    """Per group the feature with the largest std (ties: the smallest id)."""
    return groups.join(stats.select("feature", "std"), "feature").groupBy(group).agg(F.max_by("feature", F.struct("std", -F.col("feature"))).alias("feature"), F.count("*").alias("members"))


def low_variance(stats: DataFrame, threshold: float = 0.1, inclusive: bool = False) -> DataFrame:
    """Features whose population variance is over the threshold (or equal to it, if inclusive)."""
    v = F.col("variance")
    return stats.where(v >= threshold if inclusive else v > threshold).select("feature")


def balanced(rows: DataFrame, label: str = "label", key: str = "structure", seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, by a seeded hash order of the key."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first().n or 0
    return least_by_hash(rows, least, key, seed=seed, by=(label,))


def correlated_pairs(dense: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b whose signed Pearson r over structures is above the threshold.

    Missing cells take the feature's median. For few features: one self-join on structure,
    summed map-side. For many, see gram_pairs.
    """
    from residua.operators.features import imputed

    x = imputed(dense).select("structure", "feature", "value")
    a, b = x.alias("a"), x.alias("b")
    both = a.join(b, (F.col("a.structure") == F.col("b.structure")) & (F.col("a.feature") < F.col("b.feature")))
    r = both.groupBy(F.col("a.feature").alias("a"), F.col("b.feature").alias("b")).agg(F.corr("a.value", "b.value").alias("r"))
    return r.where(F.col("r") > threshold)


def unit_columns(dense: DataFrame, block: int, pivots: int = 8) -> tuple[DataFrame, list]:
    """structure, feature, z (values without their mean, scaled to a length of one per feature), and per feature its id, spread and angles to the pivots.

    The list has a row per feature. Pivots are features spread evenly over the ids; up to
    one block of features has none.
    """
    from residua.operators.features import imputed
    from residua.operators.graph import written

    x = written(imputed(dense).select("structure", "feature", "value"))
    stats = x.groupBy("feature").agg(F.avg("value").alias("m"), F.sqrt(F.var_pop("value") * F.count("value")).alias("s"))
    found = sorted(stats.collect(), key=lambda r: r["feature"])  # a row per feature
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    table = x.sparkSession.createDataFrame([(r["feature"], r["m"], r["s"]) for r in found], x.select("feature").schema.add("m", "double").add("s", "double"))
    unit = x.join(F.broadcast(table), "feature").select("structure", "feature", z.alias("z"))
    spread = [r["feature"] for r in found if r["s"] and r["s"] > 0]
    chosen = sorted({spread[k * len(spread) // pivots] for k in range(pivots)}) if len(spread) > block else []
    angles: dict = {}
    if chosen:
        own = unit.where(F.col("feature").isin(chosen)).groupBy("structure").agg(*[F.sum(F.when(F.col("feature") == p, F.col("z"))).alias(f"p{k}") for k, p in enumerate(chosen)])
        near = unit.join(own, "structure").groupBy("feature").agg(*[F.sum(F.col("z") * F.col(f"p{k}")).alias(f"p{k}") for k in range(len(chosen))])
        angles = {r["feature"]: [math.acos(min(1.0, max(-1.0, r[f"p{k}"] or 0.0))) for k in range(len(chosen))] for r in near.collect()}
    return unit, [(f, angles.get(f, [])) for f in spread]


def open_blocks(order: list, width: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of blocks of features that may hold a correlation above the threshold.

    The angle between two features is at least the difference of their angles to any third
    one, so blocks whose angles to a pivot lie farther apart than the threshold's have none.
    """
    most = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    blocks = [list(zip(*[a for _, a in order[k : k + width]])) for k in range(0, len(order), width)]
    spans = [[(min(a), max(a)) for a in b] for b in blocks]
    apart = lambda p, q: any(x[0] - y[1] > most or y[0] - x[1] > most for x, y in zip(p, q))
    return [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks)) if i == j or not apart(spans[i], spans[j])]


def gram_pairs(dense: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """The same for many features: products of blocks of features, summed over structures in packed rows.

    A structure's values are cut into blocks of features, each packed into one binary row.
    A task takes one pair of blocks and a share of the structures, streams their rows in
    the order of the structures and adds up one block square; shares are summed row by row
    of the square. Only edges leave. Blocks are made of features that have similar angles to
    some pivots, and pairs of blocks that the angles rule out are not multiplied. Constant
    features have no partners.
    """
    import numpy as np
    import pyarrow as pa

    spark = dense.sparkSession
    unit, order = unit_columns(dense, block)
    order.sort(key=lambda r: (min(range(len(r[1])), key=lambda k: r[1][k]), min(r[1]), r[0]) if r[1] else (0, 0, r[0]))
    width = min(block, max(1, len(order)))
    pairs = open_blocks(order, width, threshold)
    kind = dense.select(F.col("feature").alias("name")).schema
    names = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(order)], StructType([StructField("at", LongType()), *kind.fields]))
    if not pairs:
        return spark.createDataFrame([], StructType([StructField("a", kind[0].dataType), StructField("b", kind[0].dataType), StructField("r", DoubleType())]))
    cells = unit.join(F.broadcast(names), F.col("feature") == F.col("name")).select(F.xxhash64("structure").alias("key"), F.floor(F.col("at") / width).cast("int").alias("block"), (F.col("at") % width).cast("int").alias("at"), "z")

    def packed(batches):
        key, block_, row = None, None, None
        for batch in batches:
            k, b, at, z = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "at", "z"))
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]) if len(k) else np.zeros(0, int)
            group = np.zeros(len(k), int)
            group[cuts[1:]] = 1
            group = np.cumsum(group)
            square = np.zeros((len(cuts), width))
            square[group, at] = z
            if not len(cuts):
                continue
            if row is not None:
                if (key, block_) == (k[0], b[0]):
                    square[0] += row
                else:
                    yield pa.RecordBatch.from_pydict({"key": np.array([key]), "block": np.array([block_], np.int32), "v": pa.array([row.tobytes()], pa.binary())})
            key, block_, row = k[-1], b[-1], square[-1]
            yield pa.RecordBatch.from_pydict({"key": k[cuts[:-1]], "block": b[cuts[:-1]].astype(np.int32), "v": pa.array([r.tobytes() for r in square[:-1]], pa.binary())})
        if row is not None:
            yield pa.RecordBatch.from_pydict({"key": np.array([key]), "block": np.array([block_], np.int32), "v": pa.array([row.tobytes()], pa.binary())})

    rows = cells.repartition("key").sortWithinPartitions("key", "block").mapInArrow(packed, "key long, block int, v binary")
    shares = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // len(pairs)))
    table = F.broadcast(spark.createDataFrame([(n, i, j) for n, (i, j) in enumerate(pairs)], "pair int, i int, j int"))  # pairs of blocks
    left = rows.join(table, F.col("block") == F.col("i")).select("pair", "key", F.lit(0).alias("side"), "v")
    if any(i != j for i, j in pairs):
        left = left.unionByName(rows.join(table, (F.col("block") == F.col("j")) & (F.col("i") != F.col("j"))).select("pair", "key", F.lit(1).alias("side"), "v"))
    dealt = left.withColumn("cell", (F.col("pair") * shares + F.pmod("key", F.lit(shares))).cast("int")).repartitionById(len(pairs) * shares, F.col("cell")).sortWithinPartitions("cell", "key", "side")
    alone = [i == j for i, j in pairs]

    def product(batches):
        def squares(cell, total):
            if total is not None:
                at = np.arange(width, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"pair": np.full(width, cell // shares, np.int32), "p": at, "v": pa.array([r.tobytes() for r in total], pa.binary())})

        cell, total, waiting = None, None, None
        for batch in batches:
            c, key, side = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "key", "side"))
            v = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, width)
            for at in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c)) + 1):
                if not len(at):
                    continue
                if c[at[0]] != cell:
                    yield from squares(cell, total)
                    cell, total, waiting = int(c[at[0]]), np.zeros((width, width)), None
                if alone[cell // shares]:
                    total += v[at].T @ v[at]
                    continue
                k, s, m = key[at], side[at], v[at]
                if waiting is not None:
                    k, s, m = np.r_[waiting[0], k], np.r_[0, s], np.concatenate([waiting[1][None], m])
                first = np.flatnonzero((s[:-1] == 0) & (s[1:] == 1) & (k[:-1] == k[1:]))
                total += m[first].T @ m[first + 1]
                waiting = (k[-1], m[-1].copy()) if s[-1] == 0 else None
        yield from squares(cell, total)

    def edges(batches):
        def of(pair, p, sums):
            i, j = pairs[pair]
            q = np.flatnonzero(sums > threshold)
            q = q[j * width + q > i * width + p]
            return np.full(len(q), i * width + p), j * width + q, sums[q]

        here, sums = None, None
        for batch in batches:
            out = []
            for pair, p, v in zip(*(batch.column(n).to_pylist() for n in ("pair", "p", "v"))):
                if (pair, p) != here:
                    if here:
                        out.append(of(*here, sums))
                    here, sums = (pair, p), np.zeros(width)
                sums = sums + np.frombuffer(v)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip("pqr", map(np.concatenate, zip(*out)))))
        if here:
            yield pa.RecordBatch.from_pydict(dict(zip("pqr", of(*here, sums))))

    parts = dealt.mapInArrow(product, "pair int, p int, v binary")
    found = parts.repartition("pair", "p").sortWithinPartitions("pair", "p").mapInArrow(edges, "p long, q long, r double")
    one, two = (F.broadcast(names.select(F.col("at").alias(x), F.col("name").alias(y))) for x, y in (("p", "a"), ("q", "b")))  # a row per feature
    ends = found.join(one, "p").join(two, "q")
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r")


def correlation_groups(dense: DataFrame, threshold: float = 0.90, many: bool = True) -> DataFrame:
    """component, feature (the one of largest std) and members, for every connected group of correlated features.

    many=False takes the self-join instead of block products: simpler for few features. Features without a partner are groups of one.
    """
    from residua.operators.graph import components

    edges = (gram_pairs if many else correlated_pairs)(dense, threshold).select("a", "b")
    features = dense.select("feature").distinct()
    comp = components(edges)
    groups = features.join(comp.withColumnRenamed("node", "feature"), "feature", "left").withColumn("component", F.coalesce("component", "feature"))
    return representatives(groups, feature_statistics(dense))


def mean_groups(stats: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """feature, leader: features in order of id join the first earlier leader whose mean is within the tolerance.

    Means more than a tolerance apart in sorted order can't share a leader, so runs of
    occupied buckets of twice the tolerance are independent and go to tasks one by one.
    Leaders are over a tolerance apart from each other, so only a few in sorted order can
    be near a mean, however many there are.
    """
    import pandas as pd

    rows = stats.where(F.col("mean").isNotNull()).select("feature", "mean").withColumn("bucket", F.floor(F.col("mean") / (2 * tolerance)))
    used = rows.select("bucket").distinct()
    island = used.withColumn("island", F.col("bucket") - F.row_number().over(Window.orderBy("bucket")))  # at most a row per feature

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        means, leaders, out = [], [], []  # leaders by mean; features come in the order of their ids, so the first leader has the least
        for feature, mean in pdf.sort_values("feature")[["feature", "mean"]].itertuples(index=False):
            low, high = bisect.bisect_left(means, mean - 2 * tolerance), bisect.bisect_right(means, mean + 2 * tolerance)
            leader = min((leaders[k] for k in range(low, high) if abs(mean - means[k]) <= tolerance), default=None)
            if leader is None:
                at = bisect.bisect_left(means, mean)
                means.insert(at, mean)
                leaders.insert(at, feature)
                leader = feature
            out.append((feature, leader))
        return pd.DataFrame(out, columns=["feature", "component"])

    return rows.join(island, "bucket").groupBy("island").applyInPandas(greedy, "feature long, component long")


def same_mean_groups(dense: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """component, feature (of largest std) and members of each group of equal means."""
    stats = feature_statistics(dense)
    return representatives(mean_groups(stats, tolerance), stats)


def f_to_p(scores: DataFrame) -> DataFrame:
    """scores (f, n, k) with p: the upper tail of the F distribution, by the regularised incomplete beta function."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def tail(f: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_f_tail(x, a - 1, b - a) if np.isfinite(x) and b > a > 1 else (np.nan if np.isnan(x) else 1.0) for x, b, a in zip(f, n, k)])

    return scores.withColumn("p", tail("f", "n", "k"))


def _f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) by numerical integration of the beta density (Gauss-Legendre after a square-root map)."""
    import math

    import numpy as np

    if f <= 0:
        return 1.0
    a, b = d2 / 2, d1 / 2
    x = d2 / (d2 + d1 * f)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    nodes, weights = np.polynomial.legendre.leggauss(400)
    if x < 0.5:
        t = (nodes + 1) / 2  # u = x t^2
        u = x * t * t
        log_density = (a - 1) * np.log(u) + (b - 1) * np.log1p(-u) - log_beta
        return float(np.clip((np.exp(log_density) * x * t * weights).sum(), 0, 1))
    t = (nodes + 1) / 2
    u = 1 - (1 - x) * t * t
    log_density = (a - 1) * np.log(u) + (b - 1) * np.log((1 - x) * t * t) - log_beta
    return float(np.clip(1 - (np.exp(log_density) * (1 - x) * t * weights).sum(), 0, 1))


def selection_chain(pairs: DataFrame, large: float = 50.0, correlation: float = 0.90, tolerance: float = 0.01, variance: float = 0.1, top: int = 300) -> tuple[DataFrame, DataFrame]:
    """Masking, missing values, neighbours, correlation, equal means, variance, F score, imputation, in that order.

    pairs: structure, feature, pos1, pos2, label, value (a row for every structure and
    feature). Each step gives the ids that survive; the long table is only semi-joined.
    Returns the long table and the funnel (step, features).
    """
    from residua.operators.features import imputed
    from residua.operators.graph import written

    steps = []

    def count(name: str, ids: DataFrame) -> None:
        steps.append(ids.agg(F.countDistinct("feature").alias("features")).select(F.lit(name).alias("step"), "features"))

    def left(name: str, x: DataFrame, ids: DataFrame) -> DataFrame:
        """x cut to the ids, which are written (a row per feature), so no later step works them out again."""
        ids = written(ids.select("feature"))
        count(name, ids)
        return keep_features(x, ids)

    labels = pairs.select("structure", "label").distinct()
    count("all", pairs)
    x = written(without_neighbours(drop_missing(mask_large(pairs, large))))
    count("cleaned", x)
    plain = lambda: x.select("structure", "feature", "value")
    x = left("correlation", x, correlation_groups(plain(), correlation))
    x = left("equal means", x, same_mean_groups(plain(), tolerance))
    x = left("variance", x, low_variance(feature_statistics(x), variance))
    x = left("f score", x, top_features(anova_f(x), top))
    out = imputed(x.select("structure", "feature", "value")).join(labels, "structure")
    funnel = steps[0]
    for s in steps[1:]:
        funnel = funnel.unionByName(s)
    return out, funnel
