"""Feature statistics, selection and imputation over long feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import classify, features, report
from residua.operators import selection as sel
from residua.plans.registry import LONG, Registry, embedding_features, line_points, load

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.query

ANOVA = """,
g AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_pop(value) * count(value) AS ss FROM l WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
t AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL),
f AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * (m - gm) * (m - gm)) AS between_ss, sum(ss) AS within_ss FROM g JOIN t USING (feature) GROUP BY ALL),
s AS (SELECT feature, (between_ss / (k - 1)) / (within_ss / (n - k)) AS f FROM f)"""
STATS = ", st AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, count(value) AS n FROM l GROUP BY ALL)"
MASKED = ", m AS (SELECT structure, feature, label, CASE WHEN value <= 0.15 THEN value END AS value FROM l)"


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.mask_large(embedding_features(spark, sf_dir), 0.15)


def pairs_of(long: DataFrame) -> DataFrame:
    """Dimensions as position pairs: feature 8i + j is (i, j + 8)."""
    return long.withColumns({"pos1": (F.col("feature") / 8).cast("int"), "pos2": (F.col("feature") % 8 + 4).cast("int")})


@query(LONG + ANOVA + " SELECT feature, round(f, 6) AS f FROM s ORDER BY f DESC, feature LIMIT 10")
def anova_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sel.anova_f(embedding_features(spark, sf_dir))
    return sel.top_features(f, 10).select("feature", F.round("f", 6).alias("f"))


@query(LONG + STATS + " SELECT feature, round(mean, 8) AS mean, round(std, 8) AS std, round(variance, 8) AS variance, n FROM st")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sel.feature_statistics(embedding_features(spark, sf_dir))
    return s.select("feature", *[F.round(c, 8).alias(c) for c in ("mean", "std", "variance")], "n")


@query(LONG + ", q AS (SELECT feature, round(median(value), 8) AS median FROM l GROUP BY ALL) SELECT * FROM q")
def feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_medians(embedding_features(spark, sf_dir)).select("feature", F.round("median", 8).alias("median"))


@query(LONG + " SELECT structure, feature, round(value, 8) AS value FROM l WHERE value > 0.3 ORDER BY value DESC, structure, feature LIMIT 50")
def large_values_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.large_values(embedding_features(spark, sf_dir), 0.3, 50).select("structure", "feature", F.round("value", 8).alias("value"))


@query(LONG + " SELECT feature, count(*) FILTER (value > 0.2) AS n_large, count(*) FILTER (value <= 0.2) AS n_left FROM l GROUP BY feature HAVING count(*) FILTER (value > 0.2) > 0 ORDER BY n_large DESC, feature LIMIT 10")
def large_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.large_by_feature(embedding_features(spark, sf_dir), 0.2)


@query(LONG + MASKED + """, fk AS (SELECT feature FROM m GROUP BY feature HAVING avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) <= 0.12),
x AS (SELECT m.* FROM m SEMI JOIN fk USING (feature)), sk AS (SELECT structure FROM x GROUP BY structure HAVING avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) <= 0.15)
SELECT structure, count(*) AS n, count(value) AS n_values FROM x SEMI JOIN sk USING (structure) GROUP BY structure""")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masked(spark, sf_dir)
    features_left = sel.drop_missing(m, 1.0).groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("s")).where("s <= 0.12")
    x = sel.keep_features(m, features_left)
    kept = x.groupBy("structure").agg(F.avg(F.col("value").isNull().cast("int")).alias("s")).where("s <= 0.15")
    return x.join(kept, "structure", "left_semi").groupBy("structure").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


@query(LONG + MASKED + """ SELECT 'before' AS step, count(DISTINCT structure) AS structures, count(DISTINCT feature) AS features, count(value) AS "values" FROM l
UNION ALL SELECT 'masked', count(DISTINCT structure), count(DISTINCT feature), count(value) FROM m
UNION ALL SELECT 'reduced', count(DISTINCT structure), count(DISTINCT feature), count(value) FROM m""")
def cleanup_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.cleanup(embedding_features(spark, sf_dir), 0.15)[1]


@query(LONG + MASKED + """, md AS (SELECT feature, median(value) AS fill FROM m GROUP BY ALL)
SELECT structure, feature, round(coalesce(value, fill), 8) AS value, value IS NULL AS imputed FROM m JOIN md USING (feature)""")
def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.imputed(masked(spark, sf_dir).drop("label")).select("structure", "feature", F.round("value", 8).alias("value"), "imputed")


@query(LONG + MASKED + " SELECT count(*) AS total, count(value) AS measured, count(*) - count(value) AS imputed, round(100.0 * (count(*) - count(value)) / count(*), 6) AS imputed_pct FROM m")
def imputation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.imputation_summary(features.imputed(masked(spark, sf_dir), "zero"))
    return s.withColumn("imputed_pct", F.round("imputed_pct", 6))


@query(LONG + """, s AS (SELECT structure, feature, label, value FROM l WHERE value <= 0.15), st AS (SELECT DISTINCT structure, label FROM s),
md AS (SELECT feature, median(value) AS fill FROM s GROUP BY ALL), fe AS (SELECT DISTINCT feature FROM s)
SELECT st.structure, fe.feature, st.label, round(coalesce(s.value, md.fill), 8) AS value, s.value IS NULL AS imputed
FROM st CROSS JOIN fe LEFT JOIN s ON s.structure = st.structure AND s.feature = fe.feature JOIN md ON md.feature = fe.feature""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = masked(spark, sf_dir).where("value is not null")
    return features.feature_matrix(measured).select("structure", "feature", "label", F.round("value", 8).alias("value"), "imputed")


@query(LONG + """, c AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.structure = b.structure AND a.feature < b.feature GROUP BY ALL)
SELECT a, b, round(r, 6) AS r FROM c WHERE r > 0.05""")
def correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.correlated_pairs(embedding_features(spark, sf_dir).drop("label"), 0.05).select("a", "b", F.round("r", 6).alias("r"))


@query(LONG + """, c AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.structure = b.structure AND a.feature < b.feature GROUP BY ALL)
SELECT a, b, round(r, 6) AS r FROM c WHERE r > 0.05""")
def correlated_pairs_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.gram_pairs(embedding_features(spark, sf_dir).drop("label"), 0.05, block=16).select("a", "b", F.round("r", 6).alias("r"))


@query(LONG.replace("WITH l", "WITH RECURSIVE l") + STATS + """, c AS (SELECT a.feature AS a, b.feature AS b FROM l a JOIN l b ON a.structure = b.structure AND a.feature < b.feature GROUP BY ALL HAVING corr(a.value, b.value) > 0.1),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r(node, root) AS (SELECT feature, feature FROM st UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
g AS (SELECT node AS feature, min(root) AS component FROM r GROUP BY node)
SELECT component, arg_max(feature, std) AS feature, count(*) AS members FROM g JOIN st USING (feature) GROUP BY component""")
def correlation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.correlation_groups(embedding_features(spark, sf_dir).drop("label"), 0.1)


@query(LONG.replace("WITH l", "WITH RECURSIVE l") + STATS + """, r AS (SELECT feature, mean, std, row_number() OVER (ORDER BY feature) AS k FROM st WHERE mean IS NOT NULL),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(f BIGINT, m DOUBLE)[]) AS leaders, CAST(NULL AS BIGINT) AS feature, CAST(NULL AS BIGINT) AS component UNION ALL
  SELECT r.k, CASE WHEN len(near) > 0 THEN leaders ELSE list_append(leaders, struct_pack(f := CAST(r.feature AS BIGINT), m := r.mean)) END, r.feature, CASE WHEN len(near) > 0 THEN near[1].f ELSE r.feature END
  FROM (SELECT g.k + 1 AS k, leaders, list_filter(leaders, lambda l: abs(l.m - r0.mean) <= 0.002) AS near FROM g JOIN r r0 ON r0.k = g.k + 1) x JOIN r USING (k)),
s AS (SELECT component, r.feature, r.std FROM g JOIN r USING (feature))
SELECT component, arg_max(feature, std) AS feature, count(*) AS members FROM s GROUP BY component""")
def same_mean_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.same_mean_groups(embedding_features(spark, sf_dir).drop("label"), 0.002)


@query(LONG + STATS + " SELECT feature FROM st WHERE variance > 0.0155")
def low_variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.low_variance(sel.feature_statistics(embedding_features(spark, sf_dir)), 0.0155)


@query(LONG + " SELECT label, feature, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std, count(value) AS n FROM l GROUP BY ALL")
def class_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report.class_statistics(embedding_features(spark, sf_dir))
    return s.select("label", "feature", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "n")


@query(LONG + " SELECT label, CAST(least(floor((value + 0.5) / (1.0 / 30)), 29) AS INT) AS bin, count(*) AS n FROM l WHERE value BETWEEN -0.5 AND 0.5 GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(embedding_features(spark, sf_dir), "value", -0.5, 0.5, 30, ["label"])


@query("WITH e AS (SELECT CAST(label AS STRING) AS label, vec_id FROM embeddings) SELECT CASE WHEN label = '-1' THEN 'Unlabelled' ELSE label END AS label, count(*) * 64 AS n_rows, count(DISTINCT vec_id) AS n_structures FROM e GROUP BY ALL")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.label_distribution(embedding_features(spark, sf_dir))


@query(LONG + """, p AS (SELECT DISTINCT feature // 8 AS a, feature % 8 + 4 AS b FROM l), q AS (SELECT DISTINCT least(a, b) AS pos1, greatest(a, b) AS pos2 FROM p)
SELECT pos1, pos2, row_number() OVER (ORDER BY pos1, pos2) - 1 AS feature FROM q""")
def pair_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_dictionary(pairs_of(embedding_features(spark, sf_dir)))


@query(LONG + " SELECT count(*) AS n, count(DISTINCT feature) AS features FROM l WHERE abs((feature % 8 + 4) - feature // 8) <> 1")
def without_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sel.without_neighbours(pairs_of(embedding_features(spark, sf_dir)))
    return x.agg(F.count("*").alias("n"), F.countDistinct("feature").alias("features"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, (SELECT min(n) FROM c) AS n FROM c""")
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure"), "label")
    return sel.balanced(rows).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'train' AS part, CAST(round(n * 0.9) AS BIGINT) AS n FROM n UNION ALL SELECT 'valid', n - CAST(round(n * 0.9) AS BIGINT) FROM n""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure"))
    maps = classify.index_maps(*classify.split_rows(rows))
    return maps.groupBy("part").agg(F.count("*").alias("n"))


PAIRS = """WITH q AS (SELECT l_orderkey AS structure, l_linenumber AS pos, min(l_quantity) AS x, min(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY ALL)"""


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("pos")).agg(F.min("l_quantity").alias("x"), (F.min("l_extendedprice") / 1000).alias("y"))


@query(PAIRS + """ SELECT a.structure, a.pos AS pos1, b.pos AS pos2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS value
FROM q a JOIN q b ON a.structure = b.structure AND a.pos < b.pos""")
def residue_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.residue_pairs(order_positions(spark, sf_dir))
    d = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return pairs.select("structure", "pos1", "pos2", F.round(d, 6).alias("value"))


@query("""WITH a AS (SELECT l_orderkey AS structure, l_linenumber AS pos, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS z FROM lineitem)
SELECT a.structure, a.pos AS pos1, b.pos AS pos2, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) AS value
FROM a JOIN a b ON a.structure = b.structure AND a.pos < b.pos GROUP BY ALL""")
def least_residue_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    atoms = li.select(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("pos"), F.lit("CB").alias("atom"), F.lit("ALA").alias("resname"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("z"))
    pairs = features.residue_pairs(features.residue_points(atoms).drop("resname"))
    return features.least_distances(pairs).select("structure", "pos1", "pos2", F.round("value", 6).alias("value"))


@query("""SELECT l_orderkey AS structure FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3""")
def complete_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("pos"))
    return features.complete_structures(rows, rows.select("pos").where("pos <= 3"))


@query(PAIRS + """, d AS (SELECT a.structure, a.pos AS i, b.pos AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS value FROM q a JOIN q b USING (structure))
SELECT * FROM d WHERE structure IN (SELECT structure FROM q GROUP BY 1 HAVING count(*) > 1)""")
def symmetric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.symmetric_matrix(residue_pair_distances(spark, sf_dir))


@query(PAIRS + """, d AS (SELECT round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS value FROM q a JOIN q b ON a.structure = b.structure AND a.pos < b.pos)
SELECT round(min(value), 6) AS low, round(quantile_cont(value, 0.95), 5) AS high FROM d""")
def heat_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.heat_scale(residue_pair_distances(spark, sf_dir)).select(F.round("low", 6).alias("low"), F.round("high", 5).alias("high"))


@query(LONG + """, s AS (SELECT feature, sum(value) AS importance FROM l GROUP BY feature), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM s)
SELECT feature, round(importance, 6) AS importance, rank FROM r WHERE importance > 0 AND rank <= 20""")
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embedding_features(spark, sf_dir).groupBy("feature").agg(F.sum("value").alias("importance"))
    return report.ranking(s).select("feature", F.round("importance", 6).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query(LONG + ANOVA + ", t10 AS (SELECT feature FROM s ORDER BY f DESC, feature LIMIT 10) SELECT DISTINCT unnest([feature // 8, feature % 8 + 4]) AS pos FROM t10")
def touched_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.touched_positions(pairs_of(sel.top_features(sel.anova_f(embedding_features(spark, sf_dir)), 10)))
