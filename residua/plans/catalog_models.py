"""Reduction, clustering and classification over the embeddings, as stand-ins for resampled paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import classify, cluster, reduce
from residua.operators import selection as sel
from residua.plans import reports
from residua.plans.registry import LONG, Registry, embedding_features, load

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.query


def projected(spark: SparkSession, sf_dir: str, k: int = 8):
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("coords"))
    return reduce.principal_components(rows, k)


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z1, z2: the first two components, in tenths."""
    _, rows = projected(spark, sf_dir, 2)
    return rows.select(F.col("structure").alias("id"), (F.get("pc", F.lit(0)) * 10).alias("z1"), (F.get("pc", F.lit(1)) * 10).alias("z2"))


@query()
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = projected(spark, sf_dir)
    return reduce.explained_percent(model, rows)


@query()
def loading_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = projected(spark, sf_dir)
    return reduce.loading_profile(model, rows)


@query()
def component_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.component_values(projected(spark, sf_dir)[1], 1)


@query()
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hierarchical(plane(spark, sf_dir), 2).select("id", "cluster")


@query()
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.spectral(plane(spark, sf_dir), 2)


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density(plane(spark, sf_dir), 0.3, 5, 10)


@query()
def reconstruction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reconstruction_errors(*projected(spark, sf_dir, 2))


@query()
def error_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.error_landscape(reduce.reconstruction_errors(*projected(spark, sf_dir, 2)), 10)


def _forest(spark: SparkSession, sf_dir: str):
    long = embedding_features(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))
    best = sel.top_features(sel.anova_f(long), 8)
    rows = classify.wide(sel.keep_features(long, best))
    fit, held = classify.split_rows(rows)
    return rows, held, classify.train_forest(fit, trees=10, maxDepth=5)


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held, model = _forest(spark, sf_dir)
    return classify.predict(model, held).select("structure", "label", "prediction")


@query()
def forest_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, model = _forest(spark, sf_dir)
    return classify.tree_importances(model, rows)


@query()
def forest_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held, model = _forest(spark, sf_dir)
    return classify.permutation_importance(model, held, repeats=3)


@query()
def forest_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held, model = _forest(spark, sf_dir)
    return classify.attributions(model, held)


@query(LONG.replace("WITH l", "WITH RECURSIVE l") + """, m AS (SELECT structure, feature, CASE WHEN value <= 0.5 THEN value END AS value FROM l WHERE abs(feature % 8 + 4 - feature // 8) <> 1),
md AS (SELECT feature, median(value) AS med, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance FROM m GROUP BY 1), i AS (SELECT structure, feature, coalesce(value, med) AS value FROM m JOIN md USING (feature)),
c AS (SELECT a.feature AS a, b.feature AS b FROM i a JOIN i b ON a.structure = b.structure AND a.feature < b.feature GROUP BY ALL HAVING corr(a.value, b.value) > 0.1),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r(node, root) AS (SELECT feature, feature FROM md UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
g AS (SELECT node AS feature, min(root) AS component FROM r GROUP BY node), p1 AS (SELECT arg_max(feature, std) AS feature FROM g JOIN md USING (feature) GROUP BY component),
o AS (SELECT feature, mean, std, row_number() OVER (ORDER BY feature) AS k FROM md SEMI JOIN p1 USING (feature) WHERE mean IS NOT NULL),
h AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(f BIGINT, m DOUBLE)[]) AS leaders, CAST(NULL AS BIGINT) AS feature, CAST(NULL AS BIGINT) AS component UNION ALL
  SELECT o.k, CASE WHEN len(near) > 0 THEN leaders ELSE list_append(leaders, struct_pack(f := CAST(o.feature AS BIGINT), m := o.mean)) END, o.feature, CASE WHEN len(near) > 0 THEN near[1].f ELSE o.feature END
  FROM (SELECT h.k + 1 AS k, leaders, list_filter(leaders, lambda l: abs(l.m - o0.mean) <= 0.0005) AS near FROM h JOIN o o0 ON o0.k = h.k + 1) x JOIN o USING (k)),
p2 AS (SELECT arg_max(o.feature, std) AS feature FROM h JOIN o USING (feature) GROUP BY component), p3 AS (SELECT feature FROM p2 JOIN md USING (feature) WHERE variance > 0.005)
SELECT 'all' AS step, count(DISTINCT feature) AS features FROM l UNION ALL SELECT 'cleaned', count(DISTINCT feature) FROM m UNION ALL SELECT 'correlation', count(*) FROM p1
UNION ALL SELECT 'equal means', count(*) FROM p2 UNION ALL SELECT 'variance', count(*) FROM p3 UNION ALL SELECT 'f score', least(20, count(*)) FROM p3""")
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embedding_features(spark, sf_dir).withColumns({"pos1": (F.col("feature") / 8).cast("int"), "pos2": (F.col("feature") % 8 + 4).cast("int")})
    return sel.selection_chain(long, large=0.5, correlation=0.1, tolerance=0.0005, variance=0.005, top=20)[1]


# Two dimensions have principal components in closed form, so these can be compared with SQL.


def flat_components(spark: SparkSession, sf_dir: str, k: int = 2):
    e = load(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("structure"), F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in (0, 1)]).alias("coords"))
    return reduce.principal_components(rows, k)


FLAT = """WITH p AS (SELECT vec_id AS structure, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM p),
v AS (SELECT mx, my, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2, atan2(2 * b, a - c) / 2 AS t FROM s),
q AS (SELECT structure, x, y, (x - mx) * cos(t) + (y - my) * sin(t) AS z1, abs((y - my) * cos(t) - (x - mx) * sin(t)) / sqrt(2 / 3) AS rmsd FROM p, v)"""


@query(FLAT + " SELECT 1 AS pc, round(100 * l1 / (l1 + l2), 6) AS percent FROM v UNION ALL SELECT 2, round(100 * l2 / (l1 + l2), 6) FROM v")
def flat_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.explained_percent(*flat_components(spark, sf_dir)).select("pc", F.round("percent", 6).alias("percent"))


@query(FLAT + " SELECT 1 AS pc, 0 AS point, round(l1, 8) AS score FROM v UNION ALL SELECT 2, 0, round(l2, 8) FROM v")
def flat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.loading_profile(*flat_components(spark, sf_dir)).select("pc", "point", F.round("score", 8).alias("score"))


@query(FLAT + " SELECT structure, round(abs(z1), 6) AS value FROM q")
def flat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.component_values(flat_components(spark, sf_dir)[1], 1).select("structure", F.round(F.abs("value"), 6).alias("value"))


@query(FLAT + " SELECT structure, round(abs(z1), 6) AS z1, round(rmsd, 6) AS rmsd FROM q")
def flat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reconstruction_errors(*flat_components(spark, sf_dir, 1)).select("structure", F.round(F.abs("z1"), 6).alias("z1"), F.round("rmsd", 6).alias("rmsd"))


@query(FLAT + """, w AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM q), u AS (SELECT CAST(unnest(range(12)) AS INT) AS g),
f AS (SELECT CAST(least(floor((x - lx) / ((hx - lx) / 12)), 11) AS INT) AS gx, CAST(least(floor((y - ly) / ((hy - ly) / 12)), 11) AS INT) AS gy, count(*) AS n, avg(rmsd) AS m, max(rmsd) AS h FROM q, w GROUP BY ALL)
SELECT a.g AS gx, b.g AS gy, coalesce(n, 0) AS n, round(m, 6) AS mean_rmsd, round(h, 6) AS max_rmsd FROM u a CROSS JOIN u b LEFT JOIN f ON f.gx = a.g AND f.gy = b.g""")
def flat_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landscape over the two dimensions themselves, of what one component loses."""
    model, rows = flat_components(spark, sf_dir, 1)
    plane_ = rows.select("structure", F.get("coords", F.lit(0)).alias("z1"), F.get("coords", F.lit(1)).alias("z2"))
    errors = reduce.reconstruction_errors(model, rows).select("structure", "rmsd").join(plane_, "structure")
    return reduce.error_landscape(errors, 12).select("gx", "gy", "n", F.round("mean_rmsd", 6).alias("mean_rmsd"), F.round("max_rmsd", 6).alias("max_rmsd"))


# End-to-end reports


@query()
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the whole report: what each feature is worth by three measures, next to the forest's accuracy."""
    long = embedding_features(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))
    long = sel.keep_features(long, sel.top_features(sel.anova_f(long), 8))
    told = classify.classification_report(long, trees=10, repeats=2, maxDepth=5)
    accuracy = told["predictions"].agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
    measures = told["importances"].select("feature", "importance").join(told["permutation"].select("feature", F.col("mean").alias("loss")), "feature")
    return measures.join(told["ranking"].select("feature", F.col("importance").alias("attribution")), "feature").crossJoin(F.broadcast(accuracy))


@query()
def reduction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the whole report: sizes of both clusterings of the first two components."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure"), F.transform("embedding", lambda v: v.cast("double") * 10).alias("coords"))
    return reports.reduction_report(rows)["sizes"]
