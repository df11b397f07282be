"""How catalog modules register a query with the SQL that gives the same rows, and the tables they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (structure, label, feature, value): one row per vector and dimension."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("structure"), "label", F.posexplode("embedding").alias("feature", "v")).select("structure", "label", "feature", F.col("v").cast("double").alias("value"))


#: The same long table in SQL.
LONG = """WITH l AS (SELECT vec_id AS structure, label, u.i - 1 AS feature, CAST(embedding[u.i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)"""


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of paths: an order's lines, numbered with a full tie-break."""
    li = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("structure"), (F.row_number().over(order) - 1).alias("ord"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 10).alias("z"))


POINTS = """WITH p AS (SELECT l_orderkey AS structure, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS ord,
  l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 10 AS z FROM lineitem)"""


def sign_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows (name, ord, aligned): a letter per positive dimension of a vector, else a gap."""
    e = load(spark, sf_dir, "embeddings")
    letters = F.transform("embedding", lambda v, i: F.when(v > 0, F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), i % 20 + 1, F.lit(1))).otherwise("-"))
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("vec_id").alias("ord"), F.array_join(letters, "").alias("aligned"))


#: a: name, aligned. z: every row against the reference v0.
ALIGNED = """WITH l AS (SELECT 'v' || vec_id AS name, u.i AS i, CASE WHEN embedding[u.i] > 0 THEN substr('ACDEFGHIKLMNPQRSTVWY', ((u.i - 1) % 20) + 1, 1) ELSE '-' END AS ch
  FROM embeddings, (SELECT CAST(unnest(range(1, 65)) AS INT) AS i) u),
a AS (SELECT name, string_agg(ch, '' ORDER BY i) AS aligned FROM l GROUP BY ALL),
c AS (SELECT i, ch AS ref_ch, row_number() OVER (ORDER BY i) - 1 AS ref_pos FROM l WHERE name = 'v0' AND ch <> '-'),
z AS (SELECT name, ref_pos, ref_ch, ch FROM l JOIN c USING (i))"""
