"""Stand-in inputs derived from the given tables: evaluation records, predictions and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


RECORDS_SQL = """
WITH k AS (
  SELECT l_suppkey % 11 AS di, l_returnflag AS rf, l_partkey % 9 AS ci,
         CAST(l_orderkey % 3 AS int) AS seed, CAST((l_orderkey + l_linenumber) % 5 AS int) AS fold,
         count(*) AS n_rows, avg(l_discount) * 10 AS s1, avg(l_tax) * 12 AS s2, avg(l_quantity) / 50 AS s3,
         avg(CASE WHEN l_linestatus = 'F' THEN l_discount ELSE l_tax END) * 10 AS s4,
         max(l_extendedprice) / 1000 AS secs
  FROM {lineitem} GROUP BY 1, 2, 3, 4, 5),
r AS (
  SELECT concat('d', CAST(di AS string)) AS dataset,
         CASE WHEN di < 9 THEN 'numeric' ELSE 'mixed' END AS feature_type,
         CASE rf WHEN 'A' THEN 'logistic_regression' WHEN 'N' THEN 'random_forest' ELSE 'xgboost' END AS classifier,
         CASE ci WHEN 0 THEN 'raw' WHEN 1 THEN 'class_weighted' WHEN 2 THEN 'random_over' WHEN 3 THEN 'random_under'
                 WHEN 4 THEN CASE WHEN di < 9 THEN 'smote' ELSE 'smotenc' END WHEN 5 THEN 'adasyn'
                 WHEN 6 THEN 'borderline_smote' WHEN 7 THEN 'smoteenn' ELSE 'smotetomek' END AS condition,
         seed, fold, n_rows, s1, s2, s3, s4, secs, (di >= 9 AND ci IN (5, 6)) AS unsupported
  FROM k)
SELECT dataset, feature_type, classifier, condition, seed, fold, n_rows AS train_rows_before_sampling,
       s1 AS macro_f1, s2 AS g_mean, s3 AS mcc, s4 AS balanced_accuracy, {open}s1, s2, s3{close} AS per_class_recall,
       secs AS fit_predict_seconds,
       CASE WHEN unsupported OR n_rows < 6 THEN 'FAILED' ELSE 'VALID' END AS status,
       CASE WHEN unsupported THEN concat(condition, ' is not valid for mixed data in Stage 0')
            WHEN n_rows < 6 AND condition IN ('raw', 'class_weighted') THEN 'fewer than six rows'
            WHEN n_rows < 6 THEN 'No samples will be generated with the provided ratio settings.' END AS error
FROM r
"""

PREDICTIONS_SQL = """
WITH a AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey % 5 AS int) AS fold,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         l_quantity + 1 AS a0, l_discount * 500 + 1 AS a1, l_tax * 600 + 1 AS a2
  FROM {lineitem})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fold, y,
       a0 / (a0 + a1 + a2) AS p0, a1 / (a0 + a1 + a2) AS p1, a2 / (a0 + a1 + a2) AS p2
FROM a
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per dataset, classifier, condition, seed and fold."""

    source = f"parquet.`{sf}/lineitem.parquet`"
    return spark.sql(RECORDS_SQL.format(lineitem=source, open="array(", close=")"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter("status = 'VALID'").drop("error")


def failures(spark: SparkSession, sf: str) -> DataFrame:
    return (
        records(spark, sf)
        .filter("status = 'FAILED'")
        .withColumn(
            "error_type",
            F.when(F.col("error") == "fewer than six rows", "RuntimeError").otherwise("ValueError"),
        )
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Pred[fold, id columns, y, p]: three classes, probabilities sum to 1."""

    source = f"parquet.`{sf}/lineitem.parquet`"
    rows = spark.sql(PREDICTIONS_SQL.format(lineitem=source))
    return rows.withColumn("p", F.array("p0", "p1", "p2"))


def numeric_train(spark: SparkSession, sf: str) -> DataFrame:
    """Train[id, y, x] from ``embeddings``."""

    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x")
    )


def mixed_train(spark: SparkSession, sf: str) -> DataFrame:
    """Train[id, y, x, cats] from ``orders``: one numeric and one categorical feature, five classes."""

    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("y"),
        F.array("o_totalprice").alias("x"),
        F.array("o_orderstatus").alias("cats"),
    )
