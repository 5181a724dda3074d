import math

import pytest
from pyspark.sql import functions as F

from classtilt import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "df", "p"), [(24.0, 8, 0.002292), (20.511, 7, 0.004566), (13.749, 7, 0.055830)])
def test_chi2_published_values(spark, x, df, p):
    assert one(spark, fn.fn_chi2_sf(F.lit(x), F.lit(df))) == pytest.approx(p, abs=1e-6)


def test_chi2_large_and_zero(spark):
    assert one(spark, fn.fn_chi2_sf(F.lit(400.0), F.lit(3))) == pytest.approx(0.0, abs=1e-12)
    assert one(spark, fn.fn_chi2_sf(F.lit(0.0), F.lit(3))) == 1.0


@pytest.mark.parametrize("z", [-7.5, -3.0, -0.2, 0.0, 1.959963985, 6.0, 9.0])
def test_normal_distribution(spark, z):
    want = 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert one(spark, fn.fn_norm_cdf(F.lit(z))) == pytest.approx(want, abs=1e-12)


def test_studentised_range_published_value(spark):
    q = 8.0 / math.sqrt(9 * 10 / 18.0) * math.sqrt(2.0)
    assert one(spark, fn.fn_range_sf(F.lit(q), F.lit(9))) == pytest.approx(0.010464, abs=1e-6)


def test_signed_rank_null_counts(spark):
    counts = one(spark, fn.fn_signed_rank_null(F.lit(4)))
    assert counts == [1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1]


def test_rank_sum_tail(spark):
    nine = F.array(*[F.lit(float(i)) for i in range(1, 10)])
    assert one(spark, fn.rank_sum_tail(nine, F.lit(0.0))) == pytest.approx(2 / 2**9)
    three = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, fn.rank_sum_tail(three, F.lit(6.0))) == 0.25


@pytest.mark.parametrize("q", [0.25, 0.5, 0.9])
def test_exact_quantile_equals_percentile(spark, q):
    df = spark.range(5003).select(
        (F.col("id") % 3).alias("g"),
        F.sin("id").alias("v"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 10).cast("double").alias("w"),
    )
    got = {(r["g"], r["column"]): r["value"] for r in fn.exact_quantile(df, ["g"], ["v", "w"], q).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", q).alias("v"), F.percentile("w", q).alias("w")).collect():
        assert got[(r["g"], "v")] == pytest.approx(r["v"], abs=1e-12)
        assert got[(r["g"], "w")] == pytest.approx(r["w"], abs=1e-12)


def test_number_by_hash_equals_row_number(spark, rows):
    df = spark.range(3000).select("id", (F.col("id") % 10 > 2).alias("g")).withColumn("h", fn.order_hash(1, F.col("id")))
    mine = rows(fn.number_by_hash(df, ["g"], "h", "id", "n", digits=2), "id", "n")
    df.createOrReplaceTempView("numbered")
    assert mine == rows(spark.sql("select id, row_number() over (partition by g order by h, id) n from numbered"))


def test_explode_counts_is_whole(spark):
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 12)], "g string, n bigint")
    got = fn.explode_counts(df, "n", "j", chunk=5).groupBy("g").agg(F.count("*"), F.min("j"), F.max("j"), F.countDistinct("j"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 7, 1, 7, 7), ("c", 12, 1, 12, 12)]
