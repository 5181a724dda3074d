"""Samplers on tiny classes, distribution tails against published values, redaction of nested JSON, namesakes across bands."""

import json

import pytest
from pyspark.sql import functions as F

from classtilt.functions.distributions import fn_chi2_sf, fn_norm_cdf
from classtilt.operators import audit, provenance, resample


def train(spark, sizes):
    rows = [(100 * y + i, y, [float(i), float(y) + 0.1 * i * i], ["a", "b"][: 1 + 0 * i]) for y, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, x array<double>, cats array<string>")


@pytest.mark.parametrize("sizes", [(10, 2), (10, 3, 2), (10, 4, 9)])
@pytest.mark.parametrize("mixed", [False, True])
def test_small_classes_reach_their_count(spark, sizes, mixed):
    rows = train(spark, sizes)
    grown = resample.rs_smotenc(rows, [], 3, 0) if mixed else resample.rs_smote(rows.drop("cats"), [], 3, 0)
    assert {r.y: r["count"] for r in grown.groupBy("y").count().collect()} == {y: 10 for y in range(len(sizes))}


def test_a_class_of_one_row_is_an_error(spark):
    with pytest.raises(Exception, match="fewer than two training examples"):
        resample.rs_smote(train(spark, (10, 1)).drop("cats"), [], 3, 0).collect()


def test_tails(spark):
    # Published upper tails: chi-square (x, df) and the normal distribution.
    chi = [(120.0, 8, 3.2998684e-22), (3.841458820694124, 1, 0.05), (15.507313055865453, 8, 0.05), (23.6847913048, 14, 0.05), (124.342113404, 100, 0.05), (0.0, 3, 1.0)]
    for r, (_, _, want) in zip(spark.createDataFrame(chi, "x double, df int, w double").coalesce(1).select(fn_chi2_sf(F.col("x"), F.col("df")).alias("p")).collect(), chi, strict=True):
        assert r.p == pytest.approx(want, rel=2e-3 if want < 1e-20 else 1e-9)
    normal = [(-9.0, 1.1285884059538408e-19), (-1.959963984540054, 0.025), (-3.0, 0.0013498980316300933), (0.0, 0.5), (2.5758293035489004, 0.995), (9.0, 1.0), (-2.5, 0.006209665325776132)]
    for r, (_, want) in zip(spark.createDataFrame(normal, "z double, w double").coalesce(1).select(fn_norm_cdf(F.col("z")).alias("p")).collect(), normal, strict=True):
        assert r.p == pytest.approx(want, rel=1e-10)


def test_nested_values_are_redacted(spark):
    bodies = ['{"git_head": {"sha": "abc"}, "n": 1}', '{"source_commit": ["x", "y"], "a": {"GIT_HEAD" : "z"}}', '{"n": 2}', None, '{"git_head": broken']
    got = [r.b for r in provenance.txt_json_redact(spark.createDataFrame([(b,) for b in bodies], "b string").coalesce(1), "b").collect()]
    assert json.loads(got[0]) == {"git_head": None, "n": 1} and json.loads(got[1]) == {"source_commit": None, "a": {"GIT_HEAD": None}}
    assert got[2] == bodies[2] and got[3] is None and "broken" not in got[4]


def test_a_namesake_in_another_band_does_not_shadow(spark):
    rows = [(5, "same", "numeric", "A"), (9, "Same", "numeric", "B"), (11, "other", "mixed", "A")]
    catalog = spark.createDataFrame(rows, "data_id long, name string, feature_type string, band string")
    picked = audit.sel_quota(catalog, [], [], {"numeric": 1, "mixed": 1}, {"B": 1}, 2)
    assert [r.data_id for r in picked.collect()] == [9, 11]
