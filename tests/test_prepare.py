import pytest
from pyspark.sql import functions as F

from classtilt.operators import prepare as prep


def test_layout_overrides(spark):
    df = spark.createDataFrame([(1.0, 1, "x")], "numeric double, encoded_category int, target string")
    layout = prep.prep_layout(df.schema, "target", ["encoded_category"])
    assert layout == prep.Layout(("numeric",), ("encoded_category",)) and layout.feature_type == "mixed"
    with pytest.raises(ValueError, match="unknown"):
        prep.prep_layout(df.schema, "target", ["missing"])
    with pytest.raises(ValueError):
        prep.prep_layout(df.schema, "target", ["numeric", "encoded_category"])


def test_medians_use_training_rows_only(spark, rows):
    data = [(1.0, 1.0, 1), (2.0, None, 1), (3.0, 2.0, 1), (2.0, 1.5, 1), (100.0, 90.0, 0), (None, None, 0)]
    df = spark.createDataFrame(data, "x1 double, x2 double, fold int")
    filled, fitted = prep.prep_impute_median(df, ["x1", "x2"], k=2)
    assert rows(fitted.filter("fold = 0"), "column", "median") == [("x1", 2.0), ("x2", 1.5)]
    test = rows(filled.filter("fold = 0 and is_test"), "x1", "x2")
    assert test == [(100.0, 90.0), (2.0, 1.5)]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 0), ("z", 0)], "c string, fold int")
    filled, _ = prep.prep_impute_mode(df, ["c"], k=2)
    assert sorted(r["c"] for r in filled.filter("fold = 0 and is_test").collect()) == ["a", "z"]


def test_scale_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1), (5.0, 1), (7.0, 0)], "x double, fold int")
    scaled, _ = prep.prep_scale(df, ["x"], k=2)
    assert [r["x"] for r in scaled.filter("fold = 0 and is_test").collect()] == [2.0]


def test_unseen_categories(spark, rows):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("z", 0), (None, 0)], "c string, fold int")
    coded, vocab = prep.prep_ordinal(df, ["c"], k=2)
    test = coded.filter("fold = 0 and is_test")
    assert rows(test, "c", "c_code") == [("z", -1), (None, -1)]
    hot = prep.prep_onehot(coded, ["c"], vocab).filter("fold = 0")
    assert rows(hot.filter("is_test"), "c_hot") == [([0.0, 0.0],), ([0.0, 0.0],)]
    assert rows(hot.filter("c = 'b'"), "c_hot") == [([0.0, 1.0],)]


def test_sentinel_does_not_collide(spark, rows):
    df = spark.createDataFrame([("__MISSING__", 1), ("a", 1), ("z", 0)], "c string, fold int")
    coded, vocab = prep.prep_native_vocab(df, ["c"], k=2)
    assert rows(coded.filter("fold = 0 and is_test"), "c") == [("__MISSING__1",)]
    assert rows(vocab.filter("fold = 0"), "category", "code") == [("__MISSING__", 0), ("__MISSING__1", 2), ("a", 1)]


def test_class_weights(spark, rows):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    weights = prep.prep_class_weight(df, [], "y").distinct()
    assert rows(weights, "y", "weight") == [(0, pytest.approx(4 / 6)), (1, 2.0)]


def test_folds_are_stratified_and_nested_folds_stay_inside(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, 0).otherwise(1).alias("y"))
    folds = prep.prep_kfold(df, [], "id", "y", 5, 1)
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    assert {(r["n"], r["s"]) for r in sizes} == {(20, 6)}
    nested = prep.prep_nested_kfold(folds, [], "id", "y")
    check = prep.prep_split_check(folds, nested.drop("fold"), [], "id").collect()
    assert len(check) == 5 and all(r["leaked_rows"] == r["inner_overlap"] == r["outer_overlap"] == 0 for r in check)
    leaked = nested.drop("fold").unionByName(folds.limit(1).select("id", "y", F.col("fold").alias("outer_fold"), F.lit(0).alias("inner_fold")))
    assert prep.prep_split_check(folds, leaked, [], "id").agg(F.sum("leaked_rows")).first()[0] == 1


def test_label_encode_and_paths(spark, rows):
    df = spark.createDataFrame([("d", "b"), ("d", "a"), ("e", "z")], "k string, t string")
    assert rows(prep.prep_label_encode(df, ["k"], "t"), "k", "t", "y") == [("d", "a", 0), ("d", "b", 1), ("e", "z", 0)]
    paths = {(r.model, r.layout, r.condition): r.path for r in prep.prep_path(spark).collect()}
    assert paths[("xgboost", "mixed", "adasyn")] is None
    assert paths[("logistic_regression", "mixed", "smotenc")] == "one_hot_after_fold_local_sampling"


def test_codes_to_labels(spark, rows):
    vocab = spark.createDataFrame([(0, "c", "a", 0), (0, "c", "b", 1), (0, "c", "__MISSING__", 2)], "fold int, column string, category string, code int")
    df = spark.createDataFrame([(0, 0.4), (0, 0.6), (0, 9.0), (0, -3.0)], "fold int, c_code double")
    assert rows(prep.prep_code_to_label(df, ["c"], vocab), "c_code", "c") == [(-3.0, "__MISSING__"), (0.4, "a"), (0.6, "b"), (9.0, "__MISSING__")]
