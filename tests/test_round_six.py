"""Rows of the grid are written once, sampled once for all classifiers and fitted in parts by their size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt.operators import metrics as met
from classtilt.operators import prepare as prep
from classtilt.operators import resample as rs
from classtilt.operators import train as fit

PARAMS = {"logistic_regression": {"maxIter": 5}, "random_forest": {"numTrees": 3}}


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * y + i, y, [float(v) for v in rng.normal(y, 1.0, 2)]) for y, n in enumerate((40, 17, 23)) for i in range(n)]
    return prep.prep_kfold(spark.createDataFrame(rows, "id long, y int, x array<double>"), [], "id", "y", 2, 0).cache()


def cells(*pairs):
    return [
        {"dataset": "d", "seed": 3, "fold": f, "classifier": c, "condition": k, "feature_type": "numeric"} for f in (0, 1) for c, k in pairs
    ]


def scores(result):
    good, bad = result
    assert bad.count() == 0
    return {(r.fold, r.classifier, r.condition): r.multiclass_log_loss for r in good.collect()}


def test_under_sampling_by_cuts(folds, rows):
    cuts = rs.rs_under_cuts(folds, [0, 1], 3)
    for part in (0, 1):
        train = folds.filter(folds.fold != part).drop("fold")
        assert rows(rs.rs_under_by_cuts(train, cuts[part], 3), "id", "y", "x") == rows(rs.rs_random_under(train, [], 3), "id", "y", "x")


def test_a_training_part_is_prepared_once(folds, monkeypatch):
    sampled, parts, resample, fit_one = [], [], fit.resample, fit._fit

    def counted(train, condition, **how):
        sampled.append(condition)
        return resample(train, condition, **how)

    def watched(model, train, *rest):
        parts.append(train.rdd.getNumPartitions())
        return fit_one(model, train, *rest)

    wanted = cells(*[(c, k) for c in PARAMS for k in ("random_over", "random_under")])
    alone = fit.run_cell(folds, 3, PARAMS, wanted[-1])
    monkeypatch.setattr(fit, "resample", counted)
    monkeypatch.setattr(fit, "_fit", watched)
    first = scores(fit.grid_run(folds.repartition(7), wanted, 3, PARAMS, pool=2))
    # Two folds; under-sampling needs no plan per fold.
    assert sampled == ["random_over"] * 2 and parts == [1] * 8
    assert first[1, "random_forest", "random_under"] == pytest.approx(alone["multiclass_log_loss"])
    # Trees draw the same rows whatever parts the rows come in.
    assert scores(fit.grid_run(folds.repartition(3), wanted, 3, PARAMS, pool=2)) == pytest.approx(first)


def test_rows_that_cannot_be_written(folds, monkeypatch):
    wanted = cells(("logistic_regression", "raw"), ("logistic_regression", "random_under"))
    named = folds.selectExpr("*", "'d' as dataset", "3 as seed")
    together = scores(fit.grid_run(named, wanted, 3, PARAMS, pool=1))

    def broken(*_):
        raise ValueError("no room")

    monkeypatch.setattr(fit, "_store", broken)
    assert scores(fit.grid_run(named, wanted, 3, PARAMS, pool=1)) == pytest.approx(together)


def test_bundle_without_thresholds(spark, rows):
    pred = spark.createDataFrame([(i % 2, i % 3 % 2, [(i * 7 % 10 + 1) / 12, 1 - (i * 7 % 10 + 1) / 12]) for i in range(24)], "fold int, y int, p array<double>")
    plain = met.met_bundle(pred, ["fold"], 2)
    zeros = met.met_bundle(pred, ["fold"], 2, F.array(F.lit(0.0), F.lit(0.0)))
    assert plain.columns == zeros.columns and rows(plain) == rows(zeros)

    def ranges(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(p")

    # The running sums of average precision stand in the plan once.
    assert ranges(plain) == ranges(met.met_ap(pred, ["fold"])) > 0
