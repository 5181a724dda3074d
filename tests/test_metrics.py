import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt.operators import metrics as met
from classtilt.operators import thresholds as thr


def predictions(spark, rows):
    return spark.createDataFrame([(0, i, y, p) for i, (y, p) in enumerate(rows)], "cell int, id int, y int, p array<double>")


def hard(spark, pairs):
    return spark.createDataFrame([(0, y, h) for y, h in pairs], "cell int, y int, yhat int")


def test_gmean_is_zero_when_a_recall_is_zero(spark):
    conf = met.met_confusion(hard(spark, [(0, 0), (1, 0), (2, 1), (2, 1)]), ["cell"], 3)
    assert met.met_gmean(conf, ["cell"]).first()["value"] == 0.0
    assert conf.count() == 9


def test_gmean_of_recalls(spark):
    conf = met.met_confusion(hard(spark, [(0, 0), (1, 1), (2, 2), (2, 1)]), ["cell"], 3)
    assert met.met_gmean(conf, ["cell"]).first()["value"] == pytest.approx(0.5 ** (1 / 3))
    assert met.met_recall(conf, ["cell"]).first()["per_class_recall"] == [1.0, 1.0, 0.5]


def test_absent_class_counts_as_zero(spark):
    conf = met.met_confusion(hard(spark, [(0, 0), (1, 1)]), ["cell"], 3)
    assert met.met_macro_f1(conf, ["cell"]).first()["value"] == pytest.approx(2 / 3)
    assert met.met_balanced_acc(conf, ["cell"]).first()["value"] == 1.0
    one = met.met_confusion(hard(spark, [(0, 0), (1, 0)]), ["cell"], 2)
    assert met.met_mcc(one, ["cell"]).first()["value"] == 0.0


def test_probability_metrics(spark):
    rows = [(c, [0.8 if k == c else 0.1 for k in range(3)]) for c in (0, 0, 1, 1, 2, 2)]
    pred = predictions(spark, rows)
    assert met.met_macro_ap(met.met_ap(pred, ["cell"]), ["cell"]).first()["value"] == pytest.approx(1.0)
    assert met.met_brier(pred, ["cell"]).first()["value"] == pytest.approx(0.02)
    assert met.met_log_loss(pred, ["cell"]).first()["value"] == pytest.approx(-np.log(0.8))


def test_average_precision_with_ties(spark):
    rows = [(0, [0.9, 0.1]), (1, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.2, 0.8]), (0, [0.1, 0.9])]
    got = {r["class"]: r["ap"] for r in met.met_ap(predictions(spark, rows), ["cell"]).collect()}
    assert got[0] == pytest.approx(1 / 3 * 1 + 1 / 3 * (2 / 3) + 1 / 3 * (3 / 5))


def test_average_precision_of_close_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 2)), [float(0.5 + e), float(0.5 - e)]) for e in rng.integers(-40, 40, 300) * 1e-9]
    got = {r["class"]: r["ap"] for r in met.met_ap(predictions(spark, rows), ["cell"]).collect()}
    y = np.array([r[0] == 0 for r in rows])
    s = np.array([r[1][0] for r in rows])
    want = sum((y & (s == v)).sum() / y.sum() * (y & (s >= v)).sum() / (s >= v).sum() for v in np.unique(s))
    assert got[0] == pytest.approx(want)


def test_macro_ap_needs_both_sides(spark):
    pred = predictions(spark, [(0, [0.6, 0.4]), (0, [0.7, 0.3])])
    row = met.met_macro_ap(met.met_ap(pred, ["cell"]), ["cell"]).first()
    assert row["value"] is None and row["status"] == "NOT APPLICABLE"


def test_probability_rules(spark, rows):
    bad = predictions(spark, [(0, [0.5, 0.5]), (0, [0.5, 0.4]), (0, [1.5, -0.5]), (0, [1.0]), (0, [float("nan"), 1.0])])
    found = dict(rows(met.met_validate_proba(bad, ["id"], 2)))
    assert set(found) == {1, 2, 3, 4} and "sum" in found[1] and "shape" in found[3]


def test_thresholds_equal_argmax_and_fall_back(spark):
    rng = np.random.default_rng(3)
    raw = rng.dirichlet([1, 1, 1], 60)
    pred = predictions(spark, [(i % 3, [float(v) for v in p]) for i, p in enumerate(raw)])
    zero = thr.thr_apply(pred, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).withColumn("a", met.met_argmax("p"))
    assert zero.filter("a <> yhat").count() == 0
    missing = thr.thr_fit(pred.filter("y <> 2"), ["cell"], 3).first()
    assert missing["offsets"] == [0.0, 0.0, 0.0] and missing["status"] != "VALID" and missing["score"] is None


def test_threshold_fit_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 90)
    p = rng.dirichlet([2, 1, 1], 90)
    p[:10] = [[0.4, 0.4, 0.2]] * 10
    p[10:14] = [[0.0, 0.5, 0.5], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.5, 0.0, 0.5]]
    pred = predictions(spark, [(int(a), [float(v) for v in b]) for a, b in zip(y, p)])
    best = None
    levels = [i * 0.5 for i in range(-4, 5)]
    for a in levels:
        for b in levels:
            hat = (p / np.exp([0.0, a, b])).argmax(1)
            f1 = np.mean([2 * ((y == c) & (hat == c)).sum() / max(1, (y == c).sum() + (hat == c).sum()) for c in range(3)])
            order = (-round(f1, 12), a + 2 * b, a, b)
            if best is None or order < best[0]:
                best = (order, f1, [0.0, a, b])
    got = thr.thr_fit(pred, ["cell"], 3, step=0.5).first()
    assert got["score"] == pytest.approx(best[1]) and got["offsets"] == best[2]


@pytest.mark.parametrize("classes,levels", [(4, 17), (6, 5)])
def test_threshold_fit_with_any_number_of_classes(spark, classes, levels):
    """At or above the best of a coarser whole grid, never below the argmax; the score is that of the offsets."""

    rng = np.random.default_rng(classes)
    y = rng.choice(classes, 120, p=np.arange(1, classes + 1) / np.arange(1, classes + 1).sum())
    y[:classes] = range(classes)
    p = rng.dirichlet(np.arange(classes, 0, -1), 120) + 0.25 * np.eye(classes)[y]
    p /= p.sum(axis=1, keepdims=True)

    def f1(o):
        hat = (p / np.exp(o)).argmax(1)
        return np.mean([2 * ((y == c) & (hat == c)).sum() / max(1, (y == c).sum() + (hat == c).sum()) for c in range(classes)])

    got = thr.thr_fit(predictions(spark, [(int(a), [float(v) for v in b]) for a, b in zip(y, p)]), ["cell"], classes).first()
    assert got["offsets"][0] == 0 and got["score"] == pytest.approx(f1(got["offsets"])) and got["score"] > f1(np.zeros(classes))
    if levels:
        grid = np.linspace(-2, 2, levels)
        best = max(f1((0.0, *o)) for o in itertools.product(grid, repeat=classes - 1))
        assert got["score"] >= best - 1e-12


def test_threshold_fit_without_keys(spark):
    pred = predictions(spark, [(0, [0.7, 0.3]), (1, [0.4, 0.6]), (1, [0.6, 0.4])])
    assert thr.thr_fit(pred, [], 2).first()["score"] == 1.0


def test_bundle_and_cost(spark):
    pred = predictions(spark, [(0, [0.7, 0.3]), (1, [0.4, 0.6]), (1, [0.6, 0.4])])
    row = met.met_bundle(pred, ["cell"], 2).first()
    assert row["macro_f1_argmax"] == row["macro_f1_calibrated"] == pytest.approx(2 / 3)
    timings = spark.createDataFrame([(0, "fit", 2.0, 5.0), (0, "predict", 0.5, 7.0)], "cell int, stage string, seconds double, peak_rss_mb double")
    cost = met.met_cost(timings, ["cell"]).first()
    assert (cost["wall_seconds"], cost["fit_seconds"], cost["predict_seconds"], cost["peak_rss_mb"]) == (2.5, 2.0, 0.5, 7.0)
