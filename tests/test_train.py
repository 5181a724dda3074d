import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators import prepare as prep
from classtilt.operators import train as fit
from classtilt.operators import tune


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(0)
    rows = [(100 * y + i, y, [float(v) for v in rng.normal(3 * y, 1.0, 2)]) for y, n in enumerate((30, 16, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    return prep.prep_kfold(df, [], "id", "y", 2, 0).cache()


def test_probabilities_sum_to_one(folds):
    train, test = folds.filter("fold = 0"), folds.filter("fold = 1")
    models = [
        fit.fit_logistic(prep.prep_class_weight(train, [], "y"), {"maxIter": 20}, "weight"),
        fit.fit_forest(train, {"numTrees": 5}),
        fit.fit_boosted(train, {"maxIter": 2}),
        fit.fit_balanced_forest(train.drop("fold"), 2, {"numTrees": 4}),
    ]
    for model in models:
        pred = fit.fit_predict_proba(model, test).collect()
        assert len(pred) == test.count() and all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == 3 for r in pred)
        assert np.mean([np.argmax(r["p"]) == r["y"] for r in pred]) > 0.7


def test_every_cell_is_accounted(folds):
    cells = [
        {"dataset": "d", "seed": 0, "fold": f, "classifier": c, "condition": k, "feature_type": "numeric"}
        for f in (0, 1)
        for c, k in (("random_forest", "random_over"), ("random_forest", "smotenc"), ("xgboost", "balanced_random_forest"), ("random_forest", "nonsense"))
    ]
    good, bad = fit.grid_run(folds, cells, 3, {"random_forest": {"numTrees": 3}}, pool=2)
    assert good.count() == 2 and bad.count() == 6
    assert {r["stage"] for r in bad.collect()} == {"applicability", "fit_predict"}
    assert good.filter("macro_average_precision is null").count() == 0


def test_each_seed_has_its_own_split(folds):
    """A cell sees the rows of its own dataset and seed only."""

    other = folds.withColumn("seed", F.lit(1)).withColumn("fold", (F.col("fold") + F.col("id").cast("int")) % 2)
    keyed = folds.withColumn("seed", F.lit(0)).unionByName(other).withColumn("dataset", F.lit("d"))
    cells = [
        {"dataset": "d", "seed": s, "fold": 0, "classifier": "random_forest", "condition": "raw", "feature_type": "numeric"} for s in (0, 1, 2)
    ]
    good, bad = fit.grid_run(keyed, cells, 3, {"random_forest": {"numTrees": 3}}, pool=1)
    alone = fit.run_cell(folds, 3, {"random_forest": {"numTrees": 3}}, cells[0])
    scores = {r["seed"]: r["multiclass_log_loss"] for r in good.collect()}
    assert scores[0] == pytest.approx(alone["multiclass_log_loss"]) and scores[1] != pytest.approx(scores[0])
    assert [r["seed"] for r in bad.collect()] == [2]


def test_retry_only_for_infrastructure():
    calls = []

    def run(cell):
        calls.append(cell)
        raise (MemoryError if cell["kind"] == "infra" else ValueError)("no")

    assert fit.grid_retry(run, {"kind": "infra"})[2] == 1 and len(calls) == 2
    assert fit.grid_retry(run, {"kind": "protocol"})[2] == 0 and len(calls) == 3


def test_resume(spark, rows):
    cells = spark.createDataFrame([("a", 1), ("b", 1)], "dataset string, fold int")
    markers = spark.createDataFrame([("a", "complete"), ("b", "partial")], "dataset string, status string")
    assert rows(fit.grid_resume(cells, markers)) == [("b", 1)]
    stale = spark.createDataFrame([("a", "stale artifact x")], "dataset string, problem string")
    assert rows(fit.grid_resume(cells, markers, stale=stale.limit(0))) == [("b", 1)]
    with pytest.raises(ValueError, match="a: stale artifact x"):
        fit.grid_resume(cells, markers, stale=stale)


def test_trials_stay_in_their_ranges(spark):
    trials = tune.tune_trials(tune.space_table(spark)).collect()
    assert len(trials) == sum(len(s) for s in rules.SEARCH_SPACES.values()) * 20
    for r in trials:
        kind, *spec = rules.SEARCH_SPACES[r["classifier"]][r["param"]]
        if kind in ("loguniform", "uniform", "randint"):
            assert spec[0] <= float(r["value"]) <= spec[1]
        if kind == "randint":
            assert float(r["value"]) < spec[1] and "." not in r["value"]
        if kind == "categorical":
            assert r["value"] in spec[0]
    assert tune.tune_contract(tune.space_table(spark)).count() == 0


def test_contract_violations(spark):
    space = tune.space_table(spark).filter("classifier <> 'xgboost'").withColumn("param", F.when(F.col("param") == "C", "sampler__k").otherwise(F.col("param")))
    assert tune.tune_contract(space, trials=5, scoring="f1", workers=2).count() == 5


def test_selection_and_oof(spark, rows):
    scores = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, None)], "cell string, trial int, score double")
    best, failed = tune.tune_select(scores, ["cell"])
    assert rows(best) == [("a", 2, 0.7)] and rows(failed, "cell", "stage") == [("b", "inner_hpo")]
    assert [r["trial"] for r in tune.ordered_scores(scores.filter("cell = 'a'"), ["cell"]).orderBy("place").collect()] == [2, 3, 1]
    data = spark.createDataFrame([("a", i) for i in range(4)], "cell string, id int")
    pred = data.filter("id < 3").unionByName(data.filter("id = 0"))
    assert rows(tune.tune_oof(pred, data, ["cell"])[1]) == [("a", 1, 1)]
    assert tune.tune_oof(data, data, ["cell"])[1].count() == 0
