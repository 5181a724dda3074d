"""The tuned cell against plain Python on small mixed and numeric tables."""

import math
import tempfile

import numpy as np
import pytest

from classtilt import rules
from classtilt.operators import nested
from classtilt.operators.prepare import Layout, prep_kfold
from classtilt.session import cut

SPACES = {
    "logistic_regression": {"C": ("loguniform", 0.01, 100.0), "penalty": ("categorical", ["l1", "l2"]), "max_iter": ("constant", "30")},
    "random_forest": {
        "n_estimators": ("randint", 3, 5), "max_depth": ("categorical", ["null", "5"]), "min_samples_leaf": ("randint", 1, 4),
        "max_features": ("categorical", ["sqrt", "1.0"]),
    },
}
MIXED = Layout(("a", "b"), ("c",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for y, n in enumerate((24, 16, 12)):
        for i in range(n):
            a, b = (float(v) for v in rng.normal(1.5 * y, 1.0, 2))
            c = "xyz"[y] if rng.random() < 0.7 else "w"
            rows.append((100 * y + i, y, None if i % 9 == 4 else a, b, None if i % 7 == 3 else c))
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c string")
    return prep_kfold(df, [], "id", "y", 2, 0).cache()


def run(table, folder, cells, **more):
    more = {"k": 2, "trials": 2, "spaces": SPACES, "pool": 4} | more
    layout = more.pop("layout", MIXED)
    return nested.nested_run(table, layout, cells, 3, folder, **more)


def brute_ap(y, s):
    """Average precision by its definition, equal scores one threshold."""

    total, last = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hit = sum(1 for v, w in zip(y, s, strict=True) if w >= t and v)
        total += (hit - last) / sum(y) * hit / sum(1 for w in s if w >= t)
        last = hit
    return total


def test_splits_never_leak(table):
    rows = nested.nested_splits(table, 2).collect()
    outer = {r["id"]: r["fold"] for r in table.collect()}
    for o in (0, 1):
        for s in (-1, 0, 1, 2):
            part = [r for r in rows if (r["outer_fold"], r["split"]) == (o, s)]
            test, train = ({r["id"] for r in part if r["is_test"] == side} for side in (True, False))
            inside = {i for i, f in outer.items() if f != o}
            assert not test & train and len(part) == len(test | train)
            assert test | train == (set(outer) if s == -1 else inside)
            assert s != -1 or test == set(outer) - inside


def test_preparation_uses_training_rows_only(table):
    """Medians, modes, scales and vocabulary of one split, recomputed by hand."""

    splits = cut(nested.nested_splits(table, 2))
    made, _ = nested.nested_prepare(cut(nested.nested_impute(splits, MIXED, True)), MIXED, "raw", True, 0)
    part = splits.filter("fold = '0/1'").collect()
    train = [r for r in part if not r["is_test"]]
    modes = [r["c"] for r in train if r["c"] is not None]
    mode = min(set(modes), key=lambda v: (-modes.count(v), v))
    vocabulary = sorted({r["c"] or mode for r in train})
    want = {}
    for r in part:
        x = []
        for name in ("a", "b"):
            middle = float(np.median([t[name] for t in train if t[name] is not None]))
            filled = [middle if t[name] is None else t[name] for t in train]
            x.append(((middle if r[name] is None else r[name]) - np.mean(filled)) / np.std(filled))
        want[str(r["id"])] = [*x, *[float(v == (r["c"] or mode)) for v in vocabulary]]
    got = {r["id"]: r["x"] for r in made.filter("outer_fold = 0 and split = 1").collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_mixed_cells(spark, table):
    """Scores, choice and metrics recomputed from the written predictions."""

    cells = [(0, "logistic_regression", "smotenc"), (0, "random_forest", "raw"), (0, "random_forest", "smote"), (0, "logistic_regression", "balanced_random_forest")]
    whole = tempfile.mkdtemp()
    results, failures, trials = run(table, whole, cells)
    good = {(r["classifier"], r["condition"]): r for r in results.collect()}
    tried = trials.collect()
    assert set(good) == {("logistic_regression", "smotenc"), ("random_forest", "raw")}
    assert {(r["condition"], r["stage"], r["error"]) for r in failures.collect()} == {
        ("smote", "applicability", "smote is numeric-only in the frozen matrix"),
        ("balanced_random_forest", "applicability", rules.FOREST_ONLY_MESSAGE),
    }
    assert len(tried) == 4 and all(r["status"] == rules.VALID for r in tried)

    inner = spark.read.parquet(f"{whole}/inner").collect()
    training = {str(r["id"]) for r in table.filter("fold <> 0").collect()}
    scores = {}
    for r in tried:
        mine = [p for p in inner if all(p[n] == r[n] for n in ("classifier", "condition", "trial"))]
        assert sorted(p["id"] for p in mine) == sorted(training)
        folds = [[p for p in mine if p["inner_fold"] == i] for i in range(3)]
        macro = np.mean([np.mean([brute_ap([p["y"] == c for p in f], [p["p"][c] for p in f]) for c in range(3)]) for f in folds])
        assert r["macro_average_precision"] == pytest.approx(macro)
        scores.setdefault((r["classifier"], r["condition"]), []).append((-r["macro_average_precision"], r["trial"]))
    outer = spark.read.parquet(f"{whole}/outer").collect()
    for cell, r in good.items():
        assert r["selected_trial"] == min(scores[cell])[1]
        mine = [p for p in outer if (p["classifier"], p["condition"]) == cell]
        shifted = [[p / math.exp(o) for p, o in zip(row["p"], r["threshold_offsets"], strict=True)] for row in mine]
        for name, values in (("macro_f1_argmax", [row["p"] for row in mine]), ("macro_f1_calibrated", shifted)):
            guess = [int(np.argmax(v)) for v in values]
            f1 = []
            for c in range(3):
                hit = sum(g == c == row["y"] for g, row in zip(guess, mine, strict=True))
                both = sum(g == c for g in guess) + sum(row["y"] == c for row in mine)
                f1.append(2 * hit / both if both else 0.0)
            assert r[name] == pytest.approx(np.mean(f1))
        assert r["rows_before_sampling"] == len(training) and len(mine) == table.count() - len(training)
    assert good["random_forest", "raw"]["rows_after_sampling"] == len(training)
    assert good["logistic_regression", "smotenc"]["rows_after_sampling"] == 36  # three classes of 12


def test_resumption(table, monkeypatch):
    """A run killed between fits goes on where it stopped; a finished one fits nothing; another plan is refused."""

    folder, numeric, cells = tempfile.mkdtemp(), Layout(("b",), ()), [(0, "logistic_regression", "raw")]
    real, calls = nested.fit_and_predict, []

    def dying(*args):
        calls.append(args)
        if len(calls) > 2:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(nested, "fit_and_predict", dying)
    with pytest.raises(KeyboardInterrupt):
        run(table, folder, cells, layout=numeric, trials=1, pool=1)
    calls.clear()
    monkeypatch.setattr(nested, "fit_and_predict", lambda *args: calls.append(args) or real(*args))
    first = run(table, folder, cells, layout=numeric, trials=1, pool=1)[0].collect()
    assert len(calls) == 2 and len(first) == 1  # the third inner fold and the refit
    assert run(table, folder, cells, layout=numeric, trials=1, pool=1)[0].collect() == first and len(calls) == 2
    with pytest.raises(ValueError, match="another plan"):
        run(table, folder, cells, layout=numeric, trials=3)


def test_failed_trials(table, monkeypatch):
    """A trial that fails is a row; a cell whose trials all fail is a failure."""

    def none(model, params, rows):
        raise ValueError("no such model")

    monkeypatch.setattr(nested, "model_params", none)
    results, failures, trials = run(table, tempfile.mkdtemp(), [(1, "random_forest", "raw")], layout=Layout(("b",), ()))
    assert [(r["status"], r["error"], r["macro_average_precision"]) for r in trials.collect()] == [(rules.FAILED, "no such model", None)] * 2
    assert results.count() == 0
    assert [(r["stage"], r["error"]) for r in failures.collect()] == [("inner_hpo", "all HPO trials failed")]


def test_parameters():
    c = nested.model_params("logistic_regression", {"C": "2.0", "penalty": "l1", "max_iter": "5000"}, 50)
    assert c == {"regParam": 0.01, "elasticNetParam": 1.0, "maxIter": 5000, "standardization": False}
    f = nested.model_params("random_forest", {"n_estimators": "300", "max_depth": "40", "min_samples_leaf": "2", "max_features": "1.0"}, 50)
    assert f == {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"}
    assert nested.nested_applicability("numeric", "random_forest", "smotenc") == rules.SMOTENC_MESSAGE
    assert nested.nested_applicability("mixed", "random_forest", "smotenc") is None
