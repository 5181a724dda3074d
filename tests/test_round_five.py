"""Cells of the grid are scored together, with the values that each has alone, and errors stay in their cell."""

import numpy as np
import pytest

from classtilt.operators import prepare as prep
from classtilt.operators import train as fit


def test_cells_are_scored_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(100 * y + i, y, [float(v) for v in rng.normal(y, 1.0, 2)]) for y, n in enumerate((30, 16)) for i in range(n)]
    folds = prep.prep_kfold(spark.createDataFrame(rows, "id long, y int, x array<double>"), [], "id", "y", 2, 0).cache()
    cells = [
        {"dataset": "d", "seed": 0, "fold": f, "classifier": "logistic_regression", "condition": k, "feature_type": "numeric"}
        for f, k in ((0, "raw"), (1, "class_weighted"), (2, "raw"), (0, "nonsense"))
    ]
    params, calls, score = {"logistic_regression": {"maxIter": 5}}, [], fit.met_bundle
    alone = [fit.run_cell(folds, 2, params, c) for c in cells[:2]]
    broken = []

    def counted(pred, keys, classes):
        calls.append(keys)
        if broken and len(calls) == 1:
            raise ValueError("all at once")
        return score(pred, keys, classes)

    monkeypatch.setattr(fit, "met_bundle", counted)
    for fails in (False, True):
        calls.clear()
        broken[:] = [1] * fails
        good, bad = fit.grid_run(folds, cells, 2, params, pool=2)
        got = {(r.fold, r.condition): r.asDict() for r in good.collect()}
        assert len(calls) == (4 if fails else 1) and len(got) == 2
        for want in alone:
            same = got[want["fold"], want["condition"]]
            for name in set(want) - {"fit_predict_seconds"}:
                assert same[name] == pytest.approx(want[name])
        assert sorted((r.fold, r.condition, r.stage) for r in bad.collect()) == [(0, "nonsense", "fit_predict"), (2, "raw", "fit_predict")]
