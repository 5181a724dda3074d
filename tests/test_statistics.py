import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt.operators import cells as st
from classtilt.operators import contrasts as con
from classtilt.operators import rank_tests as rt


def records(spark, datasets=1, conditions=("raw",), seeds=3, folds=5, value=lambda d, c, s, f: 0.5):
    rows = [
        (f"d{d}", "random_forest", c, "numeric", s, f, *[float(value(d, c, s, f))] * 4, [0.1, 0.2, 0.3], 1.0 + f, 100)
        for d in range(datasets)
        for c in conditions
        for s in range(seeds)
        for f in range(folds)
    ]
    return spark.createDataFrame(
        rows,
        "dataset string, classifier string, condition string, feature_type string, seed int, fold int, macro_f1 double, g_mean double, "
        "mcc double, balanced_accuracy double, per_class_recall array<double>, fit_predict_seconds double, train_rows_before_sampling bigint",
    )


def deltas(spark, values, condition="smote"):
    rows = [("f", "c", "m", condition, f"d{i:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "family string, classifier string, metric string, condition string, dataset string, delta double")


def test_fifteen_record_rule(spark):
    rec = records(spark)
    assert st.st_cell_means(rec).count() == 1 and st.st_class_means(rec).count() == 3
    assert st.st_efficiency(rec).first()["fit_predict_seconds_median"] == 3.0
    assert st.st_cell_means(rec.filter("not (seed = 2 and fold = 4)")).count() == 0
    doubled = rec.filter("not (seed = 2 and fold = 4)").unionByName(rec.filter("seed = 0 and fold = 0"))
    assert st.st_cell_means(doubled.filter("seed < 2").unionByName(rec.filter("seed = 0"))).count() == 0


def test_rankings_share_ties(spark, rows):
    score = {"raw": 0.5, "smote": 0.9, "adasyn": 0.5}
    ranked = st.st_rankings(records(spark, 2, tuple(score), 2, 1, lambda d, c, s, f: score[c]))
    macro = ranked.filter("metric = 'macro_f1'").select("condition", "rank").distinct()
    assert rows(macro) == [("adasyn", 2.5), ("raw", 2.5), ("smote", 1.0)]


def test_pairs_below_three_are_descriptive(spark):
    row = lambda v: st.st_effects(deltas(spark, v)).first()
    assert row([0.1, 0.2])["status"] == "descriptive" and row([0.1, 0.2, -0.1])["status"] == "computed"
    assert (row([1e-13, 0.2, -0.1])["wins"], row([1e-13, 0.2, -0.1])["ties"]) == (1, 1)


def test_holm(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.2), ("f", None)], "k string, p double")
    got = {r["p"]: r["holm_p_value"] for r in rt.st_holm(df, ["k"], "p").collect()}
    assert got == {0.01: pytest.approx(0.03), 0.04: pytest.approx(0.08), 0.2: pytest.approx(0.2), None: None}
    assert rt.st_holm(df, ["k"], "p").first()["holm_family_size"] == 3


def test_exact_signed_rank(spark):
    row = rt.st_signed_rank_exact(deltas(spark, [0.1, 0.2, 0.3])).first()
    assert (row["exact_p_value"], row["sign_patterns"], row["minimum_attainable_p"]) == (0.25, 8, 0.25)
    zero = rt.st_signed_rank_exact(deltas(spark, [0.0, 0.0])).first()
    assert (zero["exact_p_value"], zero["n_nonzero_pairs"], zero["minimum_attainable_p"]) == (1.0, 0, 1.0)
    many = rt.st_signed_rank_exact(deltas(spark, range(1, 23))).first()
    assert many["exact_p_value"] is None and many["reason"]


def _signed_rank(values):
    d = np.array([v for v in values if v])
    order = np.abs(d)
    ranks = np.array([(order < a).sum() + ((order == a).sum() + 1) / 2 for a in order])
    observed = abs(ranks[d > 0].sum() - ranks[d < 0].sum())
    signs = np.array(list(itertools.product((-1, 1), repeat=len(d))))
    return np.mean(np.abs(signs @ ranks) >= observed - 1e-12)


@pytest.mark.parametrize("values", [[-1, -2, -3, -4, -5, -6, -7, -8, -9], [1, 1, -2, 3, 3, -3], [0, 0, 1, -2, 4], [0.5, -0.25, 2, 3]])
def test_wilcoxon_small_samples(spark, values):
    row = rt.st_wilcoxon(deltas(spark, values)).first()
    assert row["wilcoxon_p_value"] == pytest.approx(_signed_rank(values))


def test_wilcoxon_labels_and_normal_tail(spark):
    label = lambda v: rt.st_wilcoxon_calibration(deltas(spark, v)).first()["wilcoxon_calibration"]
    assert label([1, 2]) == "not_run_below_three_pairs"
    assert label([0, 0, 0]) == "degenerate_all_zero_p_one"
    assert label([1, 2, 3]) == "exact_no_ties_or_zeros"
    assert label([1, 1, 3]) == "exhaustive_sign_permutation"
    tied = [1, 1] + list(range(2, 15))
    assert label(tied) == "asymptotic"
    n, w = 15, 0
    spread = (n * (n + 1) * (2 * n + 1) / 24 - 6 / 48) ** 0.5
    from math import erf, sqrt

    want = 2 * (0.5 * (1 + erf(-abs(w - n * (n + 1) / 4) / spread / sqrt(2))))
    assert rt.st_wilcoxon(deltas(spark, tied)).first()["wilcoxon_p_value"] == pytest.approx(want, rel=1e-9)


def test_rank_biserial(spark):
    assert rt.st_rank_biserial(deltas(spark, [1, 2, -3])).first()["rank_biserial"] == pytest.approx(0.0)
    assert rt.st_rank_biserial(deltas(spark, [0, 0])).first()["rank_biserial"] == 0.0


def test_bootstrap_interval(spark):
    row = rt.st_bootstrap_ci(deltas(spark, [0.1, 0.2, 0.3, 0.4]), 400).first()
    assert 0.1 <= row["bootstrap_low"] < 0.25 < row["bootstrap_high"] <= 0.4
    same = rt.st_bootstrap_ci(deltas(spark, [0.2, 0.2]), 50).first()
    assert same["bootstrap_low"] == pytest.approx(0.2) == same["bootstrap_high"]


@pytest.fixture
def cell(spark):
    order = {"raw": 0.1, "class_weighted": 0.2, "balanced_random_forest": 0.3}
    return st.st_cell_means(records(spark, 3, tuple(order), value=lambda d, c, s, f: order[c] + d * 0.001))


def test_friedman_and_nemenyi(cell):
    fried = {(r["family"], r["metric"]): r for r in rt.st_friedman(cell).collect() if r["classifier"] == "random_forest"}
    done = fried[("balanced_rf_numeric", "macro_f1")]
    assert done["status"] == "computed" and done["stat"] == pytest.approx(6.0) and done["p"] == pytest.approx(np.exp(-3.0))
    assert fried[("balanced_rf_mixed", "macro_f1")]["reason"] == "fewer than three complete conditions"
    assert fried[("numeric_core", "macro_f1")]["reason"] == "fewer than three complete conditions"
    pairs = rt.st_nemenyi(rt.st_mean_ranks(cell), rt.st_friedman(cell)).filter("metric = 'macro_f1'").collect()
    assert len(pairs) == 3 and all(0 <= r["p"] <= 1 and r["a"] < r["b"] for r in pairs)


def test_friedman_reports_missing_conditions(spark):
    conditions = ("raw", "class_weighted", "smote", "adasyn")
    rec = records(spark, 3, conditions, value=lambda d, c, s, f: len(c) + d)
    row = rt.st_friedman(st.st_cell_means(rec)).filter("family = 'numeric_core' and classifier = 'random_forest'").first()
    assert row["status"] == "skipped" and row["reason"].startswith("incomplete condition matrix: borderline_smote, ")
    pilot = rt.st_friedman_pilot(rec.filter("dataset <> 'd2'")).first()
    assert pilot["reason"] == "fewer than three dataset blocks"


def test_sign_flips_and_permutation(cell):
    pairs = rt.st_sign_flip(cell).filter("family = 'balanced_rf_numeric' and metric = 'macro_f1'").collect()
    assert len(pairs) == 3 and all(r["sign_patterns"] == 8 and r["exact_p_value"] >= 0.25 for r in pairs)
    omnibus = rt.st_friedman_permutation(cell, 300).filter("metric = 'macro_f1'").first()
    exact = 6 / 6**3
    assert omnibus["permutation_resamples"] == 300 and abs(omnibus["permutation_p_value"] - exact) < 0.05


def test_reduced_tables_have_their_sizes(spark):
    conditions = ("raw", "class_weighted", "random_over", "random_under", "smote", "borderline_smote", "smoteenn", "smotetomek")
    rows = [
        (f"d{d}", classifier, c, "numeric", 15, *[0.5 + 0.01 * i + 0.001 * d * (i % 3)] * 4)
        for d in range(9)
        for classifier in ("logistic_regression", "random_forest", "xgboost")
        for i, c in enumerate(conditions)
    ]
    cell = spark.createDataFrame(rows, "dataset string, classifier string, condition string, feature_type string, complete_records bigint, macro_f1 double, g_mean double, mcc double, balanced_accuracy double")
    assert rt.st_complete_gate(cell).count() == 0
    assert rt.st_complete_gate(cell.filter("not (dataset = 'd0' and condition = 'smote')")).count() == 3
    assert rt.st_reduced_omnibus(cell, n=20).count() == 3
    pairwise = rt.st_reduced_pairwise(cell)
    assert pairwise.count() == 21 and pairwise.filter("holm_family_size <> 7").count() == 0
    registry = spark.createDataFrame([(f"d{d}", 1.0 if d < 3 else 2.0) for d in range(9)], "dataset_id string, ir_majority_minority double")
    strata = st.st_stratified(st.st_baseline_deltas(cell).filter("metric = 'macro_f1' and family = 'numeric_core'"), registry)
    assert strata.count() == 42 and {r["n_datasets"] for r in strata.collect()} == {3, 6}
    omnibus, pairs = rt.st_primary_sensitivity(cell, 20)
    assert omnibus.count() == 1 and pairs.count() == 28 and pairs.filter("holm_family_size <> 28").count() == 0


def test_coverage_keeps_empty_tiles(spark):
    rows = [("a", "logistic", "smote", "numeric", 0.7), ("b", "logistic", "smote", "numeric", 0.9), ("c", "logistic", "raw", "numeric", 0.5), ("d", "forest", "raw", "mixed", 0.6)]
    cell = spark.createDataFrame(rows, "dataset string, classifier string, condition string, feature_type string, macro_f1 double")
    grid = {(r["feature_type"], r["classifier"], r["condition"]): r for r in st.st_coverage_grid(cell).collect()}
    assert len(grid) == 8
    assert grid[("numeric", "logistic", "smote")]["n_datasets"] == 2 and grid[("numeric", "logistic", "smote")]["mean_macro_f1"] == pytest.approx(0.8)
    assert grid[("mixed", "logistic", "smote")]["n_datasets"] == 0 and grid[("mixed", "logistic", "smote")]["mean_macro_f1"] is None


def contrast_input(spark, gain=0.05, datasets=3):
    rows = [
        (f"d{d}", "numeric", f, "random_forest", c, 0.5 + 0.01 * f + 0.002 * d + (gain + 0.001 * d if c == "smote" else 0.0), "VALID")
        for d in range(datasets)
        for f in range(5)
        for c in ("raw", "smote")
    ]
    return spark.createDataFrame(rows, "dataset string, feature_type string, fold int, classifier string, condition string, ap double, status string")


def test_contrast_blocks(spark):
    rec = contrast_input(spark)
    contrasts = con.st_contrast_list(spark)
    assert len(con.declared_pairs()) == len(set(con.declared_pairs()))
    blocks = con.st_contrast_blocks(rec, contrasts, "ap")
    assert blocks.count() == 15 and blocks.filter("delta <= 0").count() == 0
    short = con.st_contrast_blocks(rec.filter("not (dataset = 'd1' and fold = 3 and condition = 'raw')"), contrasts, "ap")
    assert short.count() == 10
    table = con.st_contrast_table(contrasts, short)
    assert {r["status"] for r in table.collect()} == {"SKIPPED"}


@pytest.mark.parametrize(("gain", "category"), [(0.05, "practically_better"), (-0.05, "practically_worse"), (0.0, "practically_equivalent")])
def test_posterior_and_region(spark, gain, category):
    blocks = con.st_contrast_blocks(contrast_input(spark, gain, 6), con.st_contrast_list(spark), "ap")
    post = con.st_posterior(blocks)
    assert post.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert con.st_rope(post).first()["posterior_category"] == category
    row = con.st_credible(post).first()
    assert row["credible_low"] < row["posterior_mean_mu"] < row["credible_high"]
    assert row["posterior_mean_mu"] == pytest.approx(gain + 0.0025, abs=0.002)
    # The folds of a dataset agree exactly here, so sigma's mass lies at its smallest node, and that is reported.
    assert row["edge_tau"] < 1e-6 and row["edge_sigma"] > 0.99


def brute_posterior(values, draws=400_000):
    """Importance sampling: the priors' draws weighted by the multivariate normal likelihood, mu included."""

    rng = np.random.default_rng(5)
    n, folds = values.shape
    mu = rng.normal(0, 0.5, draws)
    tau, sigma, rho = np.abs(rng.normal(0, 0.5, draws)), np.abs(rng.normal(0, 0.25, draws)), rng.beta(2, 2, draws)
    s, v = sigma**2 * (1 - rho), tau**2 + sigma**2 * (1 + (folds - 1) * rho) / folds
    means = values.mean(axis=1)
    within, gaps = ((values - means[:, None]) ** 2).sum(), ((means[:, None] - mu) ** 2).sum(axis=0)
    logs = -0.5 * n * np.log(v) - gaps / (2 * v) - 0.5 * n * (folds - 1) * np.log(s) - within / (2 * s)
    weight = np.exp(logs - logs.max())
    order = np.argsort(mu)
    upto = np.cumsum(weight[order]) / weight.sum()
    return [float(mu[order][np.searchsorted(upto, q)]) for q in (0.025, 0.5, 0.975)]


def test_posterior_on_the_whole_support(spark):
    """Three datasets, wide differences: the interval of the priors' own draws, which no grid relative to the data reaches."""

    values = np.array([[0.20, 0.05, 0.12, 0.31, 0.02], [-0.08, 0.10, 0.02, 0.21, -0.15], [0.40, 0.18, 0.33, 0.25, 0.09]])
    rows = [("smote", "raw", "logistic", f"d{i}", "numeric", f, float(x)) for i, row in enumerate(values) for f, x in enumerate(row)]
    names = ["left_condition", "right_condition", "classifier", "dataset", "feature_type", "fold", "delta"]
    got = con.st_credible(con.st_posterior(spark.createDataFrame(rows, names))).first()
    low, middle, high = brute_posterior(values)
    assert got["credible_low"] == pytest.approx(low, abs=0.02) and got["credible_high"] == pytest.approx(high, abs=0.02)
    assert got["posterior_median_mu"] == pytest.approx(middle, abs=0.01)
    assert got["credible_high"] - got["credible_low"] > 0.5 and got["edge_tau"] < 1e-6 and got["edge_sigma"] < 1e-6
