import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators import resample as rs
from classtilt.operators.knn import rs_knn


def labelled(spark, counts, dims=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for y, n in enumerate(counts):
        rows += [(len(rows) + i, y, [float(v) for v in rng.normal(y, 1.0, dims)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, x array<double>")


def brute(data, k, same, penalty=0.0):
    out = {}
    for a in data:
        near = []
        for b in data:
            if a["id"] == b["id"] or (same and a["y"] != b["y"]):
                continue
            d = sum((p - q) ** 2 for p, q in zip(a["x"], b["x"]))
            if penalty:
                d += penalty**2 * sum(p != q for p, q in zip(a["cats"], b["cats"]))
            near.append((d, b["id"]))
        for rank, (d, i) in enumerate(sorted(near)[:k], 1):
            out[(a["id"], rank)] = (i, pytest.approx(d**0.5))
    return out


def found(df):
    return {(r["id"], r["rank"]): (r["nb_id"], r["distance"]) for r in df.collect()}


@pytest.mark.parametrize("small", [{}, {"cell_rows": 12, "block_rows": 7}])
@pytest.mark.parametrize("same", [True, False])
def test_knn_equals_brute_force(spark, same, small):
    df = labelled(spark, [60, 35, 5])
    assert found(rs_knn(df, [], 4, same, **small)) == brute(df.collect(), 4, same)


def test_knn_with_a_hot_group_of_copies_and_categories(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [0.0, 0.0], ["a"], 1.5) for i in range(80)]
    rows += [(80 + i, i % 2, [float(v) for v in rng.integers(0, 5, 2)], [str(rng.integers(0, 3))], 1.5) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>, cats array<string>, pen double")
    got = found(rs_knn(df, [], 3, True, penalty="pen", cell_rows=9, block_rows=6))
    assert got == brute(df.collect(), 3, True, 1.5)


def test_knn_asks_only_for_the_wanted_rows(spark):
    df = labelled(spark, [40, 20])
    ask = df.filter("id % 7 = 0").select("id")
    want = {k: v for k, v in brute(df.collect(), 2, False).items() if k[0] % 7 == 0}
    assert found(rs_knn(df, [], 2, False, ask=ask, cell_rows=10)) == want


def test_knn_keeps_groups_apart(spark):
    df = labelled(spark, [20, 20]).withColumn("fold", (F.col("id") % 3).cast("int"))
    folds = {r["id"]: r["fold"] for r in df.collect()}
    pairs = rs_knn(df, ["fold"], 3, False).collect()
    assert len(pairs) == 120 and all(folds[r["id"]] == folds[r["nb_id"]] == r["fold"] for r in pairs)


def test_random_samplers_reach_their_counts(spark, rows):
    df = labelled(spark, [30, 16, 10])
    count = lambda d: rows(d.groupBy("y").count())
    assert count(rs.rs_random_over(df, [], 0)) == [(0, 30), (1, 30), (2, 30)]
    under = rs.rs_random_under(df, [], 0)
    assert count(under) == [(0, 10), (1, 10), (2, 10)] and under.select("id").distinct().count() == 30
    bags = rs.rs_balanced_bootstrap(df, [], 2, 0)
    assert rows(bags.groupBy("bag", "y").count()) == [(b, y, 10) for b in (0, 1) for y in (0, 1, 2)]


def test_smote_rows_lie_between_their_ends(spark):
    df = labelled(spark, [30, 12])
    made = rs.rs_smote(df, [], 3, 0).filter("synthetic").collect()
    assert len(made) == 18 and all(r["y"] == 1 for r in made)
    minority = np.array([r["x"] for r in df.filter("y = 1").collect()])
    for r in made:
        x = np.array(r["x"])
        assert (x >= minority.min(0) - 1e-9).all() and (x <= minority.max(0) + 1e-9).all()


def test_sampling_is_repeatable_under_repartitioning(spark, rows):
    df = labelled(spark, [25, 9])
    assert rows(rs.rs_smote(df, [], 3, 5)) == rows(rs.rs_smote(df.repartition(7, "x"), [], 3, 5))


def test_neighbour_numbers(spark):
    spec = lambda c, cond: rs.rs_neighbours(labelled(spark, c), [], cond).first()
    assert (spec([10, 3, 7], "smote")["k"], spec([10, 3, 7], "smote")["support"]) == (2, 3)
    assert spec([10, 1], "smote")["problem"].startswith("fewer than two")
    border = spec([5, 2, 2], "borderline_smote")
    assert border["k"] == 1 and 2 <= border["m"] <= 8
    assert spec([4, 4], "smote")["k"] is None
    assert rs.rs_noop(labelled(spark, [4, 4]), []).first()["balanced"]


def test_adasyn_reports_a_class_without_border(spark):
    rows = [(i, 0, [0.0 + i * 0.01]) for i in range(10)] + [(20 + i, 1, [1000.0 + i * 0.01]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    sampled, failures = rs.rs_adasyn(df, [], 3, 0)
    assert [r["error"] for r in failures.collect()] == [f"{rules.NO_BORDER_MESSAGE}. Use SMOTE instead."]
    assert sampled.count() == 15


def test_cleaning(spark):
    rows = [(0, 0, [0.0]), (1, 1, [0.1]), (2, 0, [5.0]), (3, 0, [5.1]), (4, 0, [5.2]), (5, 0, [5.3])]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    assert sorted(r["id"] for r in rs.rs_tomek(df, []).collect()) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in rs.rs_enn(df, []).collect()) == [2, 3, 4, 5]


def test_mixed_cleaning_uses_category_codes(spark):
    rows = [(i, "a" if i < 12 else "b", [float(i % 5)], ["u" if i % 2 else "v"]) for i in range(18)]
    df = spark.createDataFrame(rows, "id long, y string, x array<double>, cats array<string>")
    out = rs.rs_smotetomek(df, [], 3, 0)
    assert set(out.columns) >= {"id", "y", "x", "cats", "synthetic"}
    assert {len(r["x"]) for r in out.collect()} <= {1}
    grown = rs.rs_smotenc(df, [], 3, 0)
    counts = {(r["y"]): r["count"] for r in grown.groupBy("y").count().collect()}
    assert counts == {"a": 12, "b": 12}
    assert {r["cats"][0] for r in grown.filter("synthetic").collect()} <= {"u", "v"}


def test_gate(spark, rows):
    cells = spark.createDataFrame(
        [("numeric", "xgboost", "smotenc"), ("mixed", "xgboost", "smote"), ("numeric", "xgboost", "balanced_random_forest"), ("numeric", "random_forest", "smote")],
        "feature_type string, classifier string, condition string",
    )
    ok, failed = rs.rs_gate(cells, rules.unsupported_table(spark))
    assert rows(ok) == [("numeric", "random_forest", "smote")]
    assert rows(failed, "condition", "error") == sorted(
        [
            ("smotenc", "SMOTENC is only applicable to mixed datasets"),
            ("smote", "smote is not valid for mixed data in Stage 0"),
            ("balanced_random_forest", rules.FOREST_ONLY_MESSAGE),
        ],
        key=repr,
    )
