import pytest
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators import accounting as acc

KEYS = list(rules.CELL_KEYS)


@pytest.fixture
def grid(spark):
    return acc.acc_expected(spark.createDataFrame([("d",)], "dataset string"), acc.v1_dims())


def test_grid_has_495_cells(grid):
    assert grid.count() == 495 == grid.distinct().count()


def test_two_valid_and_the_rest_failed(grid):
    valid = grid.filter("seed = 0 and fold = 0 and classifier = 'xgboost' and condition in ('raw', 'smote')")
    failed = grid.exceptAll(valid)
    row = acc.acc_counts(acc.acc_validate(grid, valid, failed)).first()
    assert (row["expected_cells"], row["valid_cells"], row["failure_cells"], row["violations"]) == (495, 2, 493, 0)


def test_missing_duplicate_extra_and_both(grid, rows):
    cell = grid.limit(1)
    some = grid.filter("seed = 1")
    state = acc.acc_validate(grid, some.unionByName(cell), cell)
    assert state.filter("state = 'missing'").count() > 0
    twice = acc.acc_validate(grid, grid.unionByName(cell), grid.limit(0))
    assert rows(twice.filter("state = 'duplicate'").groupBy("state").count()) == [("duplicate", 1)]
    both = acc.acc_validate(grid, grid, cell)
    assert both.filter("state = 'valid and failed'").count() == 1
    extra = acc.acc_validate(grid, grid.unionByName(cell.withColumn("fold", F.lit(9))), grid.limit(0))
    assert extra.filter("state = 'extra'").count() == 1


def test_failure_categories_and_summary(spark, rows):
    failures = spark.createDataFrame(
        [
            ("mixed", "xgboost", "smote", "ValueError", "smote is not valid for mixed data in Stage 0"),
            ("numeric", "xgboost", "adasyn", "ValueError", rules.NO_SAMPLES_MESSAGE),
            ("mixed", "xgboost", "smote", "ValueError", "something else"),
            ("numeric", "xgboost", "raw", "MemoryError", "x"),
        ],
        "feature_type string, classifier string, condition string, error_type string, error string",
    )
    marked = acc.acc_failure_category(failures, rules.unsupported_table(spark))
    assert [r[0] for r in rows(marked, "record_category")] == sorted(
        ["unsupported", "sampler_specific_failure", "unexpected_message", "other_applicable_failure"]
    )
    valid = failures.limit(0).unionByName(failures.filter("condition = 'adasyn'"))
    two = marked.filter("record_category in ('unsupported', 'sampler_specific_failure')")
    overall = acc.acc_failure_summary(valid, two).filter("aggregation_level = 'overall'").first()
    assert overall["enumerated_records"] == 3 and overall["applicable_records"] == 2 and overall["sampler_failure_rate"] == 0.5
    assert acc.acc_failure_reasons(marked).count() == 4


def test_schema_types_json_and_finite(spark, rows):
    df = spark.createDataFrame(
        [("d", "0", "1", "c", "k", "[1.0, 0.5]", 1.0), ("d", "x", "1", "c", "k", "[]", float("inf")), (None, "0", "1", "c", "k", "oops", None)],
        "dataset string, seed string, fold string, classifier string, condition string, r string, m double",
    )
    assert rows(acc.acc_schema(df, ["dataset", "zz"])) == [("zz",)]
    assert rows(acc.acc_key_types(df), "problem") == [("dataset is missing",), ("seed is not an integer",)]
    assert rows(acc.acc_json_array(df, "r"), "problem") == [("empty list",), ("invalid JSON",)]
    assert rows(acc.acc_finite(df, ["m"])) == [("m", 2)]


def test_status_plan_gate_and_frozen_manifest(spark, rows, grid):
    df = spark.createDataFrame([("VALID",), ("odd",)], "status string")
    assert rows(acc.acc_status_values(df, ["VALID"])) == [("odd", 1)]
    plan = acc.acc_plan(grid, spark.createDataFrame([], "problem string")).first()
    assert (plan["expected_cells"], plan["status"]) == (495, "READY")
    counts = spark.createDataFrame([("a", 10, 8, 2), ("b", 10, 9, 1)], "dataset string, expected_cells bigint, valid_cells bigint, failure_cells bigint")
    good = spark.createDataFrame([("all", 20, 17, 3)], counts.schema)
    bad = spark.createDataFrame([("all", 20, 18, 3)], counts.schema)
    assert acc.acc_gate_totals(counts, good, 20).count() == 0
    assert rows(acc.acc_gate_totals(counts, bad)) == [("aggregate valid_cells differs from the dataset sum",)]
    a = spark.createDataFrame([(1, ["x"], "p")], "folds int, ids array<string>, status string")
    b = spark.createDataFrame([(1, ["y"], "q")], a.schema)
    assert rows(acc.acc_manifest_frozen(a, b, ["folds", "ids"])) == [("ids",)]


def test_markers(spark, rows):
    specs = spark.createDataFrame([("a", "r", "c", "g"), ("b", "r", "c", "g")], "dataset string, raw_sha256 string, config_sha256 string, registry_sha256 string")
    counts = spark.createDataFrame([("a", 5, 4, 1), ("b", 5, 5, 0)], "dataset string, expected_cells int, valid_cells int, failure_cells int")
    markers = spark.createDataFrame(
        [("a", "complete", "r", "old", "g", 5, 5, 0, [("p", "1")])],
        "dataset string, status string, raw_sha256 string, config_sha256 string, registry_sha256 string, expected_cells int, valid_cells int, failure_cells int, artifacts array<struct<path: string, sha256: string>>",
    )
    digests = spark.createDataFrame([("p", "2")], "path string, sha256 string")
    assert rows(acc.acc_marker_stale(markers, specs, counts, digests)) == [
        ("a", "marker failure_cells differs"),
        ("a", "marker valid_cells differs"),
        ("a", "stale artifact p"),
        ("a", "stale config_sha256"),
        ("b", "complete marker is missing"),
    ]


def test_replay_and_digest(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert acc.acc_replay_match(a, a.repartition(3), ["k", "v"]).count() == 0
    assert rows(acc.acc_replay_match(a, a.distinct(), ["k", "v"])) == [("first", 1, "x", 1)]
    digest = lambda d: acc.acc_table_digest(d).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("k")).repartition(2)) != digest(a.distinct())


def test_shards(spark, rows, tmp_path, grid):
    ids = spark.createDataFrame([("d",), ("b",), ("a",), ("c",)], "dataset string")
    plan = acc.shard_plan(ids, 2, 275)
    assert rows(plan) == [("shard-01", ["a", "c"], 550), ("shard-02", ["b", "d"], 550)]
    assert acc.shard_validate(plan, ids, 275).count() == 0
    assert rows(acc.shard_validate(plan.filter("shard_id = 'shard-02'"), ids, 275)) == [
        ("a is not assigned",),
        ("c is not assigned",),
        ("shard-02 is not consecutive",),
    ]
    roots = []
    for seed in (0, 1):
        root = str(tmp_path / f"s{seed}")
        part = grid.filter("seed % 2 = " + str(seed))
        part.filter("fold > 0").write.parquet(f"{root}/results")
        part.filter("fold = 0").write.parquet(f"{root}/failures")
        roots.append(root)
    out = str(tmp_path / "merged")
    counts = acc.shard_merge(spark, roots, out, grid).first()
    assert (counts["valid_cells"], counts["failure_cells"], counts["violations"]) == (396, 99, 0)
    assert spark.read.parquet(f"{out}/results").count() == 396
    with pytest.raises(Exception, match="exist"):
        acc.shard_merge(spark, roots, out, grid)
    with pytest.raises(ValueError, match="grid"):
        acc.shard_merge(spark, roots[:1], str(tmp_path / "other"), grid)


def test_failure_record_schema(spark):
    cells = spark.createDataFrame([("d", 0, 1, "xgboost", "raw", "numeric")], "dataset_id string, outer_fold int, outer_seed int, classifier string, condition string, feature_type string")
    row = acc.acc_failure_record(cells, "applicability", "ValueError", "no", applicable=False).first()
    assert row["status"] == rules.FAILED and row["resource_status"] == "not_started" and len(row) == 17


def test_more_than_a_hundred_shards(spark):
    ids = spark.createDataFrame([(f"d{i:03d}",) for i in range(240)], "dataset string")
    plan = acc.shard_plan(ids, 120, 275)
    assert plan.select("shard_id").distinct().count() == 120 and acc.shard_validate(plan, ids, 275).count() == 0
    assert [r.problem for r in acc.shard_validate(plan.filter("shard_id <> 'shard-119'"), ids, 275).filter("problem like 'shard%'").collect()] == ["shard-120 is not consecutive"]
