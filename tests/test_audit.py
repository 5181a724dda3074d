import pytest
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators import audit as aud


@pytest.fixture
def small(spark):
    data = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, "b", "y"), (5, "a", "z"), (6, "b", "z")]
    return spark.createDataFrame(data, "amount int, segment string, target string")


def test_profile(small):
    row = aud.aud_profile(small, [], "target").first()
    assert (row["n_rows"], row["n_classes"], row["n_min"], row["n_max"], row["ir"], row["d_raw"]) == (6, 3, 2, 2, 1.0, 2)
    assert not row["has_missing"] and aud.aud_feature_type(small.schema, "target") == "mixed"
    assert aud.aud_class_counts(small, [], "target").first()[0] == "x:2|y:2|z:2"


def test_profile_without_labels(spark):
    row = aud.aud_profile(spark.createDataFrame([(1, None)], "a int, t string"), [], "t").first()
    assert (row["n_classes"], row["n_min"], row["ir"], row["has_missing"]) == (0, 0, None, True)


def test_class_share(spark, rows):
    df = spark.createDataFrame([("d", "a:1|b:x:3".replace("x:", ""))], "id string, class_counts string")
    assert rows(aud.aud_class_share(df, ["id"])) == [("d", 0, "a", 0.25), ("d", 1, "b", 0.75)]


@pytest.mark.parametrize(
    ("ir", "band"),
    [(1.99, "near_balanced_ir_lt_2"), (2.0, "mild_ir_2_to_5"), (5.0, "moderate_ir_5_to_20"), (20.0, "moderate_ir_5_to_20"), (20.01, "severe_ir_gt_20")],
)
def test_band_borders(spark, ir, band):
    assert spark.range(1).select(aud.aud_band(F.lit(ir)).alias("b")).first()["b"] == band


def test_duplicates_conflicts_missing(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (1, None, "y"), (2, 1, "x")], "a int, b int, t string")
    assert rows(aud.aud_duplicates(df, [], df.columns)) == [(1,)]
    assert rows(aud.aud_label_conflict(df, [], ["a", "b"], "t")) == [(1,)]
    assert rows(aud.aud_missing(df)) == [("a", 0), ("b", 3), ("t", 0)]


def test_column_names(spark, rows):
    assert rows(aud.aud_suspicious(spark, ["Patient_ID", "event_timestamp", "x"])) == [("Patient_ID", "group"), ("event_timestamp", "time")]
    assert rows(aud.aud_score_guard(spark, ["Macro_F1", "n_rows"])) == [("Macro_F1",)]
    assert aud.aud_expected_conditions(spark).count() == len(rules.NUMERIC_CONDITIONS) + len(rules.MIXED_CONDITIONS)


def registry_row(**changes):
    row = {
        "dataset_id": "d1",
        "source_id": "s1",
        "task_type": "single-label-classification",
        "n_rows": "100",
        "n_classes": "3",
        "n_min_class": "10",
        "ir_majority_minority": "2.5",
        "feature_type": "numeric",
        "has_groups": "False",
        "has_time_order": "False",
        "leakage_status": "Pass; fine",
        "imbalance_band": "mild_ir_2_to_5",
        "eligible": "True",
        "exclusion_reason": "",
        "applicable_conditions": ";".join(sorted(rules.NUMERIC_CONDITIONS)),
    }
    return {**row, **changes}


def check(spark, **changes):
    row = registry_row(**changes)
    return aud.aud_eligibility(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))).first()


def test_eligibility_rules(spark):
    good = check(spark)
    assert good["expected_eligible"] and good["agrees"] and good["problem"] is None
    assert "grouped data" in check(spark, has_groups="unknown")["reasons"]
    assert "minimum row" in check(spark, n_min_class="9")["reasons"]
    assert "imbalance_band" in check(spark, imbalance_band="severe_ir_gt_20")["reasons"]
    assert "applicability mismatch" in check(spark, applicable_conditions="raw")["reasons"]
    assert check(spark, n_rows="many")["problem"] == "invalid numeric eligibility metadata"
    assert check(spark, eligible="False", has_groups="True")["problem"] == "ineligible row has no exclusion_reason"


def test_quota_reports_lack(spark):
    df = spark.createDataFrame([("numeric", "mild_ir_2_to_5", "True")], "feature_type string, imbalance_band string, eligible string")
    got = {r["value"]: (r["n"], r["ok"]) for r in aud.aud_quota(df).collect()}
    assert got["numeric"] == (1, False) and got["40-60"] == (1, False) and len(got) == 7


def test_unique_and_reconciliation(spark, rows):
    df = spark.createDataFrame([(" a",), ("a ",), ("",), ("b",)], "v string")
    assert rows(aud.aud_unique_nonempty(df, "v")) == [("", 1, "empty"), ("a", 2, "duplicate")]
    a = spark.createDataFrame([("1", "v1 long", "AB", "x"), ("2", "v", "c", "y")], "id string, source_version string, raw_sha256 string, source string")
    b = spark.createDataFrame([("1", "v1", "ab", "z"), ("3", "v", "c", "y")], a.schema)
    assert rows(aud.aud_reconcile_keys(a, b, "id")) == [("2", "left only"), ("3", "right only")]
    assert rows(aud.aud_reconcile_fields(a, b, "id", ["source_version", "raw_sha256", "source"])) == [("1", "source", "x", "z")]


def test_applicability(spark, rows):
    lists = [("a", "raw; numeric"), ("b", ""), ("c", "raw;;smote"), ("d", "raw;magic"), ("e", "raw;raw"), ("f", "categorical-only;raw")]
    df = spark.createDataFrame(lists, "dataset_id string, applicable_families string")
    got = {r["dataset_id"]: (r["conditions"], r["errors"]) for r in aud.aud_applicability_parse(df, "applicable_families").collect()}
    assert got["a"] == (["numeric", "raw"], None)
    assert got["d"][1] == "unknown applicability condition(s): magic" and "duplicate" in got["e"][1] and "empty" in got["b"][1] and "empty" in got["c"][1]
    typed = df.withColumn("feature_type", F.when(F.col("dataset_id") == "f", "categorical").otherwise("mixed"))
    assert rows(aud.aud_applicability_type(typed), "dataset_id") == [("a",)]


def test_normalisers(spark):
    df = spark.createDataFrame([(" Yes ", "1e3", "2024-01-02T03:04:05+00:00", r"A\B/C"), ("?", "NaN", "later", None)], "b string, n string, t string, p string")
    got = df.select(*[aud.aud_normalise(c, k).alias(c) for c, k in (("b", "bool"), ("n", "number"), ("t", "timestamp"), ("p", "path"))]).collect()
    assert (got[0]["b"], got[0]["n"], got[0]["p"]) == (True, 1000.0, "a/b/c") and got[0]["t"] is not None
    assert tuple(got[1]) == (None, None, None, "")


def test_provenance_scope_and_support(spark, rows):
    columns = ["dataset_id", "eligible", "exclusion_reason", "leakage_status", "feature_type", "applicable_families", *rules.PROVENANCE_FIELDS]
    full = ["x"] * len(rules.PROVENANCE_FIELDS)
    data = [
        ("a", "true", "", "pass", "numeric", "numeric;raw", *full),
        ("b", "true", "why", "pending", "mixed", "mixed;raw", *full[:-1], ""),
        ("c", "false", "", "", "mixed", "mixed", *full),
    ]
    reg = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    problems = aud.aud_eligible_provenance(reg)
    assert {r["dataset_id"] for r in problems.collect()} == {"b", "c"} and problems.count() == 5
    row = aud.aud_scope_summary(reg, problems).first()
    assert row["status"] == "pending" and row["dataset_ids"] == ["a", "b"] and len(row["blockers"]) == 5
    assert aud.aud_scope_summary(reg.filter("dataset_id = 'a'"), problems.limit(0)).first()["status"] == "ready"
    profile = spark.createDataFrame([(2, 10), (3, 4), (3, 5)], "n_classes int, n_min int")
    assert aud.aud_min_support(profile, 5).count() == 2


def test_files_and_evidence(spark, rows):
    manifest = spark.createDataFrame(
        [("a", "p1", "a" * 64, "3"), ("b", "p2", "zz", "0"), ("c", "p3", "b" * 64, "5")], "dataset_id string, local_path string, raw_sha256 string, file_size_bytes string"
    )
    digests = spark.createDataFrame([("p1", 3, "a" * 64), ("p3", 6, "c" * 64)], "path string, length bigint, sha256 string")
    assert rows(aud.aud_verify_files(manifest, digests)) == [
        ("b", "file is missing"),
        ("b", "invalid SHA-256"),
        ("b", "invalid byte size"),
        ("c", "SHA-256 does not match"),
        ("c", "byte size does not match"),
    ]
    key = "dataset string, seed int, fold int, classifier string, condition string"
    results = spark.createDataFrame([("a", 0, 0, "x", "raw"), ("z", 0, 0, "x", "raw")], key)
    failed = spark.createDataFrame([("a", 0, 1, "x", "raw")], key)
    evidence = spark.createDataFrame(
        [("a", 2, 1, 1, 5.0, 10.0, 1.0, "passed", "passed", "complete"), ("b", 2, 1, 1, 20.0, 10.0, None, "passed", "no", "complete")],
        "dataset_id string, expected_cells int, valid_cells int, failure_cells int, wall_clock_seconds double, runtime_budget_seconds double, peak_mb double, deterministic_replay string, failure_review string, output_completeness string",
    )
    found = rows(aud.aud_pilot_evidence(evidence, results, failed, 2))
    assert ("z", "output of a dataset without evidence") in found and not [r for r in found if r[0] == "a"]
    assert {p for d, p in found if d == "b"} >= {"evidence without output", "runtime exceeds the budget", "failure review is not passed", "peak memory has no finite value"}


def test_selection(spark):
    bands = list(rules.BAND_QUOTAS)
    rows = [(100 + i, f"set{i % 70}", "mixed" if i % 3 == 0 else "numeric", bands[i % 4]) for i in range(90)] + [(11, "Kept", "numeric", bands[0]), (12, "mfeat-a", "numeric", bands[0]), (14, "mfeat-b", "numeric", bands[0])]
    catalog = spark.createDataFrame(rows, "data_id bigint, name string, feature_type string, band string")
    deduped = {r["data_id"] for r in aud.sel_dedupe(catalog).collect()}
    assert len(deduped) == 72 and 12 in deduped and 14 not in deduped and 170 not in deduped
    chosen = aud.sel_quota(catalog, [11], [170]).collect()
    assert len(chosen) == 45 and 11 in {r["data_id"] for r in chosen}
    assert sum(r["feature_type"] == "mixed" for r in chosen) >= 10 and sum(r["feature_type"] == "numeric" for r in chosen) >= 20
    for band, n in rules.BAND_QUOTAS.items():
        assert sum(r["band"] == band for r in chosen) >= n
    with pytest.raises(ValueError):
        aud.sel_quota(catalog.limit(5), [], [])
