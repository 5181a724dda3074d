"""Cell accounting: every planned cell must have exactly one valid or one failure record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt import rules

KEYS = list(rules.CELL_KEYS)


def acc_expected(datasets: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Full key grid: every dataset row times fixed lists. Lists are exploded in place, nothing is joined."""

    grid = datasets.select("dataset").distinct()
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def v1_dims() -> dict[str, Sequence]:
    return {
        "seed": rules.SEEDS,
        "fold": range(rules.FOLDS),
        "classifier": rules.CLASSIFIERS,
        "condition": rules.CONDITIONS,
    }


def acc_validate(expected: DataFrame, valid: DataFrame, failed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``DF[keys, valid_records, failure_records, state]`` for all expected and observed keys."""

    def side(df, e, v, f):
        return df.select(*keys, F.lit(e).alias("_e"), F.lit(v).alias("_v"), F.lit(f).alias("_f"))

    counts = (
        side(expected, 1, 0, 0)
        .unionByName(side(valid, 0, 1, 0))
        .unionByName(side(failed, 0, 0, 1))
        .groupBy(*keys)
        .agg(F.max("_e").alias("_e"), F.sum("_v").alias("valid_records"), F.sum("_f").alias("failure_records"))
    )
    v, f = F.col("valid_records"), F.col("failure_records")
    state = (
        F.when(F.col("_e") == 0, "extra")
        .when(v + f == 0, "missing")
        .when((v > 0) & (f > 0), "valid and failed")
        .when(v + f > 1, "duplicate")
        .when(v == 1, "valid")
        .otherwise("failed")
    )
    return counts.select(*keys, v, f, state.alias("state"))


def acc_counts(validated: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Expected, valid and failed cells per dataset and the number of keys that break the rule."""

    return validated.groupBy(*by).agg(
        F.count_if(F.col("state") != "extra").alias("expected_cells"),
        F.count_if(F.col("state") == "valid").alias("valid_cells"),
        F.count_if(F.col("state") == "failed").alias("failure_cells"),
        F.count_if(~F.col("state").isin("valid", "failed")).alias("violations"),
    )


def acc_schema(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [(c,) for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "column string")


def acc_key_types(df: DataFrame) -> DataFrame:
    """Key rows that do not read as (text, int, int, text, text): ``DF[keys, problem]``."""

    bad = [
        F.when(F.col(c).cast("string").try_cast("int").isNull(), f"{c} is not an integer") for c in ("seed", "fold")
    ] + [F.when(F.col(c).isNull(), f"{c} is missing") for c in ("dataset", "classifier", "condition")]
    return df.select(*KEYS, F.explode(F.array_compact(F.array(*bad))).alias("problem"))


def acc_json_array(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """JSON arrays that are invalid, empty or not finite: ``DF[keys, problem]``."""

    parsed = F.from_json(F.col(column), "array<double>")
    problem = (
        F.when(parsed.isNull(), "invalid JSON")
        .when(F.size(parsed) == 0, "empty list")
        .when(
            ~F.forall(parsed, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), "invalid numeric values"
        )
    )
    return df.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def _not_finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def acc_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``DF[column, n]``: values that are null, NaN or infinite, all columns in one pass."""

    return df.agg(*[F.count_if(_not_finite(c)).alias(c) for c in cols]).unpivot([], list(cols), "column", "n")


def acc_status_values(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col("status").isin(list(allowed)), F.lit(False))).groupBy("status").agg(
        F.count("*").alias("n")
    )


def acc_failure_record(
    cells: DataFrame,
    stage: str,
    exception_type: str,
    reason: Column | str,
    applicable: bool = True,
    wall_seconds: float = 0.0,
    retry_count: int = 0,
    config_sha256: str = "",
) -> DataFrame:
    """Schema-complete failure rows; metrics are absent, never zero."""

    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return cells.select(
        *rules.CELL_KEYS_V2,
        "feature_type",
        F.lit(stage).alias("stage"),
        F.lit(exception_type).alias("exception_type"),
        reason.alias("reason"),
        F.lit("APPLICABLE" if applicable else "NOT_APPLICABLE").alias("applicability"),
        F.lit(float(wall_seconds)).alias("wall_seconds"),
        F.lit("failed" if applicable else "not_started").alias("resource_status"),
        F.lit(retry_count).cast("bigint").alias("retry_count"),
        F.lit(1).cast("bigint").alias("worker_count"),
        F.lit(False).alias("timeout"),
        F.lit(config_sha256).alias("config_sha256"),
        F.lit(rules.FAILED).alias("status"),
    )


def acc_failure_category(failures: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Adds ``record_category``; an unsupported pair with another message is ``unexpected_message``."""

    marked = failures.join(unsupported, ["feature_type", "condition"], "left")
    forest = (F.col("condition") == "balanced_random_forest") & (F.col("classifier") != "random_forest")
    message = F.when(forest, rules.FOREST_ONLY_MESSAGE).otherwise(F.col("unsupported_message"))
    sampler = F.col("condition").isin(*rules.SAMPLER_CONDITIONS) & (
        (F.col("error") == rules.NO_SAMPLES_MESSAGE) | F.contains(F.col("error"), F.lit(rules.NO_BORDER_MESSAGE))
    )
    category = (
        F.when(message.isNotNull() & message.eqNullSafe(F.col("error")), "unsupported")
        .when(message.isNotNull(), "unexpected_message")
        .when(sampler, "sampler_specific_failure")
        .otherwise("other_applicable_failure")
    )
    return marked.withColumn("record_category", category).drop("unsupported_message")


def acc_failure_summary(valid: DataFrame, failures: DataFrame) -> DataFrame:
    """One overall row and one per feature type, classifier and condition (one pass over a grouping set)."""

    axes = ["feature_type", "classifier", "condition"]
    records = valid.select(*axes, F.lit("valid").alias("record_category")).unionByName(
        failures.select(*axes, "record_category")
    )

    def of(category):
        return F.count_if(F.col("record_category") == category)

    grouped = records.groupingSets([[], axes], *axes).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("enumerated_records"),
        of("unsupported").alias("unsupported_records"),
        of("valid").alias("valid_records"),
        of("sampler_specific_failure").alias("sampler_specific_failures"),
        of("other_applicable_failure").alias("other_applicable_failures"),
    )
    overall = F.col("_g") > 0
    applicable = F.col("enumerated_records") - F.col("unsupported_records")
    attempted = (
        F.col("valid_records") + F.col("sampler_specific_failures") + F.col("other_applicable_failures")
    )
    return grouped.select(
        F.when(overall, "overall").otherwise("feature_classifier_condition").alias("aggregation_level"),
        *[F.when(overall, "all").otherwise(F.col(a)).alias(a) for a in axes],
        "enumerated_records",
        "unsupported_records",
        applicable.alias("applicable_records"),
        attempted.alias("attempted_evaluations"),
        "valid_records",
        "sampler_specific_failures",
        "other_applicable_failures",
        F.try_divide(F.col("sampler_specific_failures").cast("double"), applicable.cast("double")).alias(
            "sampler_failure_rate"
        ),
    )


def acc_failure_reasons(failures: DataFrame) -> DataFrame:
    return failures.groupBy(
        "feature_type", "classifier", "condition", "record_category", "error_type", "error"
    ).agg(F.count("*").alias("records"))


def acc_gate_totals(counts: DataFrame, manifest: DataFrame, total: int | None = None) -> DataFrame:
    """Summed dataset counts against the manifest's aggregate: ``DF[problem]``.

    Both sides are DF[dataset, expected_cells, valid_cells, failure_cells]; the manifest row has dataset ``all``.
    """

    fields = ["expected_cells", "valid_cells", "failure_cells"]
    claimed = manifest.filter("dataset = 'all'").select(F.struct(*fields).alias("m"))
    joined = counts.agg(F.struct(*[F.sum(f).alias(f) for f in fields]).alias("s")).withColumn("m", claimed.scalar())
    problems = [
        F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"m.{f}")), f"aggregate {f} differs from the dataset sum")
        for f in fields
    ]
    problems.append(
        F.when(
            F.col("s.valid_cells") + F.col("s.failure_cells") != F.col("s.expected_cells"), "outputs do not cover the grid"
        )
    )
    if total is not None:
        problems.append(F.when(F.col("s.expected_cells") != total, f"expected cells differ from {total}"))
    return joined.select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def acc_marker_stale(markers: DataFrame, specs: DataFrame, counts: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Completion markers that no longer fit: ``DF[dataset, problem]``.

    markers: DF[dataset, status, raw_sha256, config_sha256, registry_sha256, expected_cells, valid_cells,
    failure_cells, artifacts array<struct<path, sha256>>?]; specs carry the current digests per dataset.
    """

    joined = specs.alias("s").join(markers.alias("m"), "dataset", "left").join(counts.alias("c"), "dataset", "left")
    problems = [
        F.when(F.col("m.status").isNull(), "complete marker is missing"),
        F.when(F.col("m.status") != "complete", "complete marker is not complete"),
        *[
            F.when(F.col("m.status").isNotNull() & ~F.col(f"m.{f}").eqNullSafe(F.col(f"s.{f}")), f"stale {f}")
            for f in ("raw_sha256", "config_sha256", "registry_sha256")
        ],
        *[
            F.when(F.col("m.status").isNotNull() & ~F.col(f"m.{f}").eqNullSafe(F.col(f"c.{f}")), f"marker {f} differs")
            for f in ("expected_cells", "valid_cells", "failure_cells")
        ],
    ]
    found = joined.select("dataset", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    if digests is None:
        return found
    listed = markers.select("dataset", F.explode("artifacts").alias("_a")).select("dataset", "_a.path", "_a.sha256")
    stale = (
        listed.join(digests.select("path", F.col("sha256").alias("_now")), "path", "left")
        .filter(~F.col("sha256").eqNullSafe(F.col("_now")))
        .select("dataset", F.concat(F.lit("stale artifact "), F.col("path")).alias("problem"))
    )
    return found.unionByName(stale)


def acc_manifest_frozen(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields of two one-row manifests that differ: ``DF[field]``. Values are compared as JSON text."""

    def long(df, name):
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(f)).alias(name)) for f in fields])
        return df.select(F.explode(cells).alias("_c")).select("_c.*")

    joined = long(a, "left").join(long(b, "right"), "field", "full")
    return joined.filter(~F.col("left").eqNullSafe(F.col("right"))).select("field")


def acc_plan(expected: DataFrame, violations: DataFrame, trials: int = rules.TRIALS) -> DataFrame:
    """One row that tells what a run would do: datasets, cells, folds, trials, blockers."""

    listed = violations.agg(F.array_sort(F.collect_set("problem")).alias("blockers"))
    return expected.agg(
        F.countDistinct("dataset").alias("dataset_count"),
        F.count("*").alias("expected_cells"),
        F.countDistinct("fold").alias("folds"),
        F.lit(trials).cast("bigint").alias("trials"),
    ).select(
        "*", listed.scalar().alias("blockers")
    ).withColumn("status", F.when(F.size("blockers") == 0, "READY").otherwise("BLOCKED"))


def acc_replay_match(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows on one side only, copies counted: ``DF[side, cols, surplus]``. Empty means an equal replay."""

    counts = (
        a.select(*cols, F.lit(1).alias("_d"))
        .unionByName(b.select(*cols, F.lit(-1).alias("_d")))
        .groupBy(*cols)
        .agg(F.sum("_d").alias("_d"))
        .filter("_d <> 0")
    )
    return counts.select(
        F.when(F.col("_d") > 0, "first").otherwise("replay").alias("side"), *cols, F.abs("_d").alias("surplus")
    )


def acc_run_evidence(results: DataFrame, failures: DataFrame, budget: float, expected: int = 495) -> DataFrame:
    """Per dataset: counts, runtime, peak memory if recorded, and whether budget and cell count hold."""

    memory = F.max("rss_after_mb") if "rss_after_mb" in results.columns else F.lit(None).cast("double")
    ok = results.groupBy("dataset").agg(
        F.count("*").alias("valid_cells"), F.sum("fit_predict_seconds").alias("wall_seconds"), memory.alias("peak_mb")
    )
    bad = failures.groupBy("dataset").agg(F.count("*").alias("failure_cells"))
    return (
        ok.join(bad, "dataset", "full")
        .na.fill(0, ["valid_cells", "failure_cells"])
        .withColumn("within_budget", F.col("wall_seconds") <= budget)
        .withColumn("complete", F.col("valid_cells") + F.col("failure_cells") == expected)
    )


def acc_table_rules(tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]]) -> DataFrame:
    """``DF[table, rule, violations]``: each table is read once, one counter per rule."""

    out = None
    for name, table_rules in checks.items():
        row = tables[name].agg(*[F.count_if(bad).alias(rule) for rule, bad in table_rules.items()])
        part = row.unpivot([], list(table_rules), "rule", "violations").select(
            F.lit(name).alias("table"), "rule", "violations"
        )
        out = part if out is None else out.unionByName(part)
    return out


def analysis_rules() -> dict[str, dict[str, Column]]:
    """Row rules of the derived tables. A rule is the condition under which a row is wrong."""

    p_out = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0.0, 1.0)
    metrics_bad = F.lit(False)
    for m in rules.METRICS:
        metrics_bad = metrics_bad | _not_finite(m)
    status = F.col("status")
    tested = F.col("wilcoxon_p_value").isNotNull()
    exact = F.col("wilcoxon_calibration").isin(
        "exact_no_ties_or_zeros", "exhaustive_sign_permutation", "degenerate_all_zero_p_one"
    )
    minimum = F.col("wilcoxon_min_attainable_p")
    return {
        "cell_means": {
            "fifteen_records": F.col("complete_records") != 15,
            "finite_metrics": metrics_bad,
        },
        "class_means": {"finite_recall": _not_finite("recall"), "class_index": F.col("class_index") < 0},
        "baseline_deltas": {
            "no_raw_self_comparison": F.col("condition") == "raw",
            "finite_delta": _not_finite("delta"),
            "delta_is_difference": F.abs(F.col("alternative_mean") - F.col("raw_mean") - F.col("delta")) > 1e-12,
        },
        "friedman_tests": {
            "known_status": ~status.isin("computed", "skipped"),
            "computed_dimensions": (status == "computed") & ((F.col("n_blocks") < 3) | (F.col("n_conditions") < 3)),
            "computed_p": (status == "computed") & (F.col("p").isNull() | p_out("p")),
            "skipped_reason": (status == "skipped") & F.coalesce(F.col("reason") == "", F.lit(True)),
            "skipped_values": (status == "skipped") & (F.col("stat").isNotNull() | F.col("p").isNotNull()),
        },
        "nemenyi_pvalues": {"ordered_pair": F.col("a") >= F.col("b"), "p_range": p_out("p")},
        "wilcoxon_effects": {
            "no_raw_self_comparison": F.col("condition") == "raw",
            "known_status": ~status.isin("computed", "descriptive", "skipped"),
            "computed_pairs": (status == "computed") & (F.col("n_pairs") < 3),
            "computed_p": (status == "computed") & (~tested | p_out("wilcoxon_p_value") | p_out("holm_p_value")),
            "computed_interval": (status == "computed")
            & F.coalesce(F.col("bootstrap_low") > F.col("bootstrap_high"), F.lit(True)),
            "descriptive_pairs": (status == "descriptive") & ~F.col("n_pairs").isin(1, 2),
            "descriptive_p": (status == "descriptive") & tested,
            "skipped_pairs": (status == "skipped") & ((F.col("n_pairs") != 0) | F.col("reason").isNull()),
            "effective_pairs": (F.col("wilcoxon_effective_n") < 0) | (F.col("wilcoxon_effective_n") > F.col("n_pairs")),
            "exact_minimum_p": exact & F.coalesce((minimum <= 0) | (minimum > 1), F.lit(True)),
            "no_minimum_p_unless_exact": F.coalesce(~exact, F.lit(True)) & minimum.isNotNull(),
            "outcome_sum": F.col("wins") + F.col("ties") + F.col("losses") != F.col("n_pairs"),
            "holm_not_below_raw": tested & (F.col("holm_p_value") < F.col("wilcoxon_p_value") - 1e-12),
        },
        "failure_accounting": {
            "applicable_is_attempted": F.col("applicable_records") != F.col("attempted_evaluations"),
            "parts_sum": F.col("applicable_records") + F.col("unsupported_records") != F.col("enumerated_records"),
            "rate": F.col("sampler_failure_rate").isNotNull() & ~F.col("sampler_failure_rate").between(0.0, 1.0),
        },
    }


def acc_table_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table: ``DF[rows, digest]``.

    Row hashes are added up in two independent 38-digit sums instead of being collected and sorted, so any
    number of rows takes one map-side aggregate.
    """

    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)

    def part(start):
        return F.sum(F.conv(F.substring(digest, start, 13), 16, 10).cast("decimal(20,0)"))

    sums = df.agg(F.count("*").alias("rows"), *[part(s).alias(f"_{s}") for s in (1, 14, 27, 40)])
    return sums.select(
        "rows", F.sha2(F.concat_ws(":", "rows", *[F.col(f"_{s}").cast("string") for s in (1, 14, 27, 40)]), 256).alias("digest")
    )


# ---- shards ------------------------------------------------------------------------------------


def shard_plan(ids: DataFrame, n: int, cells_per_dataset: int) -> DataFrame:
    """Sorted dataset ids dealt round robin: ``DF[shard_id, dataset_ids, expected_cells]``.

    The ids are one row per dataset of a registry (tens of rows), reduced before they are ordered.
    """

    order = Window.orderBy("dataset")
    dealt = (
        ids.select("dataset")
        .distinct()
        .withColumn("_s", (F.row_number().over(order) - 1) % n)
        .groupBy("_s")
        .agg(F.array_sort(F.collect_list("dataset")).alias("dataset_ids"))
    )
    return dealt.select(
        F.format_string("shard-%02d", F.col("_s") + 1).alias("shard_id"),
        "dataset_ids",
        (F.size("dataset_ids") * cells_per_dataset).cast("bigint").alias("expected_cells"),
    )


def shard_validate(plan: DataFrame, ids: DataFrame, cells_per_dataset: int) -> DataFrame:
    """``DF[problem]``: coverage exactly once, consecutive shard ids, sorted members, cell counts."""

    # By number, so shard-100 follows shard-99; ids without a number come last.
    number = F.expr("try_cast(substring_index(shard_id, '-', -1) AS bigint)")
    place = F.row_number().over(Window.orderBy(number.asc_nulls_last(), "shard_id"))
    shard_problems = plan.withColumn("_want", F.format_string("shard-%02d", place)).select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("shard_id") != F.col("_want"), F.concat("shard_id", F.lit(" is not consecutive"))),
                    F.when(F.size("dataset_ids") == 0, F.concat("shard_id", F.lit(" is empty"))),
                    F.when(
                        F.col("dataset_ids") != F.array_sort("dataset_ids"), F.concat("shard_id", F.lit(" is not sorted"))
                    ),
                    F.when(
                        F.col("expected_cells") != F.size("dataset_ids") * cells_per_dataset,
                        F.concat("shard_id", F.lit(" has a wrong cell count")),
                    ),
                )
            )
        ).alias("problem")
    )
    planned = plan.select(F.explode("dataset_ids").alias("dataset")).groupBy("dataset").agg(F.count("*").alias("_n"))
    locked = ids.select("dataset").distinct().withColumn("_l", F.lit(True))
    coverage = planned.join(locked, "dataset", "full").select(
        F.concat(
            "dataset",
            F.when(F.col("_n").isNull(), " is not assigned")
            .when(F.col("_l").isNull(), " is not locked")
            .when(F.col("_n") > 1, " is assigned more than once"),
        ).alias("problem")
    )
    return shard_problems.unionByName(coverage.filter(F.col("problem").isNotNull()))


def shard_merge(spark, roots: Sequence[str], out: str, expected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Validates the shard outputs together, then writes one results and one failures table.

    Each root holds ``results`` and ``failures`` parquet folders. An existing output is an error, and nothing is
    written when a cell is missing, extra, doubled or both valid and failed. Returns the counts per dataset.
    """

    def read(name):
        parts = [spark.read.parquet(f"{root}/{name}") for root in roots]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        return merged

    results, failures = read("results"), read("failures")
    counts = acc_counts(acc_validate(expected, results, failures, keys))
    broken = counts.agg(F.sum("violations").alias("n")).first()["n"]
    if broken:
        raise ValueError(f"shard outputs do not match the grid: {broken} cells")
    results.write.mode("errorifexists").parquet(f"{out}/results")
    failures.write.mode("errorifexists").parquet(f"{out}/failures")
    return counts
