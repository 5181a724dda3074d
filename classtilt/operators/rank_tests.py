"""Paired and blocked rank tests, resampling tests and multiplicity, all as grouped expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.functions import (
    explode_counts,
    fn_avg_rank,
    fn_chi2_sf,
    fn_norm_cdf,
    fn_range_sf,
    hash_key,
    order_hash,
    rank_sum_tail,
)
from classtilt.operators.cells import (
    GROUP,

    cell_long,
    comparison_grid,
    family_blocks,
    in_families,
    outcome_counts,
    st_baseline_deltas,
    st_effects,
)

PAIR = [*GROUP, "condition"]
MAX_PATTERN_BLOCKS = 20


def _ranked(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ascending average ranks inside each block and the size of the row's tie."""

    block = [*keys, "dataset"]
    return blocks.withColumn("rank", fn_avg_rank(F.col("value"), block)).withColumn(
        "_tied", F.count("*").over(Window.partitionBy(*block, "value"))
    )


def _friedman(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DF[keys, n_blocks, n_conditions, tie_correction, stat]``; ties enter as sum over rows of t^2 - 1."""

    sums = ranked.groupBy(*keys, "condition").agg(
        F.sum("rank").alias("_sum"),
        F.count("*").alias("_n"),
        F.sum(F.col("_tied") * F.col("_tied") - 1).alias("_ties"),
    )
    facts = sums.groupBy(*keys).agg(
        F.max("_n").alias("n_blocks"),
        F.count("*").alias("n_conditions"),
        F.sum(F.col("_sum") * F.col("_sum")).alias("_squares"),
        F.sum("_ties").alias("_ties"),
    )
    n, k = F.col("n_blocks").cast("double"), F.col("n_conditions").cast("double")
    correction = F.lit(1.0) - F.try_divide(F.col("_ties").cast("double"), n * (k * k * k - k))
    plain = F.lit(12.0) / (n * k * (k + 1)) * F.col("_squares") - F.lit(3.0) * n * (k + 1)
    return facts.select(
        *keys,
        "n_blocks",
        "n_conditions",
        correction.alias("tie_correction"),
        F.when(correction > 0, plain / correction).alias("stat"),
    )


def st_friedman(cell: DataFrame) -> DataFrame:
    """One row per family, classifier and metric: computed, or skipped with the first reason that applies.

    Order of the reasons: conditions, blocks, incomplete matrix.
    """

    spark = cell.sparkSession
    families = (
        rules.family_table(spark)
        .groupBy("family", "classifier")
        .agg(F.array_sort(F.collect_list("condition")).alias("_family"))
        .withColumn("metric", F.explode(rules.strings(rules.METRICS)))
    )
    present = in_families(cell_long(cell)).groupBy(*GROUP).agg(F.collect_set("condition").alias("_have"))
    computed = _friedman(_ranked(family_blocks(cell), GROUP), GROUP)
    joined = families.join(present, GROUP, "left").join(computed.drop("n_conditions"), GROUP, "left")
    have = F.coalesce("_have", F.array().cast("array<string>"))
    lacking = F.array_join(F.array_except("_family", have), ", ")
    n_conditions = F.size(have).cast("bigint")
    n_blocks = F.coalesce("n_blocks", F.lit(0)).cast("bigint")
    reason = (
        F.when(n_conditions < 3, "fewer than three complete conditions")
        .when(n_blocks < rules.MIN_BLOCKS, "fewer than three complete dataset blocks")
        .when(lacking != "", F.concat(F.lit("incomplete condition matrix: "), lacking))
    )
    shown = joined.select(
        *GROUP, n_blocks.alias("n_blocks"), n_conditions.alias("n_conditions"), F.when(reason.isNull(), F.col("stat")).alias("stat"), reason.alias("reason")
    )
    return shown.select(
        *GROUP,
        "n_blocks",
        "n_conditions",
        "stat",
        fn_chi2_sf(F.col("stat"), F.col("n_conditions") - 1).alias("p"),
        F.when(F.col("reason").isNull(), "computed").otherwise("skipped").alias("status"),
        "reason",
    )


def st_friedman_pilot(rec: DataFrame) -> DataFrame:
    """Feasibility variant on all records: reasons in the order blocks, conditions, incomplete block."""

    keys = ["feature_type", "classifier", "metric"]
    long = (
        rec.groupBy("feature_type", "classifier", "dataset", "condition")
        .agg(*[F.avg(m).alias(m) for m in rules.METRICS])
        .unpivot(["feature_type", "classifier", "dataset", "condition"], list(rules.METRICS), "metric", "value")
    )
    shape = long.groupBy(*keys).agg(
        F.countDistinct("dataset").alias("n_blocks"),
        F.countDistinct("condition").alias("n_conditions"),
        F.count("value").alias("_cells"),
    )
    computed = _friedman(_ranked(long, keys), keys).select(*keys, "stat")
    reason = (
        F.when(F.col("n_blocks") < 3, "fewer than three dataset blocks")
        .when(F.col("n_conditions") < 3, "fewer than three conditions for Friedman test")
        .when(F.col("_cells") != F.col("n_blocks") * F.col("n_conditions"), "incomplete dataset-by-condition block")
    )
    shown = shape.join(computed, keys, "left").withColumn("reason", reason)
    shown = shown.withColumn("stat", F.when(F.col("reason").isNull(), F.col("stat")))
    return shown.select(
        *keys,
        "n_blocks",
        "n_conditions",
        "stat",
        fn_chi2_sf(F.col("stat"), F.col("n_conditions") - 1).alias("p"),
        F.when(F.col("reason").isNull(), "computed").otherwise("skipped").alias("status"),
        "reason",
    )


def st_mean_ranks(cell: DataFrame) -> DataFrame:
    """``DF[group, condition, mean_rank, n_blocks]`` over family-complete blocks."""

    ranked = _ranked(family_blocks(cell), GROUP)
    return ranked.groupBy(*GROUP, "condition").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_blocks"))


def st_nemenyi(ranks: DataFrame, friedman: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Condition pairs (a < b by text) of significant Friedman rows: ``DF[group, a, b, p]``.

    A family has at most nine conditions, so a group is an array of nine and its pairs are unfolded in place.
    """

    lists = ranks.groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct("condition", "mean_rank"))).alias("_r"), F.max("n_blocks").alias("n")
    )
    significant = friedman.filter((F.col("status") == "computed") & (F.col("p") < alpha)).select(*GROUP)
    pairs = (
        lists.join(significant, GROUP, "left_semi")
        .select(*GROUP, "n", F.size("_r").alias("k"), "_r", F.explode("_r").alias("_a"))
        .withColumn("_b", F.explode(F.filter("_r", lambda c: c["condition"] > F.col("_a.condition"))))
    )
    k = F.col("k").cast("double")
    q = F.abs(F.col("_a.mean_rank") - F.col("_b.mean_rank")) / F.sqrt(k * (k + 1) / (F.col("n") * 6.0)) * F.sqrt(F.lit(2.0))
    return pairs.select(
        *GROUP,
        F.col("_a.condition").alias("a"),
        F.col("_b.condition").alias("b"),
        q.alias("_q"),
        "k",
    ).repartition(*GROUP, "a", "b").select(*GROUP, "a", "b", fn_range_sf(F.col("_q"), F.col("k").cast("double")).alias("p"))


def _signed(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group facts of the signed ranks. Only exact zeros are dropped before ranking.

    Ranks are listed for at most 50 pairs, the range where an exact p is wanted.
    """

    whole = Window.partitionBy(*keys)
    size = F.col("delta").isNotNull()
    nonzero = F.when(F.col("delta") != 0, F.abs("delta"))
    ranked = (
        delta.withColumn("_n", F.count(F.when(size, 1)).over(whole))
        .withColumn("_abs", nonzero)
        .withColumn("_rank", F.when(F.col("_abs").isNotNull(), fn_avg_rank(F.col("_abs"), [*keys, F.col("_abs").isNotNull()])))
        .withColumn("_tied", F.count("*").over(Window.partitionBy(*keys, "_abs")))
    )
    live = F.col("_abs").isNotNull()
    return ranked.groupBy(*keys).agg(
        F.max("_n").alias("n_pairs"),
        F.count("_abs").alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("_rank"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("_rank"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.max(F.when(live, F.col("_tied") > 1)), F.lit(False)).alias("tied"),
        F.coalesce(F.sum(F.when(live, F.col("_tied") * F.col("_tied") - 1)), F.lit(0)).alias("tie_term"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= 50, F.col("_rank")))).alias("ranks"),
    )


def st_rank_biserial(delta: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """``(W+ - W-) / (n (n + 1) / 2)`` over the non-zero pairs, 0 when there are none."""

    n = F.col("n_nonzero").cast("double")
    r = F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_minus"), n * (n + 1) / 2), F.lit(0.0))
    return _signed(delta, keys).select(*keys, r.alias("rank_biserial"))


def _calibration() -> Column:
    return (
        F.when(F.col("n_pairs") < 3, "not_run_below_three_pairs")
        .when(F.col("n_nonzero") == 0, "degenerate_all_zero_p_one")
        .when(
            (F.col("n_pairs") <= 50) & ~F.col("tied") & (F.col("n_nonzero") == F.col("n_pairs")),
            "exact_no_ties_or_zeros",
        )
        .when(F.col("n_pairs") <= 13, "exhaustive_sign_permutation")
        .otherwise("asymptotic")
    )


def st_wilcoxon_calibration(delta: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """``DF[keys, wilcoxon_calibration, wilcoxon_effective_n, wilcoxon_min_attainable_p]``."""

    label = F.col("wilcoxon_calibration")
    minimum = F.when(label == "degenerate_all_zero_p_one", 1.0).when(
        label.isin("exact_no_ties_or_zeros", "exhaustive_sign_permutation"),
        F.lit(2.0) / F.pow(F.lit(2.0), F.col("n_nonzero")),
    )
    return (
        _signed(delta, keys)
        .withColumn("wilcoxon_calibration", _calibration())
        .select(
            *keys,
            "wilcoxon_calibration",
            F.col("n_nonzero").alias("wilcoxon_effective_n"),
            minimum.alias("wilcoxon_min_attainable_p"),
        )
    )


def st_wilcoxon(delta: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """``DF[keys, wilcoxon_statistic, wilcoxon_p_value]``, two-sided; null below three pairs."""

    n = F.col("n_nonzero").cast("double")
    mean = n * (n + 1) / 4
    spread = F.sqrt(n * (n + 1) * (n * 2 + 1) / 24 - F.col("tie_term") / F.lit(48.0))
    normal = fn_norm_cdf(-F.abs(F.try_divide(F.col("w_plus") - mean, spread))) * 2
    label = F.col("_label")
    p = (
        F.when(label == "degenerate_all_zero_p_one", 1.0)
        .when(label == "asymptotic", normal)
        .when(label != "not_run_below_three_pairs", F.least(F.lit(1.0), rank_sum_tail(F.col("ranks"), F.col("w_plus"))))
    )
    run = label != "not_run_below_three_pairs"
    return (
        _signed(delta, keys)
        .withColumn("_label", _calibration())
        .select(
            *keys,
            F.when(run, F.least("w_plus", "w_minus")).alias("wilcoxon_statistic"),
            p.alias("wilcoxon_p_value"),
        )
    )


def st_signed_rank_exact(delta: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Exact signed-rank p over all sign patterns of the non-zero pairs; above 20 pairs p stays null."""

    n = F.col("n_nonzero")
    fits = n <= MAX_PATTERN_BLOCKS
    patterns = F.when(fits, F.pow(F.lit(2.0), n).cast("bigint"))
    return _signed(delta, keys).select(
        *keys,
        F.least("w_plus", "w_minus").alias("wilcoxon_statistic"),
        F.when(fits, rank_sum_tail(F.col("ranks"), F.col("w_plus"))).alias("exact_p_value"),
        n.alias("n_nonzero_pairs"),
        patterns.alias("sign_patterns"),
        F.when(n == 0, 1.0).when(fits, F.lit(2.0) / patterns).alias("minimum_attainable_p"),
        F.when(~fits, "more than 20 non-zero pairs").alias("reason"),
    )


def st_holm(df: DataFrame, keys: Sequence[str], p: str, name: str = "holm") -> DataFrame:
    """Step-down adjusted p inside each family; null p values are not members of it."""

    family = Window.partitionBy(*keys)
    order = family.orderBy(F.col(p).asc_nulls_last())
    size = F.count(p).over(family)
    step = F.when(F.col(p).isNotNull(), (size - F.row_number().over(order) + 1) * F.col(p))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_step", step)
        .withColumn(
            f"{name}_p_value", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(running)))
        )
        .withColumn(f"{name}_family_size", size)
        .drop("_step")
    )


def st_bootstrap_ci(delta: DataFrame, n: int = 10_000, seed: int = 0, keys: Sequence[str] = PAIR) -> DataFrame:
    """95 % percentile interval of the mean over ``n`` resamples of the dataset blocks.

    A pick depends on (seed, resample, slot) only. Each resample is one row, computed where it is generated.
    """

    blocks = delta.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dataset", "delta"))).alias("_d"))
    runs = explode_counts(blocks.withColumn("_runs", F.lit(n).cast("bigint")), "_runs", "r", 1000)
    size = F.size("_d")
    pick = lambda s: F.element_at("_d", (hash_key(seed, F.col("r"), s) % size + 1).cast("int"))["delta"]
    mean = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda a, s: a + pick(s)) / size
    ends = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        runs.select(*keys, mean.alias("_m"))
        .groupBy(*keys)
        .agg(ends.alias("_e"))
        .select(*keys, F.col("_e")[0].alias("bootstrap_low"), F.col("_e")[1].alias("bootstrap_high"))
    )


def _permutation(blocks: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    ranked = _ranked(blocks, keys)
    observed = _friedman(ranked, keys).filter((F.col("n_blocks") >= 3) & (F.col("n_conditions") >= 3))
    rows = (
        ranked.groupBy(*keys, "dataset")
        .agg(F.array_sort(F.collect_list(F.struct("condition", "rank"))).alias("ranks"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("dataset", "ranks"))).alias("_blocks"))
        .join(observed, list(keys))
        .withColumn("_runs", F.lit(n).cast("bigint"))
    )
    runs = explode_counts(rows, "_runs", "r", 250)

    def shuffled(block):
        keyed = F.transform(
            block["ranks"],
            lambda c: F.struct(
                order_hash(seed, F.col("r"), block["dataset"], c["condition"]).alias("h"), c["rank"].alias("v")
            ),
        )
        return F.transform(F.array_sort(keyed), lambda c: c["v"])

    zeros = F.array_repeat(F.lit(0.0), F.col("n_conditions").cast("int"))
    sums = F.aggregate("_blocks", zeros, lambda a, b: F.zip_with(a, shuffled(b), lambda p, q: p + q))
    blocks_n, k = F.col("n_blocks").cast("double"), F.col("n_conditions").cast("double")
    squares = F.aggregate(sums, F.lit(0.0), lambda a, v: a + v * v)
    statistic = (
        F.lit(12.0) / (blocks_n * k * (k + 1)) * squares - F.lit(3.0) * blocks_n * (k + 1)
    ) / F.col("tie_correction")
    return (
        runs.withColumn("_hit", statistic >= F.col("stat") - 1e-12)
        .groupBy(*keys, "n_blocks", "n_conditions", "stat", "tie_correction")
        .agg(F.count_if("_hit").alias("permutation_exceedances"), F.count("*").alias("permutation_resamples"))
        .withColumn(
            "permutation_p_value", (F.col("permutation_exceedances") + 1) / (F.col("permutation_resamples") + 1)
        )
        .withColumn(
            "permutation_monte_carlo_se",
            F.sqrt(
                F.col("permutation_p_value") * (1 - F.col("permutation_p_value")) / (F.col("permutation_resamples") + 1)
            ),
        )
        .withColumn("asymptotic_p_value", fn_chi2_sf(F.col("stat"), F.col("n_conditions") - 1))
    )


def st_friedman_permutation(cell: DataFrame, n: int = 200_000, seed: int = 0) -> DataFrame:
    """Monte Carlo Friedman test: ranks are shuffled inside each block; plus-one p and its standard error."""

    return _permutation(family_blocks(cell), n, seed, GROUP)


def st_sign_flip(cell: DataFrame) -> DataFrame:
    """Exact mean-difference sign flips for every condition pair of a family, up to 20 blocks.

    Patterns of a pair are generated in two steps so that 2^20 rows are spread before they are made, and only
    counts are shuffled afterwards.
    """

    blocks = family_blocks(cell)
    lists = (
        blocks.groupBy(*GROUP, "condition", "position")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dataset", "value"))), lambda c: c["value"]).alias("v"))
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("position", "condition", "v"))).alias("_c"))
    )
    pairs = (
        lists.select(*GROUP, "_c", F.explode("_c").alias("_a"))
        .withColumn("_b", F.explode(F.filter("_c", lambda c: c["position"] > F.col("_a.position"))))
        .select(
            *GROUP,
            F.col("_a.condition").alias("a"),
            F.col("_b.condition").alias("b"),
            F.zip_with("_a.v", "_b.v", lambda p, q: p - q).alias("_d"),
        )
        .withColumn("n_blocks", F.size("_d").cast("bigint"))
        .filter(F.col("n_blocks") >= rules.MIN_BLOCKS)
        .withColumn("mean", F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / F.col("n_blocks"))
        .withColumn(
            "sign_patterns",
            F.when(F.col("n_blocks") <= MAX_PATTERN_BLOCKS, F.expr("shiftleft(1L, cast(n_blocks AS int))")),
        )
    )
    flips = explode_counts(pairs, "sign_patterns", "_s")
    signed = F.aggregate(
        F.zip_with(
            "_d",
            F.sequence(F.lit(0), F.size("_d") - 1),
            lambda v, i: F.when(F.expr("_s - 1").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) > 0, v).otherwise(-v),
        ),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    hit = F.abs(signed / F.col("n_blocks")) >= F.abs("mean") - 1e-12
    keys = [*GROUP, "a", "b"]
    hits = flips.withColumn("_hit", hit).groupBy(*keys).agg(F.count_if("_hit").alias("_hits"))
    return pairs.join(hits, keys, "left").select(
        *keys,
        "mean",
        "n_blocks",
        "sign_patterns",
        (F.col("_hits") / F.col("sign_patterns")).alias("exact_p_value"),
    )


def st_comparisons(cell: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """The full comparison table: effects, effect size, interval, signed-rank test and Holm per family."""

    delta = st_baseline_deltas(cell)
    n = F.col("n_pairs")
    table = (
        st_effects(delta, comparison_grid(cell))
        .join(st_rank_biserial(delta), PAIR, "left")
        .join(st_bootstrap_ci(delta, resamples, seed), PAIR, "left")
        .join(st_wilcoxon(delta), PAIR, "left")
        .join(st_wilcoxon_calibration(delta), PAIR, "left")
        .na.fill(0, ["wilcoxon_effective_n"])
        .na.fill("not_run_below_three_pairs", ["wilcoxon_calibration"])
        .withColumn(
            "bootstrap_interpretation",
            F.when(n == 0, "not_available")
            .when(n < rules.MIN_BLOCKS, "descriptive_only_below_minimum_three_blocks")
            .otherwise("paired_dataset_block_percentile_interval"),
        )
    )
    return st_holm(table, GROUP, "wilcoxon_p_value")


def st_primary_sensitivity(cell: DataFrame, n: int = 200_000, seed: int = 0):
    """(omnibus, pairwise) for numeric_core / xgboost / macro_f1 only, Holm over the condition pairs."""

    conditions = rules.FAMILIES["numeric_core"][1]
    one = cell.filter(
        (F.col("feature_type") == "numeric") & (F.col("classifier") == "xgboost") & F.col("condition").isin(*conditions)
    )
    primary = (F.col("family") == "numeric_core") & (F.col("metric") == "macro_f1")
    omnibus = st_friedman_permutation(one, n, seed).filter(primary)
    pairs = st_sign_flip(one).filter(primary)
    return omnibus, st_holm(pairs, GROUP, "exact_p_value")


def reduced_blocks(cell: DataFrame, dropped: str = "adasyn", metric: str = "macro_f1") -> DataFrame:
    """Numeric-family blocks without one condition, complete in the conditions that remain."""

    conditions = [c for c in rules.FAMILIES["numeric_core"][1] if c != dropped]
    rows = cell.filter((F.col("feature_type") == "numeric") & F.col("condition").isin(conditions)).select(
        F.lit("numeric_core_without_" + dropped).alias("family"),
        "classifier",
        F.lit(metric).alias("metric"),
        "dataset",
        "condition",
        F.col(metric).alias("value"),
    )
    own = F.count("*").over(Window.partitionBy(*GROUP, "dataset"))
    return rows.withColumn("_own", own).filter(F.col("_own") == len(conditions)).drop("_own")


def st_complete_gate(cell: DataFrame, conditions: Sequence[str] = rules.POSTHOC_CONDITIONS, datasets: int = 9) -> DataFrame:
    """``DF[classifier, problem]``: reduced matrices must be complete, unique, finite and of 15 records."""

    numeric = cell.filter(F.col("feature_type") == "numeric")
    total = numeric.agg(F.countDistinct("dataset").alias("n"))
    wanted = numeric.filter(F.col("condition").isin(list(conditions)))
    score = F.col("macro_f1")
    facts = (
        wanted.groupBy("classifier", "dataset", "condition")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).alias("_odd"),
            F.count_if(F.col("complete_records") != 15).alias("_short"),
        )
        .groupBy("classifier")
        .agg(
            F.count("*").alias("_cells"),
            F.max("_n").alias("_most"),
            F.sum("_odd").alias("_odd"),
            F.sum("_short").alias("_short"),
        )
        .withColumn("_datasets", total.scalar())
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("_datasets") != datasets, f"expected {datasets} retained numeric datasets"),
            F.when(F.col("_most") > 1, "duplicate numeric cell mean"),
            F.when(F.col("_cells") != F.col("_datasets") * len(conditions), "incomplete post hoc blocks"),
            F.when(F.col("_odd") > 0, "non-finite macro-F1 values"),
            F.when(F.col("_short") > 0, "a cell without all 15 records"),
        )
    )
    return facts.select("classifier", F.explode(problems).alias("problem"))


def st_reduced_omnibus(cell: DataFrame, dropped: str = "adasyn", n: int = 200_000, seed: int = rules.POSTHOC_SEED) -> DataFrame:
    return _permutation(reduced_blocks(cell, dropped), n, seed, GROUP)


def st_reduced_pairwise(cell: DataFrame, dropped: str = "adasyn") -> DataFrame:
    """Raw against each remaining condition: deltas, outcomes, exact p, Holm inside each classifier."""

    blocks = reduced_blocks(cell, dropped)
    raw = F.max(F.when(F.col("condition") == "raw", F.col("value"))).over(Window.partitionBy(*GROUP, "dataset"))
    delta = blocks.withColumn("delta", F.col("value") - raw).filter("condition <> 'raw'")
    described = delta.groupBy(*PAIR).agg(
        F.count("*").alias("n_pairs"),
        F.avg("delta").alias("mean_delta"),
        F.percentile("delta", 0.5).alias("median_delta"),
        *outcome_counts(),
    )
    table = described.join(st_signed_rank_exact(delta).drop("reason"), PAIR)
    return st_holm(table, GROUP, "exact_p_value")
