"""Aggregation of evaluation records into cells, paired differences and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.functions import fn_avg_rank

CELL = ["dataset", "classifier", "condition", "feature_type"]
GROUP = ["family", "classifier", "metric"]
TIE = 1e-12


def _complete() -> Column:
    """All 3 seeds and 5 folds, 15 records. Two bit masks replace distinct counts, so one shuffle is enough."""

    seeds = F.bit_or(F.expr("shiftleft(1, seed)"))
    folds = F.bit_or(F.expr("shiftleft(1, fold)"))
    inside = (F.max("seed") == len(rules.SEEDS) - 1) & (F.max("fold") == rules.FOLDS - 1)
    records = len(rules.SEEDS) * rules.FOLDS
    return (
        (F.count("*") == records)
        & inside
        & (seeds == 2 ** len(rules.SEEDS) - 1)
        & (folds == 2**rules.FOLDS - 1)
    )


def st_cell_means(rec: DataFrame) -> DataFrame:
    """Mean metrics of complete cells: ``DF[cell, complete_records, metrics]``."""

    return (
        rec.groupBy(*CELL)
        .agg(
            F.count("*").alias("complete_records"),
            *[F.avg(m).alias(m) for m in rules.METRICS],
            _complete().alias("_ok"),
        )
        .filter("_ok")
        .drop("_ok")
    )


def st_class_means(rec: DataFrame) -> DataFrame:
    """Mean recall per class of complete cells: ``DF[cell, class_index, recall, complete_records]``."""

    return (
        rec.select(*CELL, "seed", "fold", F.posexplode("per_class_recall").alias("class_index", "r"))
        .groupBy(*CELL, "class_index")
        .agg(F.avg("r").alias("recall"), F.count("*").alias("complete_records"), _complete().alias("_ok"))
        .filter("_ok")
        .drop("_ok")
    )


def st_efficiency(rec: DataFrame) -> DataFrame:
    """Mean and median of the cost columns of complete cells (15 records each, so ``percentile`` is bounded)."""

    costs = [c for c in rules.COST_METRICS if c in rec.columns]
    measures = [
        e for c in costs for e in (F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.5).alias(f"{c}_median"))
    ]
    return (
        rec.groupBy(*CELL)
        .agg(F.count("*").alias("complete_records"), *measures, _complete().alias("_ok"))
        .filter("_ok")
        .drop("_ok")
    )


def cell_long(cell: DataFrame) -> DataFrame:
    """Wide cell means to ``Cell[cell, metric, value]``."""

    return cell.unpivot(CELL, list(rules.METRICS), "metric", "value")


def st_rankings(rec: DataFrame) -> DataFrame:
    """``DF[dataset, feature_type, classifier, condition, metric, score, rank]``; best is 1, ties share."""

    means = rec.groupBy(*CELL).agg(*[F.avg(m).alias(m) for m in rules.METRICS])
    long = means.unpivot(CELL, list(rules.METRICS), "metric", "score")
    rank = fn_avg_rank(F.col("score"), ["dataset", "feature_type", "classifier", "metric"], descending=True)
    return long.withColumn("rank", rank)


def in_families(cell: DataFrame) -> DataFrame:
    """Cells once per family they belong to; the family table has a few dozen fixed rows."""

    return cell.join(rules.family_table(cell.sparkSession), ["feature_type", "classifier", "condition"])


def st_family_matrix(cell: DataFrame, family: str, classifier: str, metric: str) -> DataFrame:
    """Dataset by condition pivot with the family's fixed column list."""

    feature_type, conditions = rules.FAMILIES[family]
    return (
        cell_long(cell)
        .filter(
            (F.col("feature_type") == feature_type) & (F.col("classifier") == classifier) & (F.col("metric") == metric)
        )
        .groupBy("dataset")
        .pivot("condition", list(conditions))
        .agg(F.first("value"))
    )


def family_blocks(cell: DataFrame) -> DataFrame:
    """``DF[family, classifier, metric, dataset, condition, position, value, n_conditions]``.

    Rows of datasets that have every condition the family has any cell for.
    """

    long = in_families(cell_long(cell))
    available = long.groupBy(*GROUP).agg(F.countDistinct("condition").alias("n_conditions"))
    own = F.count("*").over(Window.partitionBy(*GROUP, "dataset"))
    return (
        long.withColumn("_own", own)
        .join(available, GROUP)
        .filter(F.col("_own") == F.col("n_conditions"))
        .select(*GROUP, "dataset", "condition", "position", "value", "n_conditions")
    )


def st_complete_blocks(cell: DataFrame, family: str | None = None) -> DataFrame:
    """Cells of datasets that have every condition of the whole family."""

    sizes = F.create_map(*[F.lit(v) for f, (_, c) in rules.FAMILIES.items() for v in (f, len(c))])
    long = in_families(cell_long(cell))
    if family:
        long = long.filter(F.col("family") == family)
    own = F.count("*").over(Window.partitionBy(*GROUP, "dataset"))
    return (
        long.withColumn("_own", own)
        .filter(F.col("_own") == sizes[F.col("family")])
        .select(*GROUP, "dataset", "condition", "value")
    )


def _against_raw(long: DataFrame, block: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    raw = F.max(F.when(F.col("condition") == "raw", F.col(value))).over(Window.partitionBy(*block))
    return (
        long.withColumn("_raw", raw)
        .filter((F.col("condition") != "raw") & F.col("_raw").isNotNull())
        .select(
            *block,
            "condition",
            F.col("_raw").alias(names[0]),
            F.col(value).alias(names[1]),
            (F.col(value) - F.col("_raw")).alias("delta"),
        )
    )


def st_baseline_deltas(cell: DataFrame) -> DataFrame:
    """Condition minus raw per dataset; a window over the dataset's own conditions replaces a self-join."""

    long = in_families(cell_long(cell))
    return _against_raw(long, [*GROUP, "dataset"], "value", ("raw_mean", "alternative_mean"))


def st_class_deltas(class_means: DataFrame) -> DataFrame:
    block = ["family", "classifier", "dataset", "class_index"]
    return _against_raw(in_families(class_means), block, "recall", ("raw_recall", "alternative_recall"))


def outcome_counts(d: str = "delta") -> list[Column]:
    return [
        F.count_if(F.col(d) > TIE).alias("wins"),
        F.count_if(F.abs(d) <= TIE).alias("ties"),
        F.count_if(F.col(d) < -TIE).alias("losses"),
    ]


def st_class_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("family", "classifier", "condition", "class_index").agg(
        F.count("*").alias("n_pairs"),
        F.avg("delta").alias("mean_delta"),
        F.percentile("delta", 0.5).alias("median_delta"),
        *outcome_counts(),
    )


def comparison_grid(cell: DataFrame) -> DataFrame:
    """Comparisons with raw that the cells allow, even when no dataset has both sides."""

    seen = in_families(cell_long(cell)).select(*GROUP, "condition").distinct()
    raw = F.max(F.col("condition") == "raw").over(Window.partitionBy(*GROUP))
    return seen.withColumn("_raw", raw).filter("_raw and condition <> 'raw'").drop("_raw")


def st_effects(delta: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """``DF[group, condition, n_pairs, mean, median, wins, ties, losses, status, reason]``."""

    keys = [*GROUP, "condition"]
    measured = delta.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.avg("delta").alias("mean_delta"),
        F.percentile("delta", 0.5).alias("median_delta"),
        *outcome_counts(),
    )
    if grid is not None:
        measured = grid.join(measured, keys, "left").na.fill(0, ["n_pairs", "wins", "ties", "losses"])
    n = F.col("n_pairs")
    return measured.withColumn(
        "status", F.when(n == 0, "skipped").when(n < rules.MIN_BLOCKS, "descriptive").otherwise("computed")
    ).withColumn(
        "reason",
        F.when(n == 0, "no complete paired blocks").when(
            n < rules.MIN_BLOCKS,
            "fewer than three complete dataset blocks; inferential test skipped per frozen rule",
        ),
    )


def st_stratified(delta: DataFrame, registry: DataFrame) -> DataFrame:
    """Deltas in the balanced (ratio 1) and imbalanced (ratio above 1) strata, descriptive only."""

    ratio = registry.select(F.col("dataset_id").alias("dataset"), F.col("ir_majority_minority").cast("double").alias("ir"))
    stratum = F.when(F.abs(F.col("ir") - 1.0) <= TIE, "exactly_balanced_ir_1.0").when(
        F.col("ir") > 1.0 + TIE, "imbalanced_ir_gt_1.0"
    )
    return (
        delta.join(ratio, "dataset")
        .withColumn("stratum", stratum)
        .filter(F.col("stratum").isNotNull())
        .groupBy("classifier", "condition", "metric", "stratum")
        .agg(
            F.array_join(F.array_sort(F.collect_set("dataset")), ";").alias("dataset_ids"),
            F.count("*").alias("n_datasets"),
            F.avg("delta").alias("mean_paired_delta"),
            F.percentile("delta", 0.5).alias("median_paired_delta"),
            *outcome_counts(),
        )
        .withColumn("inferential_status", F.lit("descriptive_only_no_tests"))
    )


def st_coverage_grid(cell: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Every feature type x classifier x condition tile with its mean and dataset count; empty tiles stay.

    The axes are the distinct values (a handful each), unfolded from one row, so no rows are crossed.
    """

    axes = cell.agg(
        F.collect_set("feature_type").alias("f"), F.collect_set("classifier").alias("c"), F.collect_set("condition").alias("k")
    )
    grid = (
        axes.withColumn("feature_type", F.explode("f"))
        .withColumn("classifier", F.explode("c"))
        .withColumn("condition", F.explode("k"))
        .drop("f", "c", "k")
    )
    tiles = cell.groupBy("feature_type", "classifier", "condition").agg(
        F.avg(metric).alias(f"mean_{metric}"), F.countDistinct("dataset").alias("n_datasets")
    )
    return grid.join(tiles, ["feature_type", "classifier", "condition"], "left").na.fill(0, ["n_datasets"])


def st_moderators(registry: DataFrame, ids: DataFrame) -> DataFrame:
    columns = ["dataset_id", "n_rows", "n_classes", "n_min_class", "ir_majority_minority", "d_raw", "d_encoded", "feature_type"]
    scored = ids.select(F.col("dataset").alias("dataset_id")).distinct()
    return registry.join(scored, "dataset_id", "left_semi").select(*[c for c in columns if c in registry.columns])


def st_box_stats(delta: DataFrame) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers of the deltas per group and condition."""

    keys = [*GROUP, "condition"]
    quartiles = delta.groupBy(*keys).agg(F.percentile("delta", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    fence = (F.col("_q")[2] - F.col("_q")[0]) * 1.5
    inside = F.col("delta").between(F.col("_q")[0] - fence, F.col("_q")[2] + fence)
    kept = F.when(inside, F.col("delta"))
    return (
        delta.join(quartiles, keys)
        .groupBy(*keys, "_q")
        .agg(F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
        .select(
            *keys,
            F.col("_q")[0].alias("q1"),
            F.col("_q")[1].alias("median"),
            F.col("_q")[2].alias("q3"),
            "whisker_low",
            "whisker_high",
            "outliers",
        )
    )


def st_figure_means(cell: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean score by feature type and condition, one column per classifier."""

    return (
        cell.groupBy("feature_type", "condition")
        .pivot("classifier", list(rules.ANALYSIS_CLASSIFIERS))
        .agg(F.avg(metric))
    )
