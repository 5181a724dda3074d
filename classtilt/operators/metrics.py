"""Metrics from prediction tables ``Pred[keys, id, y, p]``: grouped aggregates, no per-cell loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def met_argmax(p) -> Column:
    """Index of the largest probability, the lowest class on ties."""

    p = F.col(p) if isinstance(p, str) else p
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def met_confusion(pred: DataFrame, keys: Sequence[str], classes: int, yhat: str = "yhat") -> DataFrame:
    """``DF[keys, y, yhat, n]`` with every declared pair of classes."""

    # One row per cell carries all counts; the declared grid is then unfolded from it, so no grid is joined.
    label = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = F.flatten(
        F.transform(label, lambda a: F.transform(label, lambda b: F.struct(a.alias("y"), b.alias("yhat"))))
    )
    counts = pred.groupBy(*keys, F.col("y").cast("int").alias("y"), F.col(yhat).cast("int").alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("y", "yhat"), "n"))).alias("_n"))
    unfolded = cells.select(*keys, "_n", F.explode(grid).alias("_c"))
    return unfolded.select(
        *keys,
        "_c.y",
        "_c.yhat",
        F.coalesce(F.try_element_at("_n", F.col("_c")), F.lit(0)).cast("bigint").alias("n"),
    )


def class_margins(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DF[keys, class, tp, support, predicted]``."""

    ends = F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(True).alias("t")), F.struct(F.col("yhat").alias("c"), F.lit(False).alias("t"))))
    sides = conf.select(*keys, "y", "yhat", "n", ends.alias("_e"))
    n = F.col("n")
    return sides.groupBy(*keys, F.col("_e.c").alias("class")).agg(
        F.sum(F.when(F.col("_e.t") & (F.col("y") == F.col("yhat")), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_e.t"), n).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("_e.t"), n).otherwise(0)).alias("predicted"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _recall() -> Column:
    return _ratio(F.col("tp"), F.col("support"))


def _g_mean(recall: Column) -> Column:
    return F.when(F.min(recall) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(recall > 0, recall)))))


def _mcc() -> Column:
    c, s = F.sum("tp").cast("double"), F.sum("support").cast("double")
    p, t = F.col("predicted").cast("double"), F.col("support").cast("double")
    top = c * s - F.sum(p * t)
    bottom = F.sqrt((s * s - F.sum(p * p)) * (s * s - F.sum(t * t)))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _f1() -> Column:
    return F.avg(_ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")))


def _balanced() -> Column:
    return F.avg(F.when(F.col("support") > 0, _recall()))


def _recalls() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("class"), _recall().alias("r")))), lambda c: c["r"])


def met_macro_f1(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean F1 over the declared classes, 0 where undefined."""

    return class_margins(conf, keys).groupBy(*keys).agg(_f1().alias("value"))


def met_recall(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return class_margins(conf, keys).groupBy(*keys).agg(_recalls().alias("per_class_recall"))


def met_gmean(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Geometric mean of the recalls, exactly 0 when one of them is 0."""

    return class_margins(conf, keys).groupBy(*keys).agg(_g_mean(_recall()).alias("value"))


def met_mcc(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return class_margins(conf, keys).groupBy(*keys).agg(_mcc().alias("value"))


def met_balanced_acc(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return class_margins(conf, keys).groupBy(*keys).agg(_balanced().alias("value"))


def met_ap(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DF[keys, class, ap, positives, negatives]``: one-vs-rest average precision, tied scores one threshold.

    A running sum over one class would put a whole fold in one task. Scores lie in [0, 1], so they are cut into
    2^24 fixed ranges in two levels; sums of the ranges above a row are added to a running sum inside its range.
    """

    group = [*keys, "class"]
    scores = (
        pred.select(*keys, "y", F.posexplode("p").alias("class", "score"))
        .groupBy(*group, "score")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("class")).alias("tp"))
        .withColumn("_fine", F.floor(F.col("score") * 16777216).cast("int"))
        .withColumn("_coarse", F.shiftright("_fine", 12))
    )

    def before(*partition, order):
        return Window.partitionBy(*partition).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)

    def earlier(column, window):
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    fine = scores.groupBy(*group, "_coarse", "_fine").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    high = before(*group, order="_coarse")
    coarse = (
        fine.groupBy(*group, "_coarse")
        .agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
        .select(
            *group,
            "_coarse",
            earlier("n", high).alias("_n1"),
            earlier("tp", high).alias("_tp1"),
            F.sum("n").over(Window.partitionBy(*group)).alias("_rows"),
            F.sum("tp").over(Window.partitionBy(*group)).alias("_positives"),
        )
    )
    low = before(*group, "_coarse", order="_fine")
    shifts = (
        fine.withColumn("_n2", earlier("n", low))
        .withColumn("_tp2", earlier("tp", low))
        .drop("n", "tp")
        .join(coarse, [*group, "_coarse"])
        .select(
            *group,
            "_fine",
            (F.col("_n1") + F.col("_n2")).alias("_n0"),
            (F.col("_tp1") + F.col("_tp2")).alias("_tp0"),
            "_rows",
            "_positives",
        )
    )
    inside = Window.partitionBy(*group, "_fine").orderBy(F.desc("score"))
    upto_n = F.col("_n0") + F.sum("n").over(inside)
    upto_tp = F.col("_tp0") + F.sum("tp").over(inside)
    return (
        scores.join(shifts, [*group, "_fine"])
        .withColumn("_precision", upto_tp / upto_n)
        .groupBy(*group)
        .agg(
            F.try_divide(F.sum(F.col("tp") * F.col("_precision")), F.max("_positives")).alias("ap"),
            F.max("_positives").alias("positives"),
            (F.max("_rows") - F.max("_positives")).alias("negatives"),
        )
    )


def _macro_ap(name: str) -> list[Column]:
    sound = (F.min("positives") > 0) & (F.min("negatives") > 0)
    status = F.when(sound, F.lit("VALID")).otherwise(F.lit("NOT APPLICABLE"))
    return [F.when(sound, F.avg("ap")).alias(name), status.alias("status")]


def met_macro_ap(ap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean AP; null with a reason when a class lacks positives or negatives."""

    return ap.groupBy(*keys).agg(*_macro_ap("value"))


def _row_brier() -> Column:
    gaps = F.transform("p", lambda v, i: F.pow(v - F.when(i == F.col("y"), 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / F.size("p")


def _row_log_loss() -> Column:
    p = F.element_at("p", (F.col("y") + 1).cast("int"))
    return -F.ln(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON)))


def met_brier(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over rows and classes of the squared error."""

    return pred.groupBy(*keys).agg(F.avg(_row_brier()).alias("value"))


def met_log_loss(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(_row_log_loss()).alias("value"))


def met_validate_proba(pred: DataFrame, id: Sequence[str], classes: int) -> DataFrame:
    """Rows whose probabilities break a rule: DF[id, problem]."""

    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    problem = (
        F.when(F.col("p").isNull() | (F.size("p") != classes), "probabilities have the wrong shape")
        .when(
            ~F.forall("p", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))),
            "probabilities must be finite and non-negative",
        )
        .when(F.abs(total - 1.0) > 1e-8 + 1e-5, "probabilities must sum to one")
    )
    return pred.select(*id, problem.alias("problem")).filter(F.col("problem").isNotNull())


def met_bundle(pred: DataFrame, keys: Sequence[str], classes: int, offsets=None) -> DataFrame:
    """One row per cell with every metric; ``offsets`` is an optional array column expression of thresholds."""

    from classtilt.operators.thresholds import thr_apply

    rows = pred.withColumn("yhat", met_argmax("p"))
    margins = class_margins(met_confusion(rows, keys, classes), keys)
    plain = [
        _f1().alias("macro_f1_argmax"),
        _g_mean(_recall()).alias("g_mean_argmax"),
        _mcc().alias("mcc_argmax"),
        _balanced().alias("balanced_accuracy_argmax"),
        _recalls().alias("per_class_recall_argmax"),
    ]
    if offsets is None:
        scored = margins.groupBy(*keys).agg(*plain, _f1().alias("macro_f1_calibrated"))
    else:
        shifted = met_confusion(thr_apply(rows, offsets, "yhat_c"), keys, classes, "yhat_c")
        calibrated = met_macro_f1(shifted, keys).withColumnRenamed("value", "macro_f1_calibrated")
        scored = margins.groupBy(*keys).agg(*plain).join(calibrated, list(keys))
    # One grouping gives the mean and the classes, so the running sums stand in the plan once.
    curve = met_ap(pred, keys).groupBy(*keys).agg(
        *_macro_ap("macro_average_precision"),
        F.transform(F.array_sort(F.collect_list(F.struct("class", "ap"))), lambda c: c["ap"]).alias(
            "per_class_average_precision"
        ),
    )
    errors = pred.groupBy(*keys).agg(
        F.avg(_row_brier()).alias("multiclass_brier"), F.avg(_row_log_loss()).alias("multiclass_log_loss")
    )
    return scored.join(curve, list(keys)).join(errors, list(keys))


def met_cost(timings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wall, fit and predict seconds per cell from DF[keys, stage, seconds]; memory columns are carried."""

    carried = [c for c in timings.columns if c.startswith("rss_") or c == "peak_rss_mb"]
    of = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("seconds")))
    return timings.groupBy(*keys).agg(
        F.sum("seconds").alias("wall_seconds"),
        of("fit").alias("fit_seconds"),
        of("predict").alias("predict_seconds"),
        *[F.max(c).alias(c) for c in carried],
    )
