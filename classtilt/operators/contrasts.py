"""Declared contrasts and the fold-correlated hierarchical model of their differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.functions.distributions import fn_norm_cdf

CONTRAST = ["left_condition", "right_condition", "classifier"]


def declared_pairs() -> list[tuple[str, str]]:
    """Contrast pairs in declared order; a repeated pair keeps its first place."""

    pairs = [(c, "raw") for c in rules.CONDITIONS if c != "raw"]
    pairs += [*rules.WEIGHTING_PAIRS, *rules.BALANCED_FOREST_PAIRS, *rules.SAMPLER_PAIRS]
    return list(dict.fromkeys(pairs))


def st_contrast_list(spark: SparkSession, classifiers: Sequence[str] = rules.CLASSIFIERS_V2) -> DataFrame:
    """``DF[pos, left_condition, right_condition, classifier]``; balanced forests pair with random forests only."""

    rows = [
        (pos, left, right, classifier)
        for pos, (left, right) in enumerate(declared_pairs())
        for classifier in classifiers
        if classifier == "random_forest" or "balanced_random_forest" not in (left, right)
    ]
    return spark.createDataFrame(rows, "pos int, left_condition string, right_condition string, classifier string")


def st_contrast_blocks(rec: DataFrame, contrasts: DataFrame, metric: str, folds: int = 5) -> DataFrame:
    """``DF[contrast, dataset, feature_type, fold, left, right, delta]`` of datasets with every fold paired.

    Records meet the small contrast table once per side and are grouped, so no record is joined to another.
    """

    sides = F.array(F.lit("left"), F.lit("right"))
    ends = (
        contrasts.select(*CONTRAST, F.explode(sides).alias("_side"))
        .withColumn("condition", F.when(F.col("_side") == "left", F.col("left_condition")).otherwise(F.col("right_condition")))
    )
    block = [*CONTRAST, "dataset", "feature_type", "fold"]
    paired = (
        rec.filter(F.col("status") == rules.VALID)
        .join(ends, ["classifier", "condition"])
        .groupBy(*block)
        .agg(
            F.max(F.when(F.col("_side") == "left", F.col(metric))).alias("left"),
            F.max(F.when(F.col("_side") == "right", F.col(metric))).alias("right"),
        )
        .filter(F.col("left").isNotNull() & F.col("right").isNotNull())
        .withColumn("delta", F.col("left") - F.col("right"))
    )
    whole = F.count("*").over(Window.partitionBy(*CONTRAST, "dataset"))
    return paired.withColumn("_n", whole).filter(F.col("_n") == folds).drop("_n")


def st_contrast_table(contrasts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every contrast with its number of complete datasets; fewer than three is skipped with a reason."""

    counts = blocks.groupBy(*CONTRAST).agg(F.countDistinct("dataset").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    few = n < rules.MIN_BLOCKS
    return contrasts.join(counts, CONTRAST, "left").select(
        "pos",
        *CONTRAST,
        n.alias("complete_dataset_blocks"),
        F.when(few, "SKIPPED").otherwise("VALID").alias("status"),
        F.when(few, "fewer than three complete dataset blocks").alias("reason"),
    )


def st_posterior(
    blocks: DataFrame, tau_steps: int = 64, sigma_steps: int = 32, rho_steps: int = 40, folds: int = 5, bins: int = 50
) -> DataFrame:
    """Posterior of the mean difference as a mixture of normals: ``DF[contrast, n, i_v, mean, var, weight, edge_tau, edge_sigma]``.

    Priors: mu normal(0, 0.5), tau half-normal(0.5), sigma half-normal(0.25), rho beta(2, 2). A dataset's likelihood depends
    only on the mean of its differences and their sum of squares around it, and those enter through four sums, so a
    contrast is one row before nodes are unfolded. Given the other three, mu is integrated in closed form. They are integrated
    over their whole support by the trapezoid rule: rho on the logit scale; the logarithms of tau and of
    ``sigma^2 (1 - rho)`` as centre + a sinh(t), which is dense around what the data say and reaches 30 e-folds to
    either side. mu given the nodes depends on the variance v of a dataset's mean only; nodes are merged, moments kept, where
    v is within 1 / ``bins`` of a natural logarithm. ``edge_tau`` and ``edge_sigma`` are the mass of a bin's outermost
    nodes: near 0 unless support is cut, or unless the folds of every dataset agree exactly, when sigma's mass is at 0.
    """

    per_dataset = blocks.groupBy(*CONTRAST, "dataset").agg(F.avg("delta").alias("m"), (F.var_pop("delta") * folds).alias("w"))
    sums = (
        per_dataset.groupBy(*CONTRAST)
        .agg(
            F.count("*").alias("n"),
            F.avg("m").alias("centre"),
            (F.var_pop("m") * F.count("*")).alias("between"),
            F.sum("w").alias("within"),
        )
        .filter(F.col("n") >= rules.MIN_BLOCKS)
        .withColumn("a", F.sqrt(F.lit(2.0) / F.col("n")))
        .withColumn("reach", F.asinh(F.lit(30.0) / F.col("a")))
        .withColumn("ln_tau", F.ln(F.greatest(F.sqrt(F.col("between") / F.col("n")), F.lit(1e-6))))
        .withColumn("ln_s", F.ln(F.greatest(F.col("within") / (F.col("n") * (folds - 1)), F.lit(1e-12))))
    )
    step = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n))).alias(name)
    at = lambda i, n: F.col("reach") * (F.col(i) * (2.0 / n) - 1.0)
    nodes = (
        sums.select("*", step("i_tau", tau_steps))
        .select("*", step("i_sigma", sigma_steps))
        .select("*", step("i_rho", rho_steps))
        .withColumn("t_tau", at("i_tau", tau_steps))
        .withColumn("t_s", at("i_sigma", sigma_steps))
        .withColumn("tau2", F.exp((F.col("ln_tau") + F.col("a") * F.sinh("t_tau")) * 2.0))
        .withColumn("s", F.exp(F.col("ln_s") + F.col("a") * F.sinh("t_s")))
        .withColumn("rho", F.lit(1.0) / (F.exp(F.lit(9.0) - F.col("i_rho") * (18.0 / rho_steps)) + 1.0))
        .withColumn("sigma2", F.col("s") / (F.lit(1.0) - F.col("rho")))
        .withColumn("v", F.col("tau2") + F.col("sigma2") * (F.col("rho") * (folds - 1) + 1.0) / float(folds))
        .withColumn("gap", F.col("v") / F.col("n") + 0.25)  # variance of the centre with mu integrated
        .withColumn(
            "l",
            (F.col("n") - 1) * -0.5 * F.ln("v")
            - F.col("between") * 0.5 / F.col("v")
            - F.ln("gap") * 0.5
            - F.col("centre") * F.col("centre") * 0.5 / F.col("gap")
            - F.col("n") * (folds - 1) * 0.5 * F.ln("s")
            - F.col("within") * 0.5 / F.col("s")
            - F.col("tau2") / (2 * 0.5**2)
            - F.col("sigma2") / (2 * 0.25**2)
            + (F.ln("rho") + F.ln(F.lit(1.0) - F.col("rho"))) * 2.0  # prior, and the logit's slope
            + (F.ln("tau2") + F.ln("sigma2")) * 0.5  # the logarithms' slopes
            + F.ln(F.cosh("t_tau"))
            + F.ln(F.cosh("t_s")),
        )
        .withColumn("i_v", F.floor(F.ln("v") * bins).cast("int"))
        .withColumn("mean", F.col("centre") * 0.25 / F.col("gap"))
        .withColumn("var", F.col("v") / F.col("n") * 0.25 / F.col("gap"))
    )
    binned = [*CONTRAST, "n", "i_v"]
    local = nodes.withColumn("e", F.exp(F.col("l") - F.max("l").over(Window.partitionBy(*CONTRAST, "i_v"))))
    outer = lambda i, n: F.sum(F.when(F.col(i).isin(0, n), F.col("e")).otherwise(0.0))
    parts = local.groupBy(*binned).agg(
        F.max("l").alias("top"),
        F.sum("e").alias("e"),
        F.sum(F.col("e") * F.col("mean")).alias("m1"),
        F.sum(F.col("e") * (F.col("var") + F.col("mean") * F.col("mean"))).alias("m2"),
        outer("i_tau", tau_steps).alias("tau_e"),
        outer("i_sigma", sigma_steps).alias("sigma_e"),
    )
    of = Window.partitionBy(*CONTRAST)
    parts = parts.withColumn("scale", F.exp(F.col("top") - F.max("top").over(of)))
    whole = F.sum(F.col("e") * F.col("scale")).over(of)
    mean = F.col("m1") / F.col("e")
    return parts.select(
        *binned,
        mean.alias("mean"),
        (F.col("m2") / F.col("e") - mean * mean).alias("var"),
        (F.col("e") * F.col("scale") / whole).alias("weight"),
        (F.col("tau_e") * F.col("scale") / whole).alias("edge_tau"),
        (F.col("sigma_e") * F.col("scale") / whole).alias("edge_sigma"),
    )


def st_rope(post: DataFrame, low: float = rules.ROPE[0], high: float = rules.ROPE[1]) -> DataFrame:
    """Posterior mass below, inside and above the region; the first largest names the category."""

    sd = F.sqrt(F.greatest("var", F.lit(1e-300)))
    below = fn_norm_cdf((F.lit(low) - F.col("mean")) / sd)
    above = fn_norm_cdf((F.col("mean") - F.lit(high)) / sd)
    masses = post.groupBy(*CONTRAST).agg(
        F.sum(below * F.col("weight")).alias("p_practically_worse"),
        F.sum((F.lit(1.0) - below - above) * F.col("weight")).alias("p_practically_equivalent"),
        F.sum(above * F.col("weight")).alias("p_practically_better"),
    )
    w, e, b = (F.col(f"p_practically_{k}") for k in ("worse", "equivalent", "better"))
    category = (
        F.when((w >= e) & (w >= b), "practically_worse")
        .when(e >= b, "practically_equivalent")
        .otherwise("practically_better")
    )
    return masses.withColumn("posterior_category", category)


def _roots(frame: pd.DataFrame) -> pd.DataFrame:
    """One contrast's quantiles by bisection on the mixture's distribution function."""

    mean, sd, weight = frame["mean"].to_numpy(), np.sqrt(frame["var"].to_numpy()), frame["weight"].to_numpy()
    used = weight > 0
    mean, sd, weight = mean[used], sd[used], weight[used]
    out = {c: [frame[c].iloc[0]] for c in CONTRAST}
    out["posterior_mean_mu"] = [float((mean * weight).sum())]
    for name, q in (("posterior_median_mu", 0.5), ("credible_low", 0.025), ("credible_high", 0.975)):
        low, high = float((mean - 40 * sd).min()), float((mean + 40 * sd).max())
        while high - low > 1e-13 * max(1.0, abs(low)):
            x = (low + high) / 2
            upto = sum(w * 0.5 * math.erfc(z) for w, z in zip(weight, (mean - x) / (sd * math.sqrt(2)), strict=True))
            low, high = (low, x) if upto >= q else (x, high)
        out[name] = [(low + high) / 2]
    return pd.DataFrame(out | {c: [float(frame[c].sum())] for c in ("edge_tau", "edge_sigma")})


def st_credible(post: DataFrame) -> DataFrame:
    """Posterior mean, median, 2.5 % and 97.5 % points, and the mass at the ends of tau's and sigma's nodes.

    A contrast is a bounded group: its bins, some thousands at most.
    """

    points = ("posterior_mean_mu", "posterior_median_mu", "credible_low", "credible_high", "edge_tau", "edge_sigma")
    schema = ", ".join([f"{c} string" for c in CONTRAST] + [f"{c} double" for c in points])
    needed = post.select(*CONTRAST, "mean", "var", "weight", "edge_tau", "edge_sigma")
    return needed.groupBy(*CONTRAST).applyInPandas(_roots, schema)
