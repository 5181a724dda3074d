"""Random search over declared spaces and selection by mean inner score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.functions import fn_hash_uniform
from classtilt.operators.metrics import met_ap, met_macro_ap



def space_table(spark: SparkSession, spaces: dict = rules.SEARCH_SPACES) -> DataFrame:
    """``DF[classifier, param, kind, low, high, choices]``."""

    rows = []
    for classifier, space in spaces.items():
        for param, (kind, *spec) in space.items():
            if kind in ("categorical", "constant"):
                choices = list(spec[0]) if kind == "categorical" else [str(spec[0])]
                rows.append((classifier, param, kind, None, None, choices))
            else:
                rows.append((classifier, param, kind, float(spec[0]), float(spec[1]), None))
    return spark.createDataFrame(
        rows, "classifier string, param string, kind string, low double, high double, choices array<string>"
    )


def tune_trials(space: DataFrame, n: int = rules.TRIALS, seed: int = rules.SEARCH_SEED, keys: Sequence[str] = ()) -> DataFrame:
    """``DF[keys, classifier, trial, param, value]``: inverse distribution functions of hashed uniforms.

    Extra ``keys`` columns of ``space`` (a dataset or fold) give every cell its own draws.
    """

    named = [seed, *[F.col(k) for k in keys], F.col("classifier"), F.col("trial"), F.col("param")]
    trials = space.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("u", fn_hash_uniform(*named))
    u, low, high = F.col("u"), F.col("low"), F.col("high")
    number = (
        F.when(F.col("kind") == "loguniform", F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low))))
        .when(F.col("kind") == "uniform", low + u * (high - low))
    )
    whole = F.floor(low + u * (high - low)).cast("string")
    choice = F.element_at("choices", (F.floor(u * F.size("choices")) + 1).cast("int"))
    value = (
        F.when(F.col("kind") == "randint", whole)
        .when(F.col("kind").isin("categorical", "constant"), choice)
        .otherwise(number.cast("string"))
    )
    return trials.select(*keys, "classifier", "trial", "param", value.alias("value"))


def tune_contract(
    space: DataFrame,
    trials: int = rules.TRIALS,
    scoring: str = rules.SEARCH_SCORE,
    workers: int = 1,
    models: Sequence[str] = tuple(rules.SEARCH_SPACES),
) -> DataFrame:
    """``DF[problem]``: budget, score, workers, missing spaces and sampler parameters in a space."""

    spark = space.sparkSession
    fixed = [
        ("the search budget must be exactly 20 trials", trials != rules.TRIALS),
        ("the search must score macro_average_precision", scoring != rules.SEARCH_SCORE),
        ("the search must use one worker", workers != 1),
    ]
    settings = spark.createDataFrame([(m,) for m, bad in fixed if bad], "problem string")
    wanted = spark.createDataFrame([(m,) for m in models], "classifier string")
    empty = wanted.join(space, "classifier", "left_anti").select(
        F.concat(F.lit("search space is empty for "), F.col("classifier")).alias("problem")
    )
    leaked = space.filter(F.contains(F.lower("param"), F.lit("sampler"))).select(
        F.concat(F.lit("sampler parameter in the search space of "), F.col("classifier")).alias("problem")
    )
    return settings.unionByName(empty).unionByName(leaked)


def tune_inner_score(pred: DataFrame, keys: Sequence[str], folds: int = rules.INNER_FOLDS) -> DataFrame:
    """Mean macro-AP over the inner folds of each trial; null when a fold has no score."""

    per_fold = met_macro_ap(met_ap(pred, [*keys, "trial", "inner_fold"]), [*keys, "trial", "inner_fold"])
    whole = F.count("value") == folds
    return per_fold.groupBy(*keys, "trial").agg(F.when(whole, F.avg("value")).alias("score"))


def tune_oof(pred: DataFrame, rows: DataFrame, keys: Sequence[str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, DF[keys, missing, doubled]); the second must be empty for a complete table."""

    counts = pred.groupBy(*keys, id).agg(F.count("*").alias("_n"))
    gaps = (
        rows.select(*keys, id)
        .join(counts, [*keys, id], "left")
        .groupBy(*keys)
        .agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("doubled"))
        .filter((F.col("missing") > 0) | (F.col("doubled") > 0))
    )
    return pred, gaps


def tune_select(scores: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(best trial per cell, failure rows of cells where every trial failed); the first trial wins ties."""

    best = scores.groupBy(*keys).agg(
        F.max("score").alias("score"),
        F.max_by("trial", F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("trial")).alias("_t")))).alias("trial"),
    )
    chosen = best.filter(F.col("score").isNotNull()).select(*keys, "trial", "score")
    failed = best.filter(F.col("score").isNull()).select(
        *keys, F.lit("inner_hpo").alias("stage"), F.lit("RuntimeError").alias("error_type"), F.lit("all HPO trials failed").alias("error")
    )
    return chosen, failed


def ordered_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials of a cell in selection order (twenty rows per cell)."""

    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "trial")
    return scores.withColumn("place", F.row_number().over(order))
