"""Fold-local preparation: labels, folds, training-only statistics and encodings.

Fitted statistics are small tables keyed by fold; they are joined back to the rows, so a test row never takes
part in a fit. Columns of a fold table: ``fold`` is the fold whose *training* part the statistics describe.
Only tables with one row per fold are broadcast by hint; they have at most ``k`` rows whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classtilt import rules
from classtilt.functions import exact_quantile, number_by_hash, order_hash


@dataclass(frozen=True)
class Layout:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def feature_type(self) -> str:
        if self.numeric:
            return "mixed" if self.categorical else "numeric"
        return "categorical"


def prep_drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def prep_layout(schema: T.StructType, target: str, cats: Sequence[str] = ()) -> Layout:
    """Numeric columns minus declared categories; every other column is categorical."""

    names = [f.name for f in schema.fields]
    if target not in names:
        raise ValueError(f"target column {target!r} is missing")
    unknown = sorted(set(cats) - (set(names) - {target}))
    if unknown:
        raise ValueError(f"unknown categorical columns: {unknown}")
    numeric = tuple(
        f.name
        for f in schema.fields
        if f.name != target and f.name not in cats and isinstance(f.dataType, T.NumericType)
    )
    if not numeric:
        raise ValueError("a table without numeric features is outside the protocol")
    return Layout(numeric, tuple(n for n in names if n != target and n not in numeric))


def prep_label_encode(df: DataFrame, keys: Sequence[str], target: str, name: str = "y") -> DataFrame:
    """Codes 0..C-1 in sorted label order, per dataset. Only the distinct labels are ranked."""

    codes = df.select(*keys, target).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col(target))
    codes = codes.withColumn(name, F.row_number().over(order) - 1)
    return df.join(codes, [*keys, target])


def prep_kfold(
    df: DataFrame, keys: Sequence[str], id: str, y: str, k: int = 5, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Stratified shuffled folds: rows of a class are dealt round robin in hash order."""

    hashed = df.withColumn("_h", order_hash(seed, F.col(id)))
    dealt = number_by_hash(hashed, [*keys, y], "_h", id, "_place")
    return dealt.withColumn(name, ((F.col("_place") - 1) % k).cast("int")).drop("_h", "_place")


def prep_nested_kfold(
    df: DataFrame, keys: Sequence[str], id: str, y: str, inner_k: int = 3, seed: int = rules.INNER_SEED, k: int = 5
) -> DataFrame:
    """Inner folds of every outer-training part: each row appears in the ``k - 1`` outer folds that train on it."""

    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    crossed = df.withColumn("outer_fold", F.explode(others))
    return prep_kfold(crossed, [*keys, "outer_fold"], id, y, inner_k, seed, "inner_fold")


def prep_split_check(outer: DataFrame, nested: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """Per outer fold: rows on both sides of the outer split, and inner rows that are outer test rows.

    ``outer`` is DF[keys, id, fold], ``nested`` DF[keys, id, outer_fold, inner_fold]. A row must have one outer
    fold and one inner fold per outer fold; all three counts must be 0.
    """

    twice = outer.groupBy(*keys, id).agg(F.countDistinct("fold").alias("n")).filter("n > 1")
    leaked = nested.join(
        outer.select(*keys, id, F.col("fold").alias("outer_fold")), [*keys, id, "outer_fold"], "left_semi"
    )
    inner_twice = (
        nested.groupBy(*keys, id, "outer_fold").agg(F.countDistinct("inner_fold").alias("n")).filter("n > 1")
    )
    cells = nested.select(*keys, "outer_fold").distinct()
    count = F.count(F.lit(1))
    return (
        cells.join(leaked.groupBy(*keys, "outer_fold").agg(count.alias("leaked_rows")), [*keys, "outer_fold"], "left")
        .join(
            inner_twice.groupBy(*keys, "outer_fold").agg(count.alias("inner_overlap")),
            [*keys, "outer_fold"],
            "left",
        )
        .join(
            twice.join(outer, [*keys, id])
            .groupBy(*keys, F.col("fold").alias("outer_fold"))
            .agg(count.alias("outer_overlap")),
            [*keys, "outer_fold"],
            "left",
        )
        .na.fill(0)
    )


def training_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """Every row once per fold that trains on it; ``fold`` becomes the fold being fitted."""

    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return df.withColumn("_fit", F.explode(others)).drop("fold").withColumnRenamed("_fit", "fold")


def prep_impute_median(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5):
    """(rows with nulls filled, DF[fold, column, median]); medians come from the training part of each fold.

    The result has each row once per fold it is used in, with ``is_test`` telling the side.
    """

    used = _per_fold(df, fold, k)
    fitted = exact_quantile(used.filter(~F.col("is_test")), [fold], cols, 0.5, "median")
    wide = fitted.groupBy(fold).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_{c}") for c in cols]
    )
    filled = used.join(F.broadcast(wide), fold, "left")
    for c in cols:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"))).drop(f"_{c}")
    return filled, fitted


def _per_fold(df: DataFrame, fold: str, k: int) -> DataFrame:
    if "is_test" in df.columns:
        return df
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return (
        df.withColumn("_fit", every)
        .withColumn("is_test", F.col("_fit") == F.col(fold))
        .drop(fold)
        .withColumnRenamed("_fit", fold)
    )


def prep_impute_mode(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5):
    """(rows with nulls filled, DF[fold, column, mode, n]); ties go to the smallest value."""

    used = _per_fold(df, fold, k)
    counts = (
        used.filter(~F.col("is_test"))
        .select(
            fold,
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
            ).alias("cell"),
        )
        .select(fold, "cell.column", "cell.v")
        .filter(F.col("v").isNotNull())
        .groupBy(fold, "column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = Window.partitionBy(fold, "column").orderBy(F.desc("n"), F.asc("v"))
    fitted = (
        counts.withColumn("_r", F.row_number().over(first))
        .filter("_r = 1")
        .select(fold, "column", F.col("v").alias("mode"), "n")
    )
    wide = fitted.groupBy(fold).agg(
        *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"_{c}") for c in cols]
    )
    filled = used.join(F.broadcast(wide), fold, "left")
    for c in cols:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("string"), F.col(f"_{c}"))).drop(f"_{c}")
    return filled, fitted


def prep_scale(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5):
    """(rows scaled to z-scores, DF[fold, <c>_mean, <c>_std]); population std, zero variance divides by 1."""

    used = _per_fold(df, fold, k)
    fitted = (
        used.filter(~F.col("is_test"))
        .groupBy(fold)
        .agg(
            *[F.avg(c).alias(f"{c}_mean") for c in cols],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
        )
    )
    fitted = fitted.withColumns(
        {f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in cols}
    )
    scaled = used.join(F.broadcast(fitted), fold)
    for c in cols:
        scaled = scaled.withColumn(c, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
    return scaled.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")]), fitted


def _vocabulary(used: DataFrame, cols: Sequence[str], fold: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    seen = (
        used.filter(~F.col("is_test"))
        .select(fold, F.explode(cells).alias("cell"))
        .select(fold, "cell.column", F.col("cell.v").alias("category"))
        .filter(F.col("category").isNotNull())
        .distinct()
    )
    order = Window.partitionBy(fold, "column").orderBy("category")
    return seen.withColumn("code", F.row_number().over(order) - 1)


def prep_ordinal(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5):
    """(rows with ``<c>_code``, DF[fold, column, category, code]); unseen categories get -1."""

    used = _per_fold(df, fold, k)
    vocab = _vocabulary(used, cols, fold)
    coded = used
    for c in cols:
        one = vocab.filter(F.col("column") == c).select(
            fold, F.col("category").alias(f"_{c}"), F.col("code").alias(f"{c}_code")
        )
        coded = (
            coded.join(
                one.withColumnRenamed(fold, "_fold"),
                (F.col(fold) == F.col("_fold")) & (F.col(c).cast("string") == F.col(f"_{c}")),
                "left",
            )
            .drop("_fold", f"_{c}")
            .withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1)))
        )
    return coded, vocab


def _is(code: Column):
    return lambda i: (i == code).cast("double")


def prep_onehot(coded: DataFrame, cols: Sequence[str], vocab: DataFrame, fold: str = "fold") -> DataFrame:
    """Indicator arrays ``<c>_hot`` from ordinal codes; unseen categories give all zeros."""

    widths = vocab.groupBy(fold).agg(
        *[F.count(F.when(F.col("column") == c, 1)).cast("int").alias(f"_{c}") for c in cols]
    )
    hot = coded.join(F.broadcast(widths), fold)
    for c in cols:
        code = F.col(f"{c}_code")
        indicator = F.transform(F.sequence(F.lit(0), F.col(f"_{c}") - 1), _is(code))
        hot = hot.withColumn(f"{c}_hot", indicator).drop(f"_{c}")
    return hot


def missing_sentinel(categories: Column) -> Column:
    """First of ``__MISSING__``, ``__MISSING__1``, ... that is not a category of the column."""

    tries = F.concat(
        F.array(F.lit("__MISSING__")),
        F.transform(
            F.sequence(F.lit(1), F.size(categories) + 1), lambda i: F.concat(F.lit("__MISSING__"), i.cast("string"))
        ),
    )
    return F.element_at(F.array_except(tries, categories), 1)


def prep_native_vocab(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5):
    """(rows with unseen or null categories replaced by a sentinel, DF[fold, column, category, code]).

    The sentinel is the last code of its column and never equals a real category. Only the values that look
    like the sentinel are collected, so the check does not grow with the vocabulary.
    """

    used = _per_fold(df, fold, k)
    vocab = _vocabulary(used, cols, fold)
    clash = F.filter(
        F.collect_list(F.when(F.col("category").startswith("__MISSING__"), F.col("category"))), lambda v: v.isNotNull()
    )
    sentinels = (
        vocab.groupBy(fold, "column")
        .agg(clash.alias("clash"), F.count(F.lit(1)).cast("int").alias("code"))
        .select(fold, "column", missing_sentinel(F.col("clash")).alias("category"), "code")
    )
    wide = sentinels.groupBy(fold).agg(
        *[F.max(F.when(F.col("column") == c, F.col("category"))).alias(f"_{c}") for c in cols]
    )
    coded, _ = prep_ordinal(used, cols, fold, k)
    out = coded.join(F.broadcast(wide), fold, "left")
    for c in cols:
        out = out.withColumn(
            c, F.when(F.col(f"{c}_code") >= 0, F.col(c).cast("string")).otherwise(F.col(f"_{c}"))
        ).drop(f"_{c}", f"{c}_code")
    return out, vocab.unionByName(sentinels)


def prep_code_to_label(df: DataFrame, cols: Sequence[str], vocab: DataFrame, fold: str = "fold") -> DataFrame:
    """Resampled codes back to labels: rounded, out of range becomes the sentinel (the last code)."""

    last = vocab.groupBy(fold).agg(
        *[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"_{c}_last") for c in cols]
    )
    out = df.join(F.broadcast(last), fold)
    for c in cols:
        code = F.rint(F.col(f"{c}_code")).cast("int")
        inside = F.when(code.between(0, F.col(f"_{c}_last")), code).otherwise(F.col(f"_{c}_last"))
        one = vocab.filter(F.col("column") == c).select(
            F.col(fold).alias("_fold"), F.col("category").alias(c), F.col("code").alias("_code")
        )
        out = (
            out.drop(c)
            .withColumn("_want", inside)
            .join(one, (F.col(fold) == F.col("_fold")) & (F.col("_want") == F.col("_code")))
            .drop("_fold", "_code", "_want", f"_{c}_last")
        )
    return out


def prep_class_weight(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Adds the balanced weight ``n / (C * n_c)``. Only the class counts are windowed, never the rows."""

    counts = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    weights = counts.withColumn(
        "weight", F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))
    ).drop("_n")
    return df.join(weights, [*keys, y])


def prep_path(spark: SparkSession) -> DataFrame:
    """DF[model, layout, condition, path]: representation per cell; null path means not applicable.

    Native models also take random over- and under-sampling on mixed tables: the estimator and the protocol
    accept them although one helper of the protocol's code does not.
    """

    rows = []
    for model in rules.CLASSIFIERS_V2:
        for condition in rules.CONDITIONS:
            rows.append((model, "numeric", condition, "numeric"))
            sampled = condition in rules.SAMPLER_CONDITIONS
            if model == "logistic_regression":
                path = "one_hot_after_fold_local_sampling" if sampled else "one_hot"
            elif model == "random_forest":
                path = "ordinal_encoded_tree_features"
            elif condition in ("raw", "class_weighted", "random_over", "random_under"):
                path = "native_categorical"
            elif condition in ("smotenc", "smoteenn", "smotetomek"):
                path = "fold_local_ordinal_sampler_then_native_recast"
            else:
                path = None
            rows.append((model, "mixed", condition, path))
    return spark.createDataFrame(rows, "model string, layout string, condition string, path string")


def prep_feature_assembly(df: DataFrame, layout: Layout, fold: str = "fold", k: int = 5, scale: bool = True):
    """Train[.., fold, is_test, x, cats]: impute, scale and encode every row with training statistics only."""

    rows, _ = prep_impute_median(df, layout.numeric, fold, k)
    if scale:
        rows, _ = prep_scale(rows, layout.numeric, fold, k)
    if layout.categorical:
        rows, _ = prep_impute_mode(rows, layout.categorical, fold, k)
        rows, vocab = prep_ordinal(rows, layout.categorical, fold, k)
        rows = prep_onehot(rows, layout.categorical, vocab, fold)
        hot = [F.col(f"{c}_hot") for c in layout.categorical]
        rows = rows.withColumn("cats", F.array(*[F.col(c) for c in layout.categorical]))
    else:
        hot = []
    numeric = F.array(*[F.col(c).cast("double") for c in layout.numeric])
    return rows.withColumn("x", F.concat(numeric, *hot))
