"""Nested, tuned cells: trials, inner fits, selection, thresholds and the refit, as stages that can be resumed.

A cell is (outer fold, classifier, condition). Its trials are scored on inner folds of the outer training part, the best
trial's out-of-fold rows choose the class thresholds, and the chosen parameters are fitted once more on the whole outer training
part and scored on the outer test fold. Every stage is a table below one folder, keyed by what it was made for:

=================  =========================================================================
``plan``           settings and a digest of the rows; another plan in the same folder is an error
``splits``         every row once per split that uses it
``imputed/...``    the same with nulls filled and numbers scaled, by training rows only
``prepared/...``   rows of all splits of one condition, sampled and encoded by training rows only
``inner/...``      predictions of the validation rows per cell, trial and inner fold
``scores``         mean macro-AP per trial
``selected``       the best trial of each cell
``offsets``        thresholds per cell
``outer/...``      predictions of the outer test rows per cell
=================  =========================================================================

A key counts as finished when Spark has committed its folder (``_SUCCESS``); a run over the same folder does the rest only.
Preparation and sampling run once per condition for all splits, not once per fit, and the chosen trial's out-of-fold rows are
the ones its score came from, so nothing is fitted twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators.metrics import met_bundle
from classtilt.operators.prepare import (
    Layout,
    prep_class_weight,
    prep_impute_median,
    prep_impute_mode,
    prep_nested_kfold,
    prep_onehot,
    prep_ordinal,
    prep_scale,
)
from classtilt.operators.resample import (
    rs_adasyn,
    rs_borderline,
    rs_random_over,
    rs_random_under,
    rs_smote,
    rs_smoteenn,
    rs_smotenc,
    rs_smotetomek,
)
from classtilt.operators.thresholds import thr_fit
from classtilt.operators.train import (
    BAGS,
    fit_balanced_forest,
    fit_boosted,
    fit_forest,
    fit_logistic,
    fit_predict_proba,
    grid_retry,
)
from classtilt.operators.tune import space_table, tune_inner_score, tune_oof, tune_select, tune_trials

CELL = ["outer_fold", "classifier", "condition"]
CELL_TYPES = "outer_fold int, classifier string, condition string"
PREDICTED = "id string, y int, p array<double>"

#: The split of an outer fold on which the chosen trial is refitted; inner splits count from 0.
REFIT = -1


def nested_applicability(feature_type: str, classifier: str, condition: str) -> str | None:
    """Why a cell cannot run, or None."""

    if condition == "balanced_random_forest" and classifier != "random_forest":
        return rules.FOREST_ONLY_MESSAGE
    if condition == "smotenc" and feature_type != "mixed":
        return rules.SMOTENC_MESSAGE
    if condition in rules.NUMERIC_ONLY_CONDITIONS and feature_type != "numeric":
        return f"{condition} {rules.NUMERIC_ONLY_MESSAGE}"
    return None


def nested_splits(rows: DataFrame, k: int = rules.FOLDS, inner_k: int = rules.INNER_FOLDS, seed: int = rules.INNER_SEED) -> DataFrame:
    """Each row once per split that uses it, with ``outer_fold``, ``split``, ``is_test`` and ``fold``, the split's name.

    ``rows`` is DF[id, y, fold, ...]. Split ``REFIT`` of an outer fold tests on that fold and trains on the others; its inner
    splits share out the training part alone, so an outer test row is in no inner split.
    """

    nested = prep_nested_kfold(rows, [], "id", "y", inner_k, seed, k)
    inside = nested.withColumn("split", F.explode(F.sequence(F.lit(REFIT), F.lit(inner_k - 1))))
    inside = inside.withColumn("is_test", F.col("split") == F.col("inner_fold")).drop("inner_fold", "fold")
    outside = rows.withColumnRenamed("fold", "outer_fold").withColumn("split", F.lit(REFIT)).withColumn("is_test", F.lit(True))
    return inside.unionByName(outside).withColumn("fold", F.concat_ws("/", "outer_fold", "split"))


def nested_sample(train: DataFrame, condition: str, seed: int, k: int = 3, m: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """(sampled rows, DF[fold, y, error] or None) of all splits at once; mixed rows have ``cats``."""

    keys = ["fold"]
    if condition in ("raw", "class_weighted", "balanced_random_forest"):
        return train, None
    if condition == "random_over":
        return rs_random_over(train, keys, seed), None
    if condition == "random_under":
        return rs_random_under(train, keys, seed), None
    if condition == "smote":
        return rs_smote(train, keys, k, seed), None
    if condition == "borderline_smote":
        return rs_borderline(train, keys, k, m, seed), None
    if condition == "smotenc":
        return rs_smotenc(train, keys, k, seed), None
    if condition == "smoteenn":
        return rs_smoteenn(train, keys, k, seed), None
    if condition == "smotetomek":
        return rs_smotetomek(train, keys, k, seed), None
    if condition == "adasyn":
        return rs_adasyn(train, keys, k, seed)
    raise ValueError(f"unknown condition: {condition}")


def nested_impute(splits: DataFrame, layout: Layout, one_hot: bool) -> DataFrame:
    """DF[fold, id, y, x, cats, is_test]: nulls filled by each split's training medians and modes, ``one_hot`` with numbers scaled."""

    rows, _ = prep_impute_median(splits, layout.numeric)
    if one_hot:
        rows, _ = prep_scale(rows, layout.numeric)
    cats = list(layout.categorical)
    if cats:
        rows, _ = prep_impute_mode(rows, cats)
        rows = rows.withColumn("cats", F.array(*[F.col(c) for c in cats]))
    plain = ["fold", F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in layout.numeric]).alias("x")]
    return rows.select(*plain, *(["cats"] if cats else []), "is_test")


def nested_prepare(rows: DataFrame, layout: Layout, condition: str, one_hot: bool, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """(DF[outer_fold, split, is_test, id, y, x], failures) from imputed rows.

    Training rows are sampled, then categories are encoded by the training rows' vocabulary: ``one_hot`` by indicators, else by
    ordinal codes.
    """

    cats = list(layout.categorical)
    columns = ["fold", "id", "y", "x", *(["cats"] if cats else [])]
    train, failures = nested_sample(rows.filter(~F.col("is_test")).select(*columns), condition, seed)
    used = train.select(*columns).withColumn("is_test", F.lit(False)).unionByName(rows.filter("is_test"))
    if cats:
        used = used.withColumns({c: F.col("cats")[i] for i, c in enumerate(cats)})
        used, vocab = prep_ordinal(used, cats)
        if one_hot:
            used = prep_onehot(used, cats, vocab)
            used = used.withColumn("x", F.concat("x", *[F.col(f"{c}_hot") for c in cats]))
        else:
            used = used.withColumn("x", F.concat("x", F.array(*[F.col(f"{c}_code").cast("double") for c in cats])))
    place = F.split("fold", "/")
    named = used.withColumns({"outer_fold": place[0].cast("int"), "split": place[1].cast("int")})
    return named.select("outer_fold", "split", "is_test", "id", "y", "x"), failures


def model_params(model: str, params: dict[str, str], rows: int) -> dict:
    """Parameters of a search space as Spark's models name them.

    The inverse penalty ``C`` belongs to a sum over rows and Spark's to their mean. Trees are at most 30 deep, Spark's limit, also
    where the depth is open. Spark's boosted trees have no weight penalties: ``reg_alpha``, ``reg_lambda`` and
    ``min_child_weight`` are drawn and recorded but have no effect.
    """

    if model == "logistic_regression":
        return {
            "regParam": 1.0 / (float(params["C"]) * rows),
            "elasticNetParam": 1.0 if params["penalty"] == "l1" else 0.0,
            "maxIter": int(params["max_iter"]),
            "standardization": False,
        }
    if model in ("random_forest", "balanced_random_forest"):
        depth, share = params["max_depth"], params["max_features"]
        return {
            "numTrees": int(params["n_estimators"]),
            "maxDepth": 30 if depth == "null" else min(30, int(depth)),
            "minInstancesPerNode": int(params["min_samples_leaf"]),
            "featureSubsetStrategy": "all" if share == "1.0" else share,
        }
    if model == "xgboost":
        return {
            "maxIter": int(params["n_estimators"]),
            "stepSize": float(params["learning_rate"]),
            "maxDepth": int(params["max_depth"]),
            "subsamplingRate": float(params["subsample"]),
            "featureSubsetStrategy": str(float(params["colsample_bytree"])),
        }
    raise ValueError(f"no model for {model}")


def fit_and_predict(train: DataFrame, test: DataFrame, classifier: str, condition: str, params: dict, seed: int, bags: int = BAGS) -> DataFrame:
    """Test rows with ``p``; ``params`` are Spark's."""

    weight = None
    if condition == "class_weighted":
        train, weight = prep_class_weight(train, [], "y"), "weight"
    if condition == "balanced_random_forest":
        model = fit_balanced_forest(train, bags, params, seed)
    elif classifier == "logistic_regression":
        model = fit_logistic(train, params, weight)
    else:
        model = {"random_forest": fit_forest, "xgboost": fit_boosted}[classifier](train, params, weight, seed)
    return fit_predict_proba(model, test).select("id", "y", "p")


def _done(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written first if no run has finished it."""

    if not _done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _key_path(key: dict) -> str:
    return "/".join(f"{name}={value}" for name, value in key.items())


def _keyed(spark: SparkSession, root: str, schema: str, paths: Sequence[str]) -> DataFrame:
    """The union of finished keys below ``root``; an empty table where there is none."""

    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def nested_run(
    rows: DataFrame,
    layout: Layout,
    cells: Iterable[tuple[int, str, str]],
    classes: int,
    folder: str,
    k: int = rules.FOLDS,
    inner_k: int = rules.INNER_FOLDS,
    trials: int = rules.TRIALS,
    spaces: dict = rules.SEARCH_SPACES,
    seed: int = rules.OUTER_SEED,
    bags: int = BAGS,
    pool: int = 8,
    max_retries: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, failures, trials) of the cells (outer fold, classifier, condition) of one dataset.

    ``rows`` is DF[id, y, fold, columns of the layout]: ids are unique, ``y`` counts from 0, ``fold`` is the outer fold. Columns
    may hold nulls; a column without any value in a training part fails that part's fits. Failed trials are rows of ``trials``; a cell
    whose trials all fail, whose refit fails or that is not applicable is a row of ``failures``. A cell whose out-of-fold rows are
    incomplete keeps thresholds of 0 and says so. Only records of cells and trials reach the driver.
    """

    spark = rows.sparkSession
    cells = [dict(zip(CELL, cell, strict=True)) for cell in cells]
    columns = ["id", "y", "fold", *layout.numeric, *layout.categorical]
    rows = rows.select(*columns)
    settings = {
        "layout": [list(layout.numeric), list(layout.categorical)], "cells": sorted(_key_path(c) for c in cells), "classes": classes,
        "k": k, "inner_k": inner_k, "trials": trials, "spaces": spaces, "seed": seed, "bags": bags,
    }
    digest = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    plan = json.dumps(settings | {"rows": [digest["n"], str(digest["h"])]}, sort_keys=True)
    held = _once(spark, f"{folder}/plan", lambda: spark.createDataFrame([(plan,)], "plan string")).first()["plan"]
    if held != plan:
        raise ValueError("the folder holds the stages of another plan")

    failed, runnable = [], []
    for cell in cells:
        message = nested_applicability(layout.feature_type, cell["classifier"], cell["condition"])
        if message:
            failed.append({**cell, "stage": "applicability", "error_type": "ValueError", "error": message, "retry_count": 0})
        else:
            runnable.append(cell)

    # Stage 1: rows of every split, prepared and sampled, per condition and representation.
    def kind(cell: dict) -> tuple[str, bool]:
        return cell["condition"], cell["classifier"] == "logistic_regression"

    splits = _once(spark, f"{folder}/splits", lambda: nested_splits(rows, k, inner_k))
    sizes, broken = {}, {}
    for condition, one_hot in sorted({kind(c) for c in runnable}):
        root = f"{folder}/prepared/{condition}-{'onehot' if one_hot else 'ordinal'}"
        outer = sorted({c["outer_fold"] for c in runnable if kind(c) == (condition, one_hot)})
        filled = _once(spark, f"{folder}/imputed/{'scaled' if one_hot else 'plain'}", lambda one_hot=one_hot: nested_impute(splits, layout, one_hot))
        _prepare(spark, filled, layout, condition, one_hot, outer, root, inner_k, seed)
        for r in spark.read.parquet(f"{root}/rows").filter("not is_test").groupBy("outer_fold", "split", "y").count().collect():
            sizes.setdefault((condition, one_hot, r["outer_fold"], r["split"]), {})[r["y"]] = r["count"]
        for r in spark.read.parquet(f"{root}/failures").orderBy("fold", "error").collect():
            place = tuple(int(v) for v in r["fold"].split("/"))
            broken.setdefault((condition, one_hot, *place), r["error"])

    drawn = {}
    for model in sorted({_model(c) for c in runnable}):
        table = tune_trials(space_table(spark, {model: spaces[model]}), trials, rules.SEARCH_SEED)
        for r in table.collect():
            drawn.setdefault(model, {}).setdefault(r["trial"], {})[r["param"]] = r["value"]

    def fit(task: tuple[dict, int, int, str]):
        """(task, error, retries): predictions of one split under one trial, written under its key."""

        cell, trial, split, path = task
        if _done(spark, path):
            return task, None, 0
        place = (*kind(cell), cell["outer_fold"], split)

        def run(_):
            if place in broken:
                raise ValueError(broken[place])
            seen = sizes.get(place, {})
            if len(seen) < classes:
                raise ValueError("training rows do not provide every class")
            condition, one_hot = kind(cell)
            root = f"{folder}/prepared/{condition}-{'onehot' if one_hot else 'ordinal'}/rows"
            data = spark.read.parquet(f"{root}/outer_fold={cell['outer_fold']}/split={split}")
            params = model_params(_model(cell), drawn[_model(cell)][trial], sum(seen.values()))
            pred = fit_and_predict(data.filter("not is_test"), data.filter("is_test"), cell["classifier"], condition, params, seed, bags)
            pred.write.mode("overwrite").parquet(path)

        _, error, retries = grid_retry(run, cell, max_retries)
        return task, error, retries

    def fit_all(tasks: list):
        with ThreadPoolExecutor(max_workers=pool) as workers:
            return list(workers.map(fit, tasks))

    # Stage 2: inner fits. A trial fails with the first of its inner folds that fails.
    tasks = [
        (cell, trial, split, f"{folder}/inner/{_key_path(cell)}/trial={trial}/inner_fold={split}")
        for cell in runnable
        for trial in range(1, trials + 1)
        for split in range(inner_k)
    ]
    paths, errors = [], {}
    for (cell, trial, _, path), error, _ in fit_all(tasks):
        if error is None:
            paths.append(path)
        else:
            errors.setdefault((*cell.values(), trial), (type(error).__name__, str(error)))
    inner = _keyed(spark, f"{folder}/inner", f"{PREDICTED}, {CELL_TYPES}, trial int, inner_fold int", paths)
    scores = _once(spark, f"{folder}/scores", lambda: tune_inner_score(inner, CELL, inner_k))
    records = [
        (*cell.values(), trial, json.dumps(drawn[_model(cell)][trial], sort_keys=True), *errors.get((*cell.values(), trial), (None, None)))
        for cell in runnable
        for trial in range(1, trials + 1)
    ]
    tried = spark.createDataFrame(records, f"{CELL_TYPES}, trial int, params string, error_type string, error string")
    scored = tried.join(scores, [*CELL, "trial"], "left")
    score = F.when(F.col("error").isNull(), F.col("score"))
    unscored = score.isNull() & F.col("error").isNull()
    trial_table = scored.select(
        *CELL, "trial", "params", score.alias("macro_average_precision"),
        F.when(score.isNotNull(), rules.VALID).otherwise(rules.FAILED).alias("status"),
        F.when(unscored, "ValueError").otherwise(F.col("error_type")).alias("error_type"),
        F.when(unscored, "macro average precision is not defined in an inner fold").otherwise(F.col("error")).alias("error"),
    )

    # Stage 3: the best trial per cell and its thresholds.
    best, hopeless = tune_select(trial_table.withColumnRenamed("macro_average_precision", "score"), CELL)
    chosen = _once(spark, f"{folder}/selected", lambda: best.join(tried.select(*CELL, "trial", "params"), [*CELL, "trial"]))
    offsets = _once(spark, f"{folder}/offsets", lambda: _thresholds(rows, inner, chosen, classes, k, inner_k))

    # Stage 4: refit on the outer training part. Cells are few: one record each.
    picked = chosen.orderBy(*CELL).collect()
    tasks = []
    for r in picked:
        cell = {c: r[c] for c in CELL}
        tasks.append((cell, r["trial"], REFIT, f"{folder}/outer/{_key_path(cell)}"))
    paths = []
    for (cell, _, _, path), error, retries in fit_all(tasks):
        if error is None:
            paths.append(path)
        else:
            failed.append({**cell, "stage": "outer_fit_predict", "error_type": type(error).__name__, "error": str(error), "retry_count": retries})
    outer = _keyed(spark, f"{folder}/outer", f"{PREDICTED}, {CELL_TYPES}", paths)
    metrics = met_bundle(outer.join(offsets.select(*CELL, "offsets"), CELL), CELL, classes, "offsets")
    used = [
        (*cell.values(), sum(sizes[(*kind(cell), cell["outer_fold"], REFIT)].values()))
        for cell, *_ in tasks
        if (*kind(cell), cell["outer_fold"], REFIT) in sizes
    ]
    after = spark.createDataFrame(used, f"{CELL_TYPES}, rows_after_sampling long")
    folds = rows.groupBy("fold").agg(F.count("*").alias("n"))
    before = folds.select(F.col("fold").cast("int").alias("outer_fold"), (F.lit(digest["n"]) - F.col("n")).alias("rows_before_sampling"))
    results = (
        metrics.join(chosen.select(*CELL, F.col("trial").alias("selected_trial"), F.col("params").alias("selected_params")), CELL)
        .join(offsets.select(*CELL, F.col("offsets").alias("threshold_offsets"), F.col("status").alias("calibration_status"), F.col("reason").alias("calibration_reason")), CELL)
        .join(before, "outer_fold")
        .join(after, CELL)
        .withColumn("status", F.lit(rules.VALID))
    )
    listed = [tuple(f[n] for n in (*CELL, "stage", "error_type", "error", "retry_count")) for f in failed]
    failures = spark.createDataFrame(listed, f"{CELL_TYPES}, stage string, error_type string, error string, retry_count int")
    return results, failures.unionByName(hopeless.withColumn("retry_count", F.lit(0))), trial_table


def _model(cell: dict) -> str:
    return "balanced_random_forest" if cell["condition"] == "balanced_random_forest" else cell["classifier"]


def _prepare(spark, filled, layout, condition, one_hot, outer, root, inner_k, seed) -> None:
    """Writes ``rows`` by (outer fold, split) and ``failures`` by split below ``root``.

    All splits are sampled by one plan. If that fails, splits are sampled one by one, so that a split whose classes are too
    small fails alone.
    """

    if _done(spark, f"{root}/failures"):
        return
    splits = filled.filter(F.split("fold", "/")[0].cast("int").isin(outer))
    names = "fold string, error string"

    def write(part: DataFrame, mode: str) -> list[tuple[str, str]]:
        made, failures = nested_prepare(part, layout, condition, one_hot, seed)
        made.hint("rebalance", "outer_fold", "split").write.mode(mode).partitionBy("outer_fold", "split").parquet(f"{root}/rows")
        # At most one record per split and class.
        return [] if failures is None else [(r["fold"], r["error"]) for r in failures.select("fold", "error").collect()]

    try:
        found = write(splits, "overwrite")
    except Exception:  # found again below for the splits that cause it
        found = []
        made = spark.createDataFrame([], "is_test boolean, id string, y int, x array<double>, outer_fold int, split int")
        made.write.mode("overwrite").partitionBy("outer_fold", "split").parquet(f"{root}/rows")
        for fold in outer:
            for split in range(REFIT, inner_k):
                name = f"{fold}/{split}"
                try:
                    found += write(splits.filter(F.col("fold") == name), "append")
                except Exception as error:
                    found.append((name, _cause(error)))
    spark.createDataFrame(found, names).write.mode("overwrite").parquet(f"{root}/failures")


def _cause(error: Exception) -> str:
    """The message of the check that failed inside a job, or the first line of the error."""

    for line in str(error).splitlines():
        if "USER_RAISED_EXCEPTION" in line:
            return line.split("USER_RAISED_EXCEPTION]")[-1].split(" SQLSTATE")[0].strip()
    return (str(error).splitlines() or [type(error).__name__])[0]


def _thresholds(rows: DataFrame, inner: DataFrame, chosen: DataFrame, classes: int, k: int, inner_k: int) -> DataFrame:
    """DF[cell, offsets, status, reason] from the chosen trials' out-of-fold rows."""

    pred = inner.join(chosen.select(*CELL, "trial"), [*CELL, "trial"])
    other = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    training = rows.select(F.col("id").cast("string").alias("id"), F.explode(other).alias("outer_fold"))
    _, gaps = tune_oof(pred, training.join(chosen.select(*CELL), "outer_fold"), CELL)
    whole = pred.join(gaps.select(*CELL), CELL, "left_anti")
    fitted = thr_fit(whole, CELL, classes).select(*CELL, "offsets", "status", "reason")
    zeros = F.array_repeat(F.lit(0.0), classes)
    return chosen.select(*CELL).join(fitted, CELL, "left").select(
        *CELL,
        F.coalesce("offsets", zeros).alias("offsets"),
        F.coalesce("status", F.lit(rules.FAILED)).alias("status"),
        F.when(F.col("status").isNull(), "threshold fallback: inner out-of-fold probabilities are incomplete").otherwise(F.col("reason")).alias("reason"),
    )
