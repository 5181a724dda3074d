"""Distributed fits and the cell grid.

Fits run on ``pyspark.ml``; a cell is many short Spark jobs. The grid writes its rows once, samples each training part once for
all classifiers, submits a bounded number of parts at once, scores all cells together and turns every error of a cell into a
failure row.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators.metrics import met_bundle
from classtilt.operators.prepare import prep_class_weight
from classtilt.operators.resample import (
    rs_adasyn,
    rs_balanced_bootstrap,
    rs_borderline,
    rs_random_over,
    rs_random_under,
    rs_smote,
    rs_smoteenn,
    rs_smotetomek,
    rs_under_by_cuts,
    rs_under_cuts,
)
from classtilt.session import cut, shared_folder

#: Balanced bootstraps of a balanced forest in the protocol.
BAGS = 200

#: Conditions that leave the training rows as they are.
UNSAMPLED = ("raw", "class_weighted", "balanced_random_forest")

#: About as many values of ``x`` (32 MB) make one task of a fit. A fit passes over its rows dozens of times, so on small
#: tables its time is the number of its tasks.
VALUES_PER_TASK = 1 << 22


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))


def fit_logistic(train: DataFrame, params: dict | None = None, weight: str | None = None):
    """Multinomial logistic regression, up to 1000 iterations."""

    model = LogisticRegression(family="multinomial", maxIter=1000)
    return _fit(model, train, params, weight)


def fit_forest(train: DataFrame, params: dict | None = None, weight: str | None = None, seed: int = 0):
    """Random forest of 200 trees unless ``params`` says otherwise."""

    return _fit(RandomForestClassifier(numTrees=200, seed=seed), train, params, weight)


def fit_boosted(train: DataFrame, params: dict | None = None, weight: str | None = None, seed: int = 0):
    """Boosted trees, one model per class against the rest: the role of a softmax booster, not its numbers."""

    trees = GBTClassifier(seed=seed, maxIter=20)
    trees = trees.copy({trees.getParam(k): v for k, v in (params or {}).items()})
    model = OneVsRest(classifier=trees, parallelism=4)
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(_features(train))


def _fit(model, train: DataFrame, params: dict | None, weight: str | None):
    extra = {model.getParam(k): v for k, v in (params or {}).items()}
    if weight:
        extra[model.getParam("weightCol")] = weight
    return model.fit(_features(train), extra)


def fit_balanced_forest(train: DataFrame, bags: int, params: dict | None = None, seed: int = 0) -> list:
    """One forest per balanced bootstrap; their probabilities are averaged."""

    bagged = rs_balanced_bootstrap(train, [], bags, seed)
    return [fit_forest(bagged.filter(F.col("bag") == b), params, seed=seed + b) for b in range(bags)]


def fit_predict_proba(model, df: DataFrame) -> DataFrame:
    """Adds ``p`` (rows sum to 1). A list of models is averaged; one-against-rest margins are turned into odds."""

    if isinstance(model, list):
        out = df.withColumn("p", F.lit(None).cast("array<double>"))
        for one in model:
            step = fit_predict_proba(one, out.withColumnRenamed("p", "_sum"))
            total = F.when(F.col("_sum").isNull(), F.col("p")).otherwise(F.zip_with("_sum", "p", lambda a, b: a + b))
            out = step.withColumn("p", total).drop("_sum")
        raw = F.col("p")
    else:
        kept = [c for c in df.columns if c not in ("features", "label")]
        out = model.transform(_features(df))
        if "probability" in out.columns:
            out = out.select(*kept, vector_to_array("probability").alias("p"))
        else:
            margins = vector_to_array("rawPrediction")
            out = out.select(*kept, F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m))).alias("p"))
        raw = F.col("p")
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("p", F.transform(raw, lambda v: v / total))


def _is_infrastructure(error: BaseException) -> bool:
    return type(error).__name__ in rules.RETRY_ERRORS


def grid_retry(run: Callable[[dict], DataFrame], cell: dict, max_retries: int = 1):
    """(result, error, retries): only infrastructure errors are tried again."""

    for attempt in range(max_retries + 1):
        try:
            return run(cell), None, attempt
        except Exception as error:  # every error of a cell becomes a record
            if attempt == max_retries or not _is_infrastructure(error):
                return None, error, attempt
    raise AssertionError("unreachable")


def grid_resume(cells: DataFrame, markers: DataFrame, key: str = "dataset", stale: DataFrame | None = None) -> DataFrame:
    """Cells of datasets without a valid completion marker.

    ``stale`` are the problems that ``acc_marker_stale`` finds; any of them stops the resumption, as a marker that does
    not fit its files says nothing about what was done.
    """

    found = stale.orderBy(key, "problem").limit(5).collect() if stale is not None else []
    if found:
        raise ValueError("stale completion markers: " + "; ".join(f"{row[key]}: {row['problem']}" for row in found))
    done = markers.filter(F.col("status") == "complete").select(key)
    return cells.join(done, key, "left_anti")


def resample(train: DataFrame, condition: str, k: int = 3, m: int = 10, seed: int = 0) -> DataFrame:
    """Training rows under a condition; ``smoteenn`` and ``smotetomek`` choose their mixed form themselves."""

    if condition in UNSAMPLED:
        return train
    if condition == "random_over":
        return rs_random_over(train, [], seed)
    if condition == "random_under":
        return rs_random_under(train, [], seed)
    if condition == "smote":
        return rs_smote(train, [], k, seed)
    if condition == "borderline_smote":
        return rs_borderline(train, [], k, m, seed)
    if condition == "smoteenn":
        return rs_smoteenn(train, [], k, seed)
    if condition == "smotetomek":
        return rs_smotetomek(train, [], k, seed)
    if condition == "adasyn":
        rows, failures = rs_adasyn(train, [], k, seed)
        broken = failures.orderBy("y").limit(1).collect()
        if broken:
            raise ValueError(broken[0]["error"])
        return rows
    raise ValueError(f"unknown condition for numeric rows: {condition}")


def _place(folds: DataFrame, cell: dict) -> DataFrame:
    """The rows of the cell's dataset and seed."""

    if "_dataset" in folds.columns:
        folds = folds.filter(F.col("_dataset") == f"d{cell['dataset']}").drop("_dataset")
    for name in ("dataset", "seed"):
        if name in folds.columns:
            folds = folds.filter(F.col(name) == F.lit(cell[name])).drop(name)
    return folds


def _sides(folds: DataFrame, cell: dict) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of a cell."""

    own = _place(folds, cell)
    return own.filter(F.col("fold") != cell["fold"]).drop("fold"), own.filter(F.col("fold") == cell["fold"])


def _training_rows(train: DataFrame, classes: int, cell: dict, values: int | None = None, cuts: dict | None = None) -> DataFrame:
    """The cell's training rows after sampling, kept until they are unpersisted, in parts by their size and sorted by id.

    ``values`` is the number of values of ``x`` in ``train`` and ``cuts`` has its places of ``rs_under_cuts``, if known. Trees
    draw rows by their place, so small tables give the same trees however their rows came here. Sampled rows are checkpointed:
    every pass of a fit carries the plan of its rows.
    """

    if values is None:
        values = train.agg(F.sum(F.size("x"))).first()[0] or 0
    if cell["condition"] == "random_under" and cuts:
        rows = rs_under_by_cuts(train, cuts, cell["seed"])
    else:
        rows = resample(train, cell["condition"], seed=cell["seed"])
        if cell["condition"] not in UNSAMPLED:
            rows = cut(rows)
            if cell["condition"] != "random_under":
                values *= classes  # at most: every class grows to the largest
    return rows.coalesce(max(1, -(-values // VALUES_PER_TASK))).sortWithinPartitions("id").persist()


def _cell_predictions(rows: DataFrame, test: DataFrame, params: dict, cell: dict) -> DataFrame:
    """Fit on sampled rows and predict the fold: its rows with ``p``, not computed yet."""

    condition, classifier = cell["condition"], cell["classifier"]
    weight = None
    if condition == "class_weighted":
        rows, weight = prep_class_weight(rows, [], "y"), "weight"
    settings = params.get(classifier, {})
    if condition == "balanced_random_forest":
        model = fit_balanced_forest(rows, params.get("bags", BAGS), settings, cell["seed"])
    elif classifier == "logistic_regression":
        model = fit_logistic(rows, settings, weight)
    else:
        fit = {"random_forest": fit_forest, "xgboost": fit_boosted}[classifier]
        model = fit(rows, settings, weight, cell["seed"])
    return fit_predict_proba(model, test)


def run_cell(folds: DataFrame, classes: int, params: dict, cell: dict) -> dict:
    """Fit on the other folds, predict the fold, return its metrics as one row.

    ``folds`` may hold many datasets and seeds, each with a split of its own, in columns ``dataset`` and ``seed``. The
    cell's seed also decides the draws of samplers and trees.
    """

    started = time.perf_counter()
    train, test = _sides(folds, cell)
    rows = _training_rows(train, classes, cell)
    try:
        # The metrics read the predictions several times; without this each reading would run the model again.
        pred = _cell_predictions(rows, test, params, cell).persist()
    finally:
        rows.unpersist()
    try:
        values = met_bundle(pred, ["fold"], classes).drop("fold").first()
    finally:
        pred.unpersist()
    if values is None:
        raise ValueError("the test fold has no rows")
    return {**cell, **values.asDict(), "fit_predict_seconds": time.perf_counter() - started}


def _store(folds: DataFrame, path: str) -> tuple[DataFrame, list]:
    """(``folds`` written under ``path`` by dataset, seed and fold, the number of values of ``x`` in each of these).

    A cell then reads the files of its own rows only.
    """

    rows = folds
    if "dataset" in folds.columns:
        # As the name of a folder, an empty name would come back as null.
        rows = folds.withColumn("_dataset", F.concat(F.lit("d"), F.col("dataset").cast("string")))
    keys = [c for c in ("_dataset", "seed", "fold") if c in rows.columns]
    sorted_rows = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, "id")
    # An earlier try may have left a part of the rows.
    sorted_rows.write.mode("overwrite").partitionBy(*keys).parquet(path)
    stored = folds.sparkSession.read.schema(rows.schema).parquet(path)
    named = [c.removeprefix("_") for c in keys]
    return stored, stored.groupBy(*named).agg(F.sum(F.size("x")).alias("values")).collect()


def _values(sizes: list, cell: dict) -> int:
    """The number of values in the cell's training rows."""

    others = [r.asDict() for r in sizes if r["fold"] != cell["fold"]]
    return sum(r["values"] or 0 for r in others if all(r[k] == cell[k] for k in r if k in ("dataset", "seed")))


def _write_cell(rows: DataFrame, test: DataFrame, params: dict, cell: dict, path: str) -> None:
    """Fit a cell and write the labels and probabilities of its test rows under ``path``."""

    pred = _cell_predictions(rows, test, params, cell).select(F.col("y").cast("int").alias("y"), "p")
    # An earlier try may have left a part of its rows.
    pred.write.mode("overwrite").parquet(path)


def _scores(spark, done: Sequence[int], folder: str, classes: int) -> dict[int, dict]:
    """Metrics of the written cells by number, all cells in the same jobs; one row per cell reaches the driver."""

    if not done:
        return {}
    pred = spark.read.schema("y int, p array<double>, _cell int").parquet(folder)
    values = met_bundle(pred.filter(F.col("_cell").isin(list(done))), ["_cell"], classes)
    return {row["_cell"]: {k: v for k, v in row.asDict().items() if k != "_cell"} for row in values.collect()}


def grid_run(
    folds: DataFrame, cells: Iterable[dict], classes: int, params: dict | None = None, pool: int = 4, max_retries: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(results, failures) for every cell. Only one metrics row per cell reaches the driver.

    ``folds`` is written once below the shared checkpoint folder, and each training part is sampled once for all cells that
    fit on it. Parts are worked on ``pool`` at a time, the cells of a part one by one; cells write their predictions below the
    same folder, then all are scored at once. If the rows cannot be written, each part reads its own from ``folds``; if cells
    cannot be scored at once, each is scored alone. So an error stays in its cell.
    """

    spark = folds.sparkSession
    cells = list(cells)
    runnable, failed = [], []
    for cell in cells:
        message = rules.UNSUPPORTED_MESSAGES.get((cell["feature_type"], cell["condition"]))
        if cell["condition"] == "balanced_random_forest" and cell["classifier"] != "random_forest":
            message = rules.FOREST_ONLY_MESSAGE
        if message:
            failed.append({**cell, "stage": "applicability", "error_type": "ValueError", "error": message, "elapsed_seconds": 0.0, "retry_count": 0})
        else:
            runnable.append(cell)
    folder = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    predictions = f"{folder}/predictions"

    def fail(cell: dict, error: Exception, retries: int, seconds: float) -> None:
        kind = {"stage": "fit_predict", "error_type": type(error).__name__, "error": str(error)}
        failed.append({**cell, **kind, "retry_count": retries, "elapsed_seconds": seconds})

    parts: dict[tuple, list] = {}
    for number, cell in enumerate(runnable):
        sampler = "raw" if cell["condition"] in UNSAMPLED else cell["condition"]
        parts.setdefault((cell["dataset"], cell["seed"], cell["fold"], sampler), []).append((number, cell))
    stored = grid_retry(lambda path: _store(folds, path), f"{folder}/rows", max_retries)[0] if parts else None
    under: dict[tuple, list] = {}
    for dataset, seed, fold, sampler in parts:
        if stored is not None and sampler == "random_under":
            under.setdefault((dataset, seed), []).append(fold)

    def under_cuts(place):
        """The places where random under-sampling ends in each fold's training part; none if they cannot be found together."""

        cell = dict(zip(("dataset", "seed"), place, strict=True))
        own = _place(stored[0], cell)
        found, _, _ = grid_retry(lambda c: rs_under_cuts(own, under[place], c["seed"]), cell, max_retries)
        return found or {}

    def part(numbered):
        """(number, cell, record, error, retries, seconds) of each cell of a training part; sampling counts in every cell."""

        kept, sampling, done = [], 0.0, []

        def run(cell, number):
            nonlocal sampling
            source, values = (folds, None) if stored is None else (stored[0], _values(stored[1], cell))
            train, test = _sides(source, cell)
            began = time.perf_counter()
            if not kept:
                place = cell["dataset"], cell["seed"]
                under_sampled = cell["condition"] == "random_under" and place in cuts
                found = cuts[place].result().get(cell["fold"]) if under_sampled else None
                kept.append(_training_rows(train, classes, cell, values, found))
                sampling = time.perf_counter() - began
                began = time.perf_counter()
            _write_cell(kept[0], test, params or {}, cell, f"{predictions}/_cell={number}")
            return {"fit_predict_seconds": sampling + time.perf_counter() - began}

        try:
            for number, cell in numbered:
                started, before = time.perf_counter(), sampling
                record, error, retries = grid_retry(lambda c, n=number: run(c, n), cell, max_retries)
                done.append((number, cell, record, error, retries, before + time.perf_counter() - started))
        finally:
            for rows in kept:
                rows.unpersist()
        return done

    written = {}
    with ThreadPoolExecutor(max_workers=pool) as workers:
        # These come first, so that no part waits for one that has not begun.
        cuts = {place: workers.submit(under_cuts, place) for place in under}
        for done in workers.map(part, parts.values()):
            for number, cell, record, error, retries, seconds in done:
                if error is None:
                    written[number] = cell, record, retries, seconds
                else:
                    fail(cell, error, retries, seconds)

    values, error, _ = grid_retry(lambda done: _scores(spark, done, predictions, classes), list(written), max_retries)
    records = []
    for number, (cell, record, retries, seconds) in written.items():
        if error is not None:
            alone, broken, again = grid_retry(lambda done: _scores(spark, done, predictions, classes), [number], max_retries)
            if broken is not None:
                fail(cell, broken, max(retries, again), seconds)
                continue
            values = {**(values or {}), **alone}
        if number not in values:
            fail(cell, ValueError("the test fold has no rows"), retries, seconds)
            continue
        records.append({**cell, **record, **values[number], "status": rules.VALID, "retry_count": retries})
    keys = "dataset string, seed int, fold int, classifier string, condition string, feature_type string"
    metrics = (
        "macro_f1_argmax double, g_mean_argmax double, mcc_argmax double, balanced_accuracy_argmax double, "
        "per_class_recall_argmax array<double>, macro_f1_calibrated double, macro_average_precision double, "
        "per_class_average_precision array<double>, multiclass_brier double, multiclass_log_loss double, "
        "fit_predict_seconds double, status string, retry_count int"
    )
    return (
        _rows(spark, records, f"{keys}, {metrics}"),
        _rows(spark, failed, f"{keys}, stage string, error_type string, error string, elapsed_seconds double, retry_count int"),
    )


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
