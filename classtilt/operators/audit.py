"""Dataset audits, registry rules and candidate selection as grouped checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classtilt import rules
from classtilt.operators.prepare import prep_layout
from classtilt.session import cut



# ---- tables ------------------------------------------------------------------------------------


def aud_profile(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``DF[keys, n_rows, n_classes, n_min, n_max, ir, d_raw, has_missing]``; null labels belong to no class."""

    counts = df.groupBy(*keys, target).agg(
        F.count("*").alias("n"),
        F.bool_or(_any_null(df.columns)).alias("_gap"),
    )
    labelled = F.when(F.col(target).isNotNull(), F.col("n"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count(labelled).alias("n_classes"),
        F.coalesce(F.min(labelled), F.lit(0)).alias("n_min"),
        F.coalesce(F.max(labelled), F.lit(0)).alias("n_max"),
        F.try_divide(F.max(labelled).cast("double"), F.min(labelled).cast("double")).alias("ir"),
        F.lit(len([c for c in df.columns if c not in keys]) - 1).cast("bigint").alias("d_raw"),
        F.bool_or("_gap").alias("has_missing"),
    )


def _any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def aud_class_counts(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``label:count|...`` in label-text order."""

    counts = (
        df.filter(F.col(target).isNotNull())
        .groupBy(*keys, F.col(target).cast("string").alias("label"))
        .agg(F.count("*").alias("n"))
    )
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("label", "n"))), lambda c: F.concat_ws(":", c["label"], c["n"].cast("string"))
    )
    return counts.groupBy(*keys).agg(F.array_join(items, "|").alias("class_counts"))


def aud_class_share(df: DataFrame, keys: Sequence[str], column: str = "class_counts") -> DataFrame:
    """Decodes the packed counts: ``DF[keys, class_index, label, proportion]``."""

    items = F.filter(F.split(column, r"\|"), lambda i: F.contains(i, F.lit(":")))
    parts = df.select(*keys, F.posexplode(items).alias("class_index", "_item")).select(
        *keys,
        "class_index",
        F.split("_item", ":", 2)[0].alias("label"),
        F.split("_item", ":", 2)[1].cast("bigint").alias("_n"),
    )
    whole = Window.partitionBy(*keys)
    return parts.select(*keys, "class_index", "label", (F.col("_n") / F.sum("_n").over(whole)).alias("proportion"))


def aud_feature_type(schema: T.StructType, target: str, cats: Sequence[str] = ()) -> str:
    try:
        return prep_layout(schema, target, cats).feature_type
    except ValueError:
        if target not in schema.fieldNames():
            raise
        return "categorical"


def aud_missing(df: DataFrame) -> DataFrame:
    """``DF[column, nulls]`` for every column in one pass."""

    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls")


def aud_duplicates(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Copies after the first: ``DF[keys, duplicate_rows]``."""

    return (
        df.groupBy(*dict.fromkeys([*keys, *cols]))
        .agg((F.count("*") - 1).alias("_copies"))
        .groupBy(*keys)
        .agg(F.sum("_copies").alias("duplicate_rows"))
    )


def aud_label_conflict(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Feature profiles with more than one label: ``DF[keys, groups]``; null features group together."""

    profile = list(dict.fromkeys([*keys, *features]))
    return (
        df.groupBy(*profile)
        .agg((F.min(target) < F.max(target)).alias("_mixed"))
        .groupBy(*keys)
        .agg(F.count_if("_mixed").alias("groups"))
    )


def aud_suspicious(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Columns whose name looks like a group id or a time index: ``DF[column, kind]``."""

    names = spark.createDataFrame([(c,) for c in columns], "column string")

    def has(tokens):
        return F.exists(rules.strings(tokens), lambda t: F.contains(F.lower("column"), t))

    kinds = F.array_compact(F.array(F.when(has(rules.GROUP_TOKENS), "group"), F.when(has(rules.TIME_TOKENS), "time")))
    return names.select("column", F.explode(kinds).alias("kind"))


def aud_score_guard(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Score-like column names a registry must not have."""

    names = spark.createDataFrame([(c,) for c in columns], "column string")
    return names.filter(F.exists(rules.strings(rules.SCORE_MARKERS), lambda m: F.contains(F.lower("column"), m)))


def aud_min_support(profile: DataFrame, folds: int) -> DataFrame:
    problem = F.when(F.col("n_classes") < 3, "fewer than three classes").when(
        F.col("n_min") < folds, "smallest class has fewer rows than folds"
    )
    return profile.withColumn("problem", problem).filter(F.col("problem").isNotNull())


# ---- registry ----------------------------------------------------------------------------------


def aud_normalise(column: str | Column, kind: str) -> Column:
    """Lenient readers of registry cells: text, bool, hash, number, timestamp, path."""

    raw = F.col(column) if isinstance(column, str) else column
    text = F.coalesce(F.trim(raw.cast("string"), F.lit(" \t\n\r\x0b\x0c")), F.lit(""))
    if kind == "text":
        return text
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False)
    if kind == "hash":
        return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))
    if kind == "number":
        value = text.try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if kind == "timestamp":
        return F.try_to_timestamp(text)
    if kind == "path":
        return F.lower(F.replace(text, F.lit("\\"), F.lit("/")))
    raise ValueError(f"unknown kind: {kind}")


def aud_band(ir: Column) -> Column:
    return (
        F.when(ir < 2, "near_balanced_ir_lt_2")
        .when(ir < 5, "mild_ir_2_to_5")
        .when(ir <= 20, "moderate_ir_5_to_20")
        .when(ir > 20, "severe_ir_gt_20")
    )


def aud_expected_conditions(spark: SparkSession) -> DataFrame:
    rows = [("numeric", c) for c in rules.NUMERIC_CONDITIONS] + [("mixed", c) for c in rules.MIXED_CONDITIONS]
    return spark.createDataFrame(rows, "feature_type string, condition string")


def _expected(feature_type: Column) -> Column:
    return (
        F.when(feature_type == "numeric", F.array_sort(rules.strings(rules.NUMERIC_CONDITIONS)))
        .when(feature_type == "mixed", F.array_sort(rules.strings(rules.MIXED_CONDITIONS)))
        .otherwise(F.array().cast("array<string>"))
    )


def _listed(column: str) -> Column:
    items = F.transform(F.split(aud_normalise(column, "text"), ";"), lambda v: F.trim(v))
    return F.array_sort(F.array_distinct(F.filter(items, lambda v: v != "")))


def aud_eligibility(registry: DataFrame) -> DataFrame:
    """``DF[dataset_id, expected_eligible, reasons, agrees, problem]`` from the rules, next to the recorded flag."""

    kind = aud_normalise("feature_type", "text")
    number = lambda c, t: aud_normalise(c, "text").try_cast(t)
    rows, classes, smallest = (number(c, "bigint") for c in ("n_rows", "n_classes", "n_min_class"))
    ratio = number("ir_majority_minority", "double")
    outside = ~kind.isin("numeric", "mixed")
    reasons = F.array_compact(
        F.array(
            F.when(aud_normalise("task_type", "text") != "single-label-classification", "task type is not single-label classification"),
            F.when((rows < 1) | (classes < 3) | (smallest < 10), "minimum row/class/minority-support rule is not met"),
            F.when(outside, "feature type is outside the numeric/mixed core benchmark"),
            F.when(~aud_normalise("has_groups", "bool").eqNullSafe(False), "grouped data is not explicitly supported"),
            F.when(~aud_normalise("has_time_order", "bool").eqNullSafe(False), "time-ordered data is excluded from the core benchmark"),
            F.when(~F.startswith(F.lower(aud_normalise("leakage_status", "text")), F.lit("pass")), "leakage audit is not marked pass"),
            F.when(outside, "unsupported feature representation"),
            F.when(_listed("applicable_conditions") != _expected(kind), "applicability mismatch"),
            F.when(~aud_normalise("imbalance_band", "text").eqNullSafe(aud_band(ratio)), "imbalance_band does not match ir_majority_minority"),
        )
    )
    broken = rows.isNull() | classes.isNull() | smallest.isNull() | ratio.isNull()
    checked = registry.select(
        "dataset_id",
        broken.alias("_broken"),
        reasons.alias("_reasons"),
        aud_normalise("eligible", "bool").alias("_flag"),
        aud_normalise("exclusion_reason", "text").alias("_why"),
    )
    expected = F.when(~F.col("_broken"), F.size("_reasons") == 0)
    problem = (
        F.when(F.col("_broken"), "invalid numeric eligibility metadata")
        .when(F.col("_flag").isNull(), "eligible is not boolean")
        .when(F.col("_flag") != expected, "eligible disagrees with the rules")
        .when(~expected & (F.col("_why") == ""), "ineligible row has no exclusion_reason")
    )
    return checked.select(
        "dataset_id",
        expected.alias("expected_eligible"),
        F.concat_ws("; ", "_reasons").alias("reasons"),
        (F.col("_flag") == expected).alias("agrees"),
        problem.alias("problem"),
    )


def aud_quota(registry: DataFrame, quotas: dict | None = None) -> DataFrame:
    """``DF[dimension, value, n, minimum, ok]`` over the eligible rows, plus the total within its range."""

    quotas = quotas or {"feature_type": rules.FEATURE_QUOTAS, "imbalance_band": rules.BAND_QUOTAS}
    spark = registry.sparkSession
    wanted = spark.createDataFrame(
        [(d, v, n) for d, q in quotas.items() for v, n in q.items()], "dimension string, value string, minimum bigint"
    )
    eligible = registry.filter(aud_normalise("eligible", "bool"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in quotas])
    counts = (
        eligible.select(F.explode(pairs).alias("_p"))
        .groupBy("_p.dimension", "_p.value")
        .agg(F.count("*").alias("n"))
    )
    checked = (
        wanted.join(counts, ["dimension", "value"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("dimension", "value", "n", "minimum", (F.col("n") >= F.col("minimum")).alias("ok"))
    )
    low, high = rules.DATASET_RANGE
    total = eligible.agg(F.count("*").alias("n")).select(
        F.lit("datasets").alias("dimension"),
        F.lit(f"{low}-{high}").alias("value"),
        "n",
        F.lit(low).cast("bigint").alias("minimum"),
        F.col("n").between(low, high).alias("ok"),
    )
    return checked.unionByName(total)


def aud_unique_nonempty(df: DataFrame, column: str) -> DataFrame:
    """Blank or repeated values: ``DF[value, n, problem]``."""

    return (
        df.groupBy(aud_normalise(column, "text").alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("problem", F.when(F.col("value") == "", "empty").when(F.col("n") > 1, "duplicate"))
        .filter(F.col("problem").isNotNull())
    )


def aud_reconcile_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: ``DF[key, side]``."""

    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    return (
        left.join(right, key, "full")
        .filter(F.col("_a").isNull() | F.col("_b").isNull())
        .select(key, F.when(F.col("_b").isNull(), "left only").otherwise("right only").alias("side"))
    )


def aud_reconcile_fields(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Differing fields: ``DF[key, field, left, right]``; versions may contain one another, hashes ignore case."""

    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                aud_normalise(F.col(f"a.{f}"), "text").alias("left"),
                aud_normalise(F.col(f"b.{f}"), "text").alias("right"),
            )
            for f in fields
        ]
    )
    left, right = F.col("left"), F.col("right")
    version = (F.col("field") == "source_version") & (F.contains(left, right) | F.contains(right, left))
    digest = (F.col("field") == "raw_sha256") & (F.lower(left) == F.lower(right))
    return (
        a.alias("a")
        .join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
        .select(F.col(f"a.{key}").alias(key), F.explode(cells).alias("_c"))
        .select(key, "_c.field", "_c.left", "_c.right")
        .filter((left != right) & ~version & ~digest)
    )


def aud_verify_files(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Manifest sizes and hashes against the files: ``DF[dataset_id, problem]``."""

    size = aud_normalise("file_size_bytes", "text").try_cast("bigint")
    digest = aud_normalise("raw_sha256", "hash")
    joined = manifest.withColumn("path", F.col("local_path")).join(digests, "path", "left")
    problems = F.array_compact(
        F.array(
            F.when(digest.isNull(), "invalid SHA-256"),
            F.when(size.isNull() | (size < 1), "invalid byte size"),
            F.when(F.col("length").isNull(), "file is missing"),
            F.when((size >= 1) & (F.col("length") != size), "byte size does not match"),
            F.when(F.col("sha256") != digest, "SHA-256 does not match"),
        )
    )
    return joined.select("dataset_id", F.explode(problems).alias("problem"))


def aud_applicability_parse(df: DataFrame, column: str, vocab: Sequence[str] = rules.APPLICABILITY) -> DataFrame:
    """``DF[dataset_id, conditions, errors]``: canonical order, or the reason the list is not accepted."""

    text = aud_normalise(column, "text")
    parts = F.transform(F.split(text, ";"), lambda v: F.trim(v))
    known = rules.strings(vocab)
    unknown = F.array_sort(F.array_distinct(F.array_except(parts, known)))
    error = (
        F.when(text == "", f"{column} is empty")
        .when(F.exists(parts, lambda v: v == ""), f"{column} contains an empty semicolon-delimited value")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown applicability condition(s): "), F.array_join(unknown, ", ")))
        .when(F.size(F.array_distinct(parts)) != F.size(parts), f"{column} contains duplicate conditions")
    )
    ordered = F.filter(known, lambda v: F.array_contains(parts, v))
    return df.select(
        "dataset_id",
        F.when(error.isNull(), ordered).otherwise(F.array().cast("array<string>")).alias("conditions"),
        error.alias("errors"),
    )


def aud_applicability_type(df: DataFrame, column: str = "applicable_families") -> DataFrame:
    """Rows whose list does not name exactly their own feature type: ``DF[dataset_id, problem]``."""

    declared = aud_normalise("feature_type", "text")
    declared = F.when(declared == "categorical", "categorical-only").otherwise(declared)
    parsed = aud_applicability_parse(df, column).join(df.select("dataset_id", declared.alias("_type")), "dataset_id")
    types = F.filter("conditions", lambda v: v.isin("numeric", "mixed", "categorical-only"))
    wrong = (F.size("conditions") > 0) & (types != F.array("_type"))
    return parsed.filter(wrong).select(
        "dataset_id", F.lit("applicability feature type does not match feature_type").alias("problem")
    )


def aud_eligible_provenance(registry: DataFrame) -> DataFrame:
    """Missing provenance of eligible rows and missing reasons of the others: ``DF[dataset_id, problem]``."""

    eligible = aud_normalise("eligible", "bool")
    why = aud_normalise("exclusion_reason", "text")
    leakage = F.lower(aud_normalise("leakage_status", "text"))
    problems = [
        F.when(eligible.isNull(), "eligible must be true or false"),
        F.when(eligible & (why != ""), "eligible row has an exclusion reason"),
        F.when(~eligible & (why == ""), "excluded row is missing an exclusion reason"),
        F.when(leakage == "", "leakage_status is empty"),
        F.when(eligible & (leakage != "") & ~leakage.startswith("pass"), "eligible row does not have passing leakage status"),
    ]
    problems += [
        F.when(eligible & (aud_normalise(f, "text") == ""), f"eligible row has incomplete {f} provenance")
        for f in rules.PROVENANCE_FIELDS
    ]
    return registry.select("dataset_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def aud_scope_summary(registry: DataFrame, *violations: DataFrame, reviewed: bool = True) -> DataFrame:
    """One row: eligible ids, families, matrix, de-duplicated blockers, ready or pending."""

    spark = registry.sparkSession
    parsed = aud_applicability_parse(registry, "applicable_families")
    scope = parsed.join(
        registry.filter(aud_normalise("eligible", "bool")).select("dataset_id"), "dataset_id", "left_semi"
    )
    blockers = spark.createDataFrame([], "blocker string")
    for table in violations:
        name = F.concat_ws(": ", F.col("dataset_id"), F.col("problem"))
        blockers = blockers.unionByName(table.select(name.alias("blocker")))
    if not reviewed:
        blockers = blockers.unionByName(spark.createDataFrame([("human review is not passed",)], "blocker string"))
    listed = blockers.agg(F.array_sort(F.collect_set("blocker")).alias("blockers"))
    families = parsed.select(F.explode("conditions").alias("c")).agg(F.array_sort(F.collect_set("c")).alias("f"))
    ids = scope.agg(
        F.array_sort(F.collect_list("dataset_id")).alias("dataset_ids"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset_id", "conditions")))).alias("matrix"),
    )
    return ids.select(
        "dataset_ids",
        F.size("dataset_ids").cast("bigint").alias("dataset_count"),
        families.scalar().alias("applicable_families"),
        F.col("matrix").alias("applicability_matrix"),
        listed.scalar().alias("blockers"),
    ).withColumn(
        "status", F.when((F.size("blockers") == 0) & (F.size("dataset_ids") > 0), "ready").otherwise("pending")
    )


def aud_pilot_evidence(evidence: DataFrame, results: DataFrame, failures: DataFrame, expected: int = 495) -> DataFrame:
    """Evidence rows against the outputs: ``DF[dataset_id, problem]``.

    ``evidence``: DF[dataset_id, expected_cells, valid_cells, failure_cells, wall_clock_seconds,
    runtime_budget_seconds, peak_mb, deterministic_replay, failure_review, output_completeness].
    """

    keys = list(rules.CELL_KEYS)
    both = results.select(*keys, F.lit(1).alias("_v")).unionByName(failures.select(*keys, F.lit(0).alias("_v")))
    counted = (
        both.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.sum("_v").alias("_valid"))
        .groupBy(F.col("dataset").alias("dataset_id"))
        .agg(
            F.sum("_valid").alias("_valid"),
            (F.sum("_n") - F.sum("_valid")).alias("_failed"),
            F.max("_n").alias("_most"),
        )
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    joined = evidence.join(counted, "dataset_id", "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("expected_cells").isNull(), "output of a dataset without evidence"),
            F.when(F.col("_most").isNull(), "evidence without output"),
            F.when(F.col("_most") > 1, "duplicate comparison cells"),
            F.when(F.col("expected_cells") != expected, f"expected_cells must equal {expected}"),
            F.when(
                F.col("valid_cells") + F.col("failure_cells") != F.col("expected_cells"),
                "valid and failure cells do not cover expected cells",
            ),
            F.when(F.col("valid_cells") != F.coalesce("_valid", F.lit(0)), "valid_cells does not match the results"),
            F.when(F.col("failure_cells") != F.coalesce("_failed", F.lit(0)), "failure_cells does not match the failures"),
            F.when(~finite("wall_clock_seconds") | (F.col("wall_clock_seconds") < 0), "no finite wall-clock value"),
            F.when(~finite("runtime_budget_seconds") | (F.col("runtime_budget_seconds") <= 0), "runtime budget is invalid"),
            F.when(F.col("wall_clock_seconds") > F.col("runtime_budget_seconds"), "runtime exceeds the budget"),
            F.when(~finite("peak_mb") | (F.col("peak_mb") < 0), "peak memory has no finite value"),
            F.when(F.lower("deterministic_replay") != "passed", "deterministic replay is not passed"),
            F.when(F.lower("failure_review") != "passed", "failure review is not passed"),
            F.when(F.lower("output_completeness") != "complete", "output completeness is not complete"),
        )
    )
    return joined.select("dataset_id", F.explode(problems).alias("problem"))


# ---- candidate selection -----------------------------------------------------------------------


def sel_dedupe(catalog: DataFrame) -> DataFrame:
    """Lowest id per lower-cased name; of the ``mfeat-`` tables only the fixed one stays."""

    named = catalog.withColumn("_name", F.lower("name"))
    kept = named.filter(~F.col("_name").startswith("mfeat-") | (F.col("data_id") == rules.SINGLE_MFEAT_ID))
    first = Window.partitionBy("_name").orderBy("data_id")
    return kept.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_name")


def sel_quota(
    catalog: DataFrame,
    retained: Sequence[int],
    reserve: Sequence[int],
    feature_quotas: dict = rules.FEATURE_QUOTAS,
    band_quotas: dict = rules.BAND_QUOTAS,
    target: int = 45,
) -> DataFrame:
    """Deterministic selection: keep the fixed ids, top up bands, then feature types, then fill to ``target``.

    Rows needed per step never exceed ``target``, so each step is a bounded top-n over the free candidates. The
    catalogue is a metadata table (one row per dataset); the chosen set is at most ``target`` rows.
    """

    # Every step reads the catalogue; it is made once.
    catalog = cut(catalog)
    pool = catalog.select("data_id", "name", "feature_type", "band")
    fixed = [*retained, *reserve]
    chosen = {r["data_id"]: r for r in pool.filter(F.col("data_id").isin(fixed)).collect()}

    def free(candidates, condition, n, order):
        if n <= 0:
            return []
        rest = candidates.filter(condition)
        if chosen:
            names = [r["name"].lower() for r in chosen.values()]
            rest = rest.filter(~F.col("data_id").isin(list(chosen)) & ~F.lower("name").isin(names))
        # Namesakes are dropped among the rows that meet the condition, so one in another band does not shadow them.
        return sel_dedupe(rest).orderBy(*order).limit(n).collect()

    def missing(kind):
        return feature_quotas[kind] - sum(r["feature_type"] == kind for r in chosen.values())

    for band, minimum in band_quotas.items():
        need = minimum - sum(r["band"] == band for r in chosen.values())
        options = {
            kind: free(pool, (F.col("band") == band) & (F.col("feature_type") == kind), need, ["data_id"])
            for kind in ("numeric", "mixed")
        }
        for _ in range(max(0, need)):
            wanted = "numeric" if missing("numeric") >= missing("mixed") else "mixed"
            other = "mixed" if wanted == "numeric" else "numeric"
            queue = options[wanted] or options[other]
            if not queue:
                raise ValueError(f"the catalogue cannot meet the {band} quota")
            row = queue.pop(0)
            chosen[row["data_id"]] = row
    for kind in feature_quotas:
        need = missing(kind)
        rows = free(pool, F.col("feature_type") == kind, need, ["data_id"])
        if len(rows) < need:
            raise ValueError(f"the catalogue cannot meet the {kind} quota")
        chosen.update({r["data_id"]: r for r in rows})
    order = ["band", "feature_type", "data_id"]
    first = Window.partitionBy(F.lower("name")).orderBy(*order)
    named = catalog.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    rows = free(named, F.lit(True), target - len(chosen), order)
    chosen.update({r["data_id"]: r for r in rows})
    if len(chosen) < target:
        raise ValueError(f"the catalogue has only {len(chosen)} candidates")
    return catalog.filter(F.col("data_id").isin(list(chosen))).orderBy("data_id")
