"""Readers of datasets, provenance tables, manifests, digests and the dataset catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classtilt import rules
from classtilt.operators.audit import aud_band


def src_dataset(spark: SparkSession, path: str, target: str, schema: T.StructType | None = None) -> DataFrame:
    """A dataset with its target column; CSV types are inferred unless a schema is given."""

    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not present in {path}")
    return df


def src_provenance(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All-text table with blanks as empty text; missing required columns are an error."""

    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.na.fill("")


def src_manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file. A file that is no object fails when it is read."""

    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def src_digest(spark: SparkSession, glob: str) -> DataFrame:
    """``DF[path, length, sha256]`` of files."""

    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def src_hash_table(spark: SparkSession, path: str) -> DataFrame:
    """``DF[path, sha256]`` from the rows of a markdown table."""

    pattern = r"\| `([^`]+)` \| `([0-9a-fA-F]{64})` \|"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(
        F.regexp_extract("value", pattern, 1).alias("path"), F.lower(F.regexp_extract("value", pattern, 2)).alias("sha256")
    )


def src_overrides(df: DataFrame) -> DataFrame:
    """``DF[dataset_id, column]`` from semicolon lists."""

    items = F.transform(F.split(F.coalesce("categorical_columns", F.lit("")), ";"), lambda v: F.trim(v))
    return df.select("dataset_id", F.explode(F.filter(items, lambda v: v != "")).alias("column"))


def src_catalog(df: DataFrame, column: str = "item") -> DataFrame:
    """Catalogue items (JSON text) to wide metadata of datasets inside the protocol's ranges.

    An item lacking one of the seven qualities is dropped; the nominal target is not counted as a feature.
    """

    schema = "did bigint, name string, version bigint, quality array<struct<name: string, value: string>>"
    # Generators are no projections: what they give is computed once a row, and filters above them do not repeat it.
    item = df.select(F.inline(F.array(F.from_json(column, schema))))

    def last(name):
        """The last value of a quality, as a number."""
        named = F.filter("quality", lambda q: (q["name"] == name) & q["value"].isNotNull())
        return F.try_element_at(named, F.lit(-1))["value"].try_cast("double")

    latest = F.inline(F.array(F.struct(*[last(n).alias(n) for n in rules.CATALOG_QUALITIES])))
    wide = item.select("did", "name", "version", latest).dropna(subset=list(rules.CATALOG_QUALITIES))
    rows, classes, smallest, largest, features, numeric, symbolic = (F.col(n).cast("bigint") for n in rules.CATALOG_QUALITIES)
    flat = wide.select(
        F.col("did").alias("data_id"),
        "name",
        "version",
        rows.alias("n_rows"),
        classes.alias("n_classes"),
        smallest.alias("n_min_class"),
        largest.alias("n_majority"),
        F.greatest(F.lit(1), features - 1).alias("d_raw"),
        numeric.alias("n_numeric"),
        F.greatest(F.lit(0), symbolic - 1).alias("n_symbolic"),
    )
    kind = (
        F.when((F.col("n_numeric") > 0) & (F.col("n_symbolic") > 0), "mixed")
        .when(F.col("n_numeric") > 0, "numeric")
        .otherwise("categorical-only")
    )
    flat = flat.withColumn("feature_type", kind).withColumn(
        "band", aud_band(F.try_divide(F.col("n_majority").cast("double"), F.col("n_min_class").cast("double")))
    )
    name = F.lower("name")
    prefixed = F.lit(False)
    for prefix in rules.EXCLUDED_PREFIXES:
        prefixed = prefixed | name.startswith(prefix)
    return flat.filter(
        ~F.col("data_id").isin(*rules.EXCLUDED_IDS)
        & (F.col("n_classes") >= 3)
        & (F.col("n_min_class") >= 10)
        & F.col("n_rows").between(100, 100_000)
        & F.col("d_raw").between(1, 1_000)
        & F.col("feature_type").isin("numeric", "mixed")
        & ~name.isin(*rules.EXCLUDED_NAMES)
        & ~prefixed
        & ~(name.startswith("thyroid-") & ~F.col("data_id").isin(*rules.THYROID_IDS))
        & ~F.contains(name, F.lit("_seed_"))
    )
