"""Writers: tables, per-dataset partitions, manifests and the combined outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snk_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a table. CSV has no arrays or maps, so those columns become JSON text there."""

    if fmt == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def snk_partitioned(df: DataFrame, path: str, by: str = "dataset") -> None:
    """Replaces only the datasets that are in ``df``; the others stay as they are."""

    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def snk_manifest(df: DataFrame, path: str) -> None:
    """One JSON object; the committer's rename makes it appear as a whole."""

    df.coalesce(1).write.mode("overwrite").json(path)


def snk_union(
    spark: SparkSession, root: str, names: Sequence[str] = ("results", "failures"), expected: int | None = None
) -> DataFrame:
    """All per-dataset outputs as one table; a dataset without exactly ``expected`` records is an error."""

    out = None
    for name in names:
        part = spark.read.parquet(f"{root}/{name}").withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if expected is not None:
        wrong = out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
        found = wrong.limit(5).collect()
        if found:
            raise ValueError(f"outputs do not cover the grid: {[r.asDict() for r in found]}")
    return out
