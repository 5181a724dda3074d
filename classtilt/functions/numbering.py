"""Row numbers and generated rows for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    tie: str,
    name: str,
    digits: int = 3,
) -> DataFrame:
    """``row_number() over (partition by keys order by hash_col, tie)`` without one task per group.

    The leading hex digits of the hash split every group into ``16 ** digits`` even ranges. Rows are numbered
    inside their range and shifted by the number of rows in the ranges before it, so a class that holds a third
    of all rows is spread over thousands of window partitions.
    """

    keys = list(keys)
    ranged = df.withColumn("_range", F.substring(F.col(hash_col), 1, digits))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(hash_col, tie)
    return (
        ranged.join(shifts, [*keys, "_range"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_shift")).cast("bigint"))
        .drop("_range", "_shift")
    )


def explode_counts(df: DataFrame, count: str, name: str, chunk: int = 50_000) -> DataFrame:
    """One row per integer 1..count, generated in chunks that are spread over the cluster first."""

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = (
        df.filter(F.col(count) > 0)
        .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (`{count}` - 1) div {chunk})")))
        .repartition(parts, *[c for c in df.columns if c != count], "_chunk")
    )
    low, high = f"_chunk * {chunk} + 1", f"least(`{count}`, (_chunk + 1) * {chunk})"
    return chunks.withColumn(name, F.explode(F.expr(f"sequence({low}, {high})"))).drop("_chunk")
