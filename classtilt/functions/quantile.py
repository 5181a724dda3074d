"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    q: float = 0.5,
    name: str = "value",
    accuracy: int = 100_000,
) -> DataFrame:
    """Linear-interpolated quantile per key and column: ``DF[keys, column, n, value]``.

    ``percentile`` keeps every distinct value of a group in one buffer. Here a bounded sketch first brackets
    the wanted rank; the second pass only counts the rows below the bracket and sorts the few values inside it.
    """

    keys = list(keys)
    margin = 10.0 / accuracy
    levels = F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin)))
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("cell"),
    ).select(*keys, "cell.column", "cell.v")
    group = [*keys, "column"]
    brackets = long.groupBy(*group).agg(
        F.count("v").alias("n"),
        F.percentile_approx("v", levels, accuracy).alias("bracket"),
    )
    side = F.when(F.col("v") < F.col("bracket")[0], -1).when(F.col("v") > F.col("bracket")[1], 1).otherwise(0)
    counted = (
        long.filter(F.col("v").isNotNull())
        .join(brackets, group)
        .withColumn("side", side)
        .withColumn("inside", F.when(F.col("side") == 0, F.col("v")))
        .groupBy(*group, "n", "side", "inside")
        .agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        .withColumn("v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    )
    running = Window.partitionBy(*group).orderBy("side", "v")
    place = (F.col("n") - 1) * F.lit(float(q))
    reached = counted.withColumn("upto", F.sum("m").over(running)).withColumn("place", place)
    ends = reached.groupBy(*group, "n").agg(
        F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("lo"),
        F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("hi"),
        F.max(F.col("place") - F.floor("place")).alias("part"),
    )
    value = F.col("lo") + (F.coalesce("hi", "lo") - F.col("lo")) * F.col("part")
    return ends.select(*group, "n", value.alias(name))
