"""Average ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def fn_avg_rank(value: Column, partition: list, descending: bool = False) -> Column:
    """Rank with ties sharing the mean of their places; best is 1 when ``descending``."""

    order = value.desc() if descending else value.asc()
    place = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    tied = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return place + (tied - 1) / F.lit(2.0)
