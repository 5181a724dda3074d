"""Distribution functions as column expressions (closed series, no Python at run time)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(value: float) -> Column:
    return F.lit(float(value))


def _series(first: Column, ratio, terms: Column) -> Column:
    """first * (1 + r1 + r1*r2 + ...): sum of a series given by the ratio of consecutive terms."""

    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc, n):
        term = acc["t"] * ratio(n.cast("double"))
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    numbers = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms.cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, start, step, lambda acc: acc["s"])


def _norm_tail(z: Column) -> Column:
    """P(standard normal > z) for z of 2.5 and more: Laplace's continued fraction, from its far end inwards."""

    density = F.exp(-z * z / _d(2)) / _d(math.sqrt(2 * math.pi))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda acc, i: z + i.cast("double") / acc)
    return density / fraction


def _norm_middle(z: Column) -> Column:
    first = z * F.exp(-z * z / _d(2)) / _d(math.sqrt(2 * math.pi))
    return _series(first, lambda n: z * z / (_d(2) * n + _d(1)), F.lit(60))


def fn_chi2_sf(x: Column, df: Column) -> Column:
    """P(chi-square with ``df`` degrees of freedom > x), for whole ``df``: the finite sum of the upper tail.

    Nothing is subtracted from one, so small tails keep their digits.
    """

    y = x / _d(2)
    half = F.floor(df / _d(2)).cast("int")
    even = df % 2 == 0
    # Terms y^a / gamma(a + 1) for a = 0, 1, .. (even) or 1/2, 3/2, .. (odd), each from the one before, times exp(-y).
    first = F.when(even, F.exp(-y)).otherwise(F.exp(-y) * F.sqrt(y) / _d(math.sqrt(math.pi) / 2))
    step = F.when(even, _d(0)).otherwise(_d(0.5))
    total = F.when(half < 1, _d(0)).otherwise(_series(first, lambda n: y / (n + step), F.greatest(half - 1, F.lit(0))))
    root = F.sqrt(F.greatest(x, _d(0)))
    two_sided = _d(2) * F.when(root >= 2.5, _norm_tail(F.greatest(root, _d(2.5)))).otherwise(_d(0.5) - _norm_middle(root))
    upper = F.when(even, total).otherwise(total + two_sided)
    return F.when(x.isNull() | df.isNull(), F.lit(None)).when(x <= 0, _d(1)).otherwise(F.least(_d(1), upper))


def fn_norm_cdf(z: Column) -> Column:
    """Standard normal distribution function; both tails keep their digits on the lower side."""

    tail = _norm_tail(F.greatest(F.abs(z), _d(2.5)))
    return F.when(z <= -2.5, tail).when(z >= 2.5, _d(1) - tail).otherwise(_d(0.5) + _norm_middle(z))


def fn_range_sf(q: Column, k: Column, step: float = 0.25) -> Column:
    """P(studentised range of ``k`` normals > q), infinite degrees of freedom."""

    points = [i * step for i in range(-int(8 / step), int(8 / step) + 1)]
    grid = F.array(
        *[
            F.struct(
                _d(z).alias("z"),
                _d(math.exp(-z * z / 2) / math.sqrt(2 * math.pi)).alias("pdf"),
                _d(0.5 * (1 + math.erf(z / math.sqrt(2)))).alias("cdf"),
            )
            for z in points
        ]
    )
    total = F.aggregate(
        grid,
        _d(0),
        lambda a, g: a
        + g["pdf"] * F.pow(F.greatest(_d(0), g["cdf"] - fn_norm_cdf(g["z"] - q)), k - _d(1)),
    )
    return F.least(_d(1), F.greatest(_d(0), _d(1) - k * _d(step) * total))


def _sum_counts(steps: Column, size: Column) -> Column:
    """Number of subsets of ``steps`` (positive integers) for every total 0..size."""

    start = F.concat(F.array(_d(1)), F.array_repeat(_d(0), size.cast("int")))

    def add(counts, step):
        width = step.cast("int")
        moved = F.concat(
            F.array_repeat(_d(0), width), F.slice(counts, F.lit(1), F.size(counts) - width)
        )
        return F.zip_with(counts, moved, lambda a, b: a + b)

    return F.aggregate(steps, start, add)


def fn_signed_rank_null(n: Column) -> Column:
    """Null counts of the signed-rank sum: element ``w + 1`` is the number of sign patterns with sum ``w``."""

    size = n * (n + 1) / 2
    return _sum_counts(F.sequence(F.lit(1), n.cast("int")), size)


def rank_sum_tail(ranks: Column, positive: Column) -> Column:
    """Exact two-sided p of a signed-rank sum, ties included.

    ``ranks`` are average ranks of the non-zero differences and ``positive`` the sum of those with a plus sign.
    Doubling the ranks makes them integers, so all sign patterns are counted by a sum over subset totals
    instead of being enumerated.
    """

    doubled = F.transform(ranks, lambda r: F.rint(r * 2).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda a, r: a + r)
    counts = _sum_counts(doubled, total)
    gap = F.abs(F.rint(positive * 2) * 2 - total)
    hits = F.aggregate(
        F.transform(counts, lambda c, w: F.when(F.abs(w * 2 - total) >= gap, c).otherwise(_d(0))),
        _d(0),
        lambda a, c: a + c,
    )
    return F.when(F.size(ranks) == 0, _d(1)).otherwise(hits / F.pow(_d(2), F.size(ranks)))
