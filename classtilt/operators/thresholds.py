"""Class thresholds: predict ``argmax(p_c / exp(o_c))`` and choose the offsets on out-of-fold rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators.metrics import met_argmax
from classtilt.session import cut


def thr_apply(pred: DataFrame, offsets, name: str = "yhat") -> DataFrame:
    """Adds the class with the largest ``p_c / exp(o_c)``, the lowest class on ties."""

    offsets = F.col(offsets) if isinstance(offsets, str) else offsets
    shifted = F.zip_with("p", offsets, lambda p, o: p / F.exp(o))
    return pred.withColumn("_s", shifted).withColumn(name, met_argmax("_s")).drop("_s")


def _codes(p: np.ndarray, y: np.ndarray, o: np.ndarray, c: int, d: int, step: float, side: int) -> np.ndarray:
    """What a prediction can still depend on when only classes c < d move: five small integers per row.

    At how many levels c, and d, beat the best of the other classes; at how many level differences d beats c; the true class;
    the best of the others. Of two classes the higher wins only if strictly larger, as in ``argmax``.
    """

    levels = np.exp(step * np.arange(-side, side + 1))
    gaps = np.exp(step * np.arange(-2 * side, 2 * side + 1))
    others = p / np.exp(step * o)
    others[:, [c, d]] = -1.0
    best = others.argmax(axis=1)
    rest = others.max(axis=1)[:, None]

    def wins(j: int) -> np.ndarray:
        own = p[:, [j]] / levels
        return ((own > rest) | ((own == rest) & (j < best)[:, None])).sum(axis=1)

    won_c, won_d = wins(c), wins(d)
    over = (p[:, [d]] > p[:, [c]] * gaps).sum(axis=1)
    # What no place of the two classes can tell apart gets one code, so far fewer codes are shuffled.
    over = np.where((won_c == 0) | (won_d == 0), 0, np.clip(over, len(levels) - won_c, won_d + 2 * side))
    best = np.where((won_c == len(levels)) | (won_d == len(levels)), 0, best)
    return np.stack([won_c, won_d, over, y, best], axis=1)


def _best_of(codes: np.ndarray, n: np.ndarray, o: np.ndarray, c: int, d: int, side: int) -> tuple[float, int, list[int]]:
    """(-score, pull, vector) of the best place for classes c and d, the others staying."""

    classes = len(o)
    won_c, won_d, over, y, rest = codes.T
    truth = np.bincount(y, n, classes)
    best = None
    for a in range(2 * side + 1) if c else [side]:  # class 0 stays at 0
        c_in = a < won_c
        for b in range(2 * side + 1):
            d_in = (b < won_d) & (~c_in | (b - a + 2 * side < over))
            guess = np.where(d_in, d, np.where(c_in, c, rest))
            hit = np.bincount(y[guess == y], n[guess == y], classes)
            both = truth + np.bincount(guess, n, classes)
            score = float(np.divide(2 * hit, both, out=np.zeros(classes), where=both > 0).mean())
            vector = [int(x) for x in o]
            vector[c], vector[d] = a - side, b - side
            found = (-round(score, 12), sum(k * x for k, x in enumerate(vector)), vector)
            best = found if best is None or found < best else best
    return best


def thr_fit(pred: DataFrame, keys: Sequence[str], classes: int, step: float = 0.25) -> DataFrame:
    """``DF[keys, offsets, score, status, reason]``: offsets in [-2, 2] on an even grid of ``step``, class 0 fixed at 0.

    The same rule for every number of classes: from several starts (all zero; the logarithms of class counts relative to class
    0, which levels the classes; one class at 1 or -1 and the others zero) the best joint move of any two classes over
    their whole grid is made, until no move is better. Better is a larger macro-F1, then a smaller sum of class number
    times offset, then the smaller vector. With up to three classes the first move sees the whole grid; with more, the
    result is the best of the starts' local optima, which need not be the grid's best. A round is one pass over the rows of the keys that
    still move: tasks count each row's few integers for every pair of classes, and only counts are shuffled. The work
    of a round is rows times pairs, and moves are counted in hundreds for a pair. Rows whose label is no class are left out.
    Rounds are checkpointed, so this builds eagerly.
    """

    keys = list(keys)
    side = round(2.0 / step)
    names = [f"k{i}" for i in range(max(1, len(keys)))]  # without keys all rows share a constant
    rows = pred.select(*[(F.col(k) if k else F.lit(0)).alias(n) for k, n in zip(keys or [None], names, strict=True)], F.col("y").cast("int").alias("y"), F.col("p").cast("array<double>").alias("p"))
    rows = cut(rows.filter(F.col("y").between(0, classes - 1)))
    kinds = dict(rows.dtypes)
    head = "".join(f"{n} {kinds[n]}, " for n in names)
    seen = [F.count(F.when(F.col("y") == c, 1)) for c in range(classes)]
    counts = rows.groupBy(*names).agg(F.array(*seen).alias("counts"))
    level = F.transform("counts", lambda n: F.rint(F.ln(F.greatest(n, F.lit(1)) / F.greatest(F.col("counts")[0], F.lit(1))) / step))
    level = F.transform(level, lambda v: F.greatest(F.lit(-side), F.least(F.lit(side), v.cast("int"))))
    half = round(1.0 / step)
    single = [F.array(*[F.lit(way * half if k == c else 0) for k in range(classes)]) for c in range(1, classes) for way in (-1, 1)]
    # Up to three classes the first move sees the whole grid from any start, so one start is enough.
    zero = F.array_repeat(F.lit(0), classes)
    starts = F.array(zero, level, *single) if classes > 3 else F.array(zero)
    state = counts.select(*names, F.forall("counts", lambda n: n > 0).alias("whole"), F.posexplode(starts).alias("start", "o"))
    # Without -score known, every first move is better.
    state = cut(state.withColumn("score", F.lit(-1.0)).withColumn("moving", F.col("whole")))
    pairs = [(c, d) for d in range(1, classes) for c in range(d) if c or classes == 2]
    code = ["won_c", "won_d", "over", "truth", "rest"]
    counted = f"{head}start int, pair int, {', '.join(f'{c} int' for c in code)}, n long"
    found = f"{head}start int, score double, pull long, o array<int>"

    def count(batches):
        for frame in batches:
            p, o, y = np.stack(frame["p"].to_numpy()), np.stack(frame["o"].to_numpy()), frame["y"].to_numpy()
            for i, (c, d) in enumerate(pairs):
                part = frame[[*names, "start"]].copy()
                part["pair"] = i
                part[code] = _codes(p, y, o, c, d, step, side)
                yield part.groupby([*names, "start", "pair", *code], as_index=False, dropna=False).size().rename(columns={"size": "n"})

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        c, d = pairs[frame["pair"].iloc[0]]
        best = _best_of(frame[code].to_numpy(), frame["n"].to_numpy(), np.array(frame["o"].iloc[0]), c, d, side)
        out = {n: [frame[n].iloc[0]] for n in [*names, "start"]}
        return pd.DataFrame(out | {"score": [-best[0]], "pull": [best[1]], "o": [best[2]]})

    def by(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """A join in which null keys match."""
        same = F.lit(True)
        for n in on:
            same = same & F.col(n).eqNullSafe(F.col(f"r_{n}"))
        return a.join(b.withColumnsRenamed({n: f"r_{n}" for n in on}), same, how).drop(*[f"r_{n}" for n in on])

    while pairs and not (moving := state.filter("moving")).isEmpty():
        if classes > 3:
            near = by(rows, moving.select(*names, "start", "o"), names)
        else:  # one start for all keys: the rows need no join
            near = rows.withColumn("start", F.lit(0)).withColumn("o", zero)
        near = near.mapInPandas(count, counted)
        near = near.groupBy(*names, "start", "pair", *code).agg(F.sum("n").alias("n"))
        near = by(near, moving.select(*names, "start", "o"), [*names, "start"])
        moves = near.groupBy(*names, "start", "pair").applyInPandas(move, found)
        order = F.struct((-F.col("score")).alias("s"), "pull", "o")
        best = moves.groupBy(*names, "start").agg(F.min(order).alias("m"))
        after = by(state, best, [*names, "start"], "left")
        pull = F.aggregate(F.transform("o", lambda v, i: v * i), F.lit(0).cast("long"), lambda t, v: t + v)
        better = F.col("m").isNotNull() & (F.col("m") < F.struct((-F.col("score")).alias("s"), pull.alias("pull"), "o"))
        after = after.select(
            *names, "whole", "start",
            F.when(better, F.col("m.o")).otherwise(F.col("o")).alias("o"),
            F.when(better, -F.col("m.s")).otherwise(F.col("score")).alias("score"),
            (better & F.lit(classes > 3)).alias("moving"),
        )
        # Starts that have met go on as one; a vector that one of them could not leave is settled.
        met = after.groupBy(*names, "whole", "o", "score").agg(F.min("start").alias("start"), F.min("moving").alias("moving"))
        state = cut(met)
    pull = F.aggregate(F.transform("o", lambda v, i: v * i), F.lit(0).cast("long"), lambda t, v: t + v)
    last = state.groupBy(*names, "whole").agg(F.min(F.struct((-F.col("score")).alias("s"), pull.alias("pull"), "o")).alias("m"))
    whole = F.col("whole")
    offsets = F.transform("m.o", lambda v: v.cast("double") * step)
    score = -F.col("m.s") if pairs else F.lit(1.0)
    return last.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=False)],
        F.when(whole, offsets).otherwise(F.array_repeat(F.lit(0.0), classes)).alias("offsets"),
        F.when(whole, score).alias("score"),
        F.when(whole, rules.VALID).otherwise(rules.FAILED).alias("status"),
        F.when(
            ~whole, "threshold fallback: ValueError: validation labels do not provide every class"
        ).alias("reason"),
    )
