"""Quality by weak supervision: rules vote or abstain, expectation maximisation estimates how far each can be trusted.

Everything is computed with DataFrame functions. The only thing that reaches the driver is the count of each vote
pattern: at most 3 ** len(RULES) numbers, whatever the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt.llm.common import SPACES, whole, words_of
from classtilt.session import cut

WINDOW = 5
SYMBOL = r"[#*$%&|<>]"
#: Rules in the order of their votes. A vote is 1 (good), -1 (bad) or 0 (abstains).
RULES = ("length", "repetition", "symbols", "marks", "lines", "word_size", "variety")


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more. ``windows`` holds one hash per start, in order."""

    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def starts(rows: Column) -> Column:
        own = F.transform(
            rows,
            lambda r, i: F.when(
                (F.get(rows, i - 1)["h"] == r["h"]) | (F.get(rows, i + 1)["h"] == r["h"]), r["p"]
            ),
        )
        return F.sort_array(F.filter(own, lambda p: p.isNotNull()))

    # A lambda over a one-element array binds its argument once.
    ordered = F.get(F.transform(F.array(tagged), starts), F.lit(0))
    spans = F.get(
        F.transform(
            F.array(ordered),
            lambda ps: F.transform(
                ps, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, i + 1) - p, F.lit(WINDOW)))
            ),
        ),
        F.lit(0),
    )
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)


def _features(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    t = whole(F.col(text_col))
    rows = docs.select(*keep, t.alias("_t"), words_of(t).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    names = [c for c in rows.columns if c not in ("_t", "_w")]
    rows = rows.select(
        *names,
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_t"), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(F.col("_t"), F.lit(SYMBOL + r"(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_symbol_ends"),
        lines.alias("_lines"),
        F.transform("_w", lambda word: F.xxhash64(word)).alias("_hw"),
    )
    hw, n = F.col("_hw"), F.size("_hw")
    windows = F.transform(
        F.slice(hw, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(hw, i + k) for k in range(1, WINDOW)]),
    )
    rows = rows.select(
        *names,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_symbol_ends",
        "_lines",
        F.size(F.array_distinct(hw)).cast("long").alias("n_distinct_words"),
        windows.alias("_h"),
    )
    repeated = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"))).otherwise(F.lit(0))
    return rows.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_symbol_ends",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_distinct_words",
        repeated.cast("long").alias("n_repeat_words"),
        # A filter on what follows must not be pushed below: it would take the expressions above with it, into each other's
        # lambdas, where they would run once per word. Spark pushes nothing through a row number.
        F.monotonically_increasing_id().alias("_tick"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def _votes() -> dict[str, Column]:
    n, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    lines, copies = F.col("n_lines"), F.col("n_dup_lines")
    repeated, distinct = F.col("n_repeat_words"), F.col("n_distinct_words")
    return {
        "length": _vote(n < 10, n >= 20),
        "repetition": _vote(repeated * 100 > n * 20, repeated * 100 <= n * 10),
        "symbols": _vote(symbols * 100 > chars * 8, symbols * 100 <= chars * 3),
        "marks": _vote(F.col("n_symbol_ends") * 100 > n * 15, F.col("n_symbol_ends") * 100 <= n * 5),
        "lines": _vote(copies * 100 > lines * 30, (lines > 1) & (copies * 100 <= lines * 10)),
        "word_size": _vote((chars < n * 2) | (chars > n * 15), (chars >= n * 3) & (chars <= n * 12)),
        "variety": _vote((n >= 50) & (distinct * 100 < n * 10), (n < 50) | (distinct * 100 >= n * 20)),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Expectation maximisation on counted vote patterns.

    Returns the share of good texts and per rule (P(bad vote | bad text), P(bad vote | good text)), both among the texts
    on which the rule votes. It starts from careful rules (a bad vote is rare on good texts, a good vote proves little)
    and holds to them with two pseudo-votes, so no probability becomes 0 or 1 and the two classes cannot change places.
    """

    k = len(RULES)
    good, rates = 0.9, [(0.3, 0.002)] * k
    for _ in range(rounds):
        total = total_good = 0.0
        seen = [[0.0, 0.0] for _ in range(k)]
        bad = [[0.0, 0.0] for _ in range(k)]
        for votes, count in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, _log_odds(votes, good, rates)))))
            total += count
            total_good += count * p
            for j, vote in enumerate(votes):
                if vote:
                    for c, weight in ((0, count * (1 - p)), (1, count * p)):
                        seen[j][c] += weight
                        bad[j][c] += weight * (vote < 0)
        good = (total_good + 1.8) / (total + 2)
        rates = [
            (
                max((bad[j][0] + 0.6) / (seen[j][0] + 2), 2 * (slip := (bad[j][1] + 0.004) / (seen[j][1] + 2))),
                slip,
            )
            for j in range(k)
        ]
        rates = [(min(a, 0.999), min(b, 0.49)) for a, b in rates]
    return good, rates


def _log_odds(votes: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    out = math.log(good / (1 - good))
    for vote, (hit, slip) in zip(votes, rates, strict=True):
        if vote < 0:
            out += math.log(slip / hit)
        elif vote > 0:
            out += math.log((1 - slip) / (1 - hit))
    return out


def _judged(features: DataFrame, counted: DataFrame, rounds: int) -> DataFrame:
    """``features`` with votes, posterior, base_failed and kept. ``counted`` has the features that the fit counts."""

    votes = _votes()
    names = [f"vote_{r}" for r in RULES]
    found = counted.select(*[votes[r].alias(f"vote_{r}") for r in RULES]).groupBy(*names).count().collect()
    patterns = sorted((tuple(row[n] for n in names), row["count"]) for row in found)
    good, rates = fit_rules(patterns, rounds)
    odds = F.lit(math.log(good / (1 - good)))
    for r, (hit, slip) in zip(RULES, rates, strict=True):
        odds = odds + F.when(F.col(f"vote_{r}") < 0, math.log(slip / hit)).when(
            F.col(f"vote_{r}") > 0, math.log((1 - slip) / (1 - hit))
        ).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (
        features.withColumns({f"vote_{r}": votes[r] for r in RULES})
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, posterior and the votes.

    A null text has no words. Texts of under ten words, or with over a fifth of their words in five-word windows that
    occur twice, fail whatever the posterior. Repeated rows and equal ids are judged one by one; an empty table gives an
    empty result. Other columns are ignored. Windows are compared by 64-bit hashes inside one text.
    """

    features = cut(_features(docs, text_col, [F.col(id_col).alias("doc_id")]))
    return _judged(features, features, rounds).drop("_tick")


def filter_quality(docs: DataFrame, text_col: str = "text", rounds: int = 50) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, unchanged. Two scans and no shuffle of texts."""

    counted = _features(docs, text_col, [])
    packed = _features(docs, text_col, [F.struct(*docs.columns).alias("_row")])
    return _judged(packed, counted, rounds).filter("kept and _tick >= 0").select("_row.*")
