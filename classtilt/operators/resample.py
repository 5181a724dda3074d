"""Resampling of training rows. Every draw is a hash of (seed, purpose, group, class, number).

Samplers grow all classes to the majority count, except random under-sampling (down to the smallest class) and
balanced bootstraps (every class to the smallest). Synthetic rows get the id ``s:<class>:<number>``, so ids are
text after sampling; ``synthetic`` tells the two kinds apart. A neighbour table that several later steps read is
checkpointed, so the distance work runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.functions import explode_counts, fn_hash_uniform, hash_key, number_by_hash, order_hash
from classtilt.operators.knn import rs_knn
from classtilt.session import cut


def class_deficits(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DF[keys, y, n, n_max, n_min, deficit]; only class counts are windowed."""

    every = Window.partitionBy(*keys)
    return (
        train.groupBy(*keys, "y")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_max", F.max("n").over(every))
        .withColumn("n_min", F.min("n").over(every))
        .withColumn("deficit", F.col("n_max") - F.col("n"))
    )


def _originals(train: DataFrame) -> DataFrame:
    return train.withColumn("id", F.col("id").cast("string")).withColumn("synthetic", F.lit(False))


def _numbered(train: DataFrame, keys: Sequence[str], seed: int, purpose: str, name: str = "_number") -> DataFrame:
    hashed = train.withColumn("_h", order_hash(seed, purpose, F.col("id")))
    return number_by_hash(hashed, [*keys, "y"], "_h", "id", name).drop("_h")


def _key(keys: Sequence[str], seed: int, purpose: str) -> list:
    return [seed, purpose, *[F.col(k) for k in keys], F.col("y"), F.col("j")]


def _new_id(*parts) -> Column:
    return F.concat_ws(":", F.lit("s"), *[p.cast("string") for p in parts])


def rs_noop(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DF[keys, balanced]: groups whose classes are already equal, which every sampler leaves unchanged."""

    return (
        class_deficits(train, keys)
        .groupBy(*keys)
        .agg(((F.max("n") == F.min("n")) & (F.count(F.lit(1)) > 1)).alias("balanced"))
    )


def rs_neighbours(train: DataFrame, keys: Sequence[str], condition: str) -> DataFrame:
    """DF[keys, k, m, support, problem]: neighbour numbers that the smallest targeted class allows."""

    counts = class_deficits(train, keys)
    facts = counts.groupBy(*keys).agg(
        F.min(F.when(F.col("deficit") > 0, F.col("n"))).alias("support"),
        F.count(F.lit(1)).alias("_classes"),
        F.sum("n").alias("_rows"),
    )
    k = F.least(F.lit(5), F.col("support") - 1)
    m = F.lit(None).cast("bigint")
    if condition == "borderline_smote":
        m = F.least(F.lit(10), F.greatest(k + 1, F.col("_classes") + 1), F.col("_rows") - 1)
    problem = (
        F.when(F.col("support").isNull(), "no non-majority class is available for synthesis")
        .when(F.col("support") < 2, "fewer than two training examples in the smallest targeted class")
        .when(m < 2, "insufficient fold rows for borderline m-neighbours")
    )
    ok = problem.isNull()
    return facts.select(
        *keys,
        F.when(ok, k).cast("bigint").alias("k"),
        F.when(ok, m).cast("bigint").alias("m"),
        "support",
        problem.alias("problem"),
    )


def rs_gate(cells: DataFrame, unsupported: DataFrame):
    """(runnable cells, failure rows) for cells DF[.., feature_type, classifier, condition]."""

    marked = cells.join(unsupported, ["feature_type", "condition"], "left").withColumn(
        "error",
        F.when(
            (F.col("condition") == "balanced_random_forest") & (F.col("classifier") != "random_forest"),
            rules.FOREST_ONLY_MESSAGE,
        ).otherwise(F.col("unsupported_message")),
    )
    runnable = marked.filter(F.col("error").isNull()).select(*cells.columns)
    failed = (
        marked.filter(F.col("error").isNotNull())
        .select(*cells.columns, "error")
        .withColumn("stage", F.lit("applicability"))
        .withColumn("error_type", F.lit("ValueError"))
    )
    return runnable, failed


def rs_random_over(train: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Random rows of each smaller class are repeated until it has the majority count."""

    want = class_deficits(train, keys).select(*keys, "y", "n", "deficit")
    draws = explode_counts(want, "deficit", "j").withColumn(
        "_number", hash_key(*_key(keys, seed, "over")) % F.col("n") + 1
    )
    drawn = (
        draws.select(*keys, "y", "j", "_number")
        .join(_numbered(train, keys, seed, "over"), [*keys, "y", "_number"])
        .withColumn("id", _new_id(F.col("y"), F.col("j")))
        .withColumn("synthetic", F.lit(True))
    )
    base = _originals(train)
    return base.unionByName(drawn.select(*base.columns))


def rs_random_under(train: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """``n_min`` rows of every class, without replacement, in hash order."""

    sizes = class_deficits(train, keys).select(*keys, "y", "n_min")
    kept = _numbered(train, keys, seed, "under").join(sizes, [*keys, "y"]).filter(F.col("_number") <= F.col("n_min"))
    return _originals(kept.drop("_number", "n_min"))


def rs_under_cuts(folds: DataFrame, parts: Sequence[int], seed: int) -> dict[int, dict]:
    """Per training part, the place in hash order of the last row of each class that ``rs_random_under`` keeps.

    A part is all folds but one and has that fold's name. One plan numbers ids and classes of all ``parts``; a record per part and
    class reaches the driver.
    """

    part = F.explode(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: p != F.col("fold")))
    kept = rs_random_under(folds.select("id", "y", F.col("id").alias("_id"), part.alias("_part")), ["_part"], seed)
    place = F.max(F.struct(order_hash(seed, "under", F.col("_id")).alias("h"), F.col("_id").alias("id")))
    cuts: dict[int, dict] = {p: {} for p in parts}
    for r in kept.groupBy("_part", "y").agg(place.alias("last")).collect():
        cuts[r["_part"]][r["y"]] = tuple(r["last"])
    return cuts


def rs_under_by_cuts(train: DataFrame, cuts: dict, seed: int) -> DataFrame:
    """The rows that ``rs_random_under`` keeps, by the part's places of ``rs_under_cuts``: a filter."""

    types = dict(train.dtypes)
    last = F.create_map(*[
        c for y, (h, id) in cuts.items() for c in (F.lit(y).cast(types["y"]), F.struct(F.lit(h).alias("h"), F.lit(id).cast(types["id"]).alias("id")))
    ])
    place = F.struct(order_hash(seed, "under", F.col("id")).alias("h"), F.col("id").alias("id"))
    return _originals(train.filter(place <= F.try_element_at(last, F.col("y"))))


def _interpolate(draws: DataFrame, train: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Synthetic rows from DF[keys, y, j, base, rank, gap]: ``x + gap * (neighbour - x)``."""

    group = [*keys, "y"]
    ends = train.select(*group, F.col("id").alias("nb_id"), F.col("x").alias("_to"))
    starts = train.select(*group, F.col("id").alias("base"), "x")
    located = (
        draws.join(
            pairs.select(*group, F.col("id").alias("base"), "rank", "nb_id"), [*group, "base", "rank"]
        )
        .join(starts, [*group, "base"])
        .join(ends, [*group, "nb_id"])
    )
    moved = F.zip_with("x", "_to", lambda a, b: a + F.col("gap") * (b - a))
    return located.withColumn("x", moved).drop("_to")


def _reach(k: int):
    """Neighbours that a row of a class of ``n_class`` rows can have, ``k`` at most; a class of one row is an error."""

    alone = F.raise_error(F.lit("fewer than two training examples in the smallest targeted class")).cast("bigint")
    return F.when(F.col("n_class") < 2, alone).otherwise(F.least(F.lit(k), F.col("n_class") - 1))


def _draw(base: DataFrame, wanted: DataFrame, keys: Sequence[str], k: int, seed: int, purpose: str) -> DataFrame:
    """``deficit`` draws per class from the numbered rows ``base``: DF[keys, y, j, base, rank, gap].

    ``wanted`` has the class size ``n_class``: a class of at most ``k`` rows has fewer neighbours to choose from.
    """

    draws = (
        explode_counts(wanted, "deficit", "j")
        .withColumn("_number", hash_key(*_key(keys, seed, f"{purpose}-base")) % F.col("n") + 1)
        .withColumn("rank", (hash_key(*_key(keys, seed, f"{purpose}-neighbour")) % _reach(k) + 1).cast("int"))
        .withColumn("gap", fn_hash_uniform(*_key(keys, seed, f"{purpose}-gap")))
    )
    named = base.select(*keys, "y", "_number", F.col("id").alias("base"))
    return draws.join(named, [*keys, "y", "_number"]).select(*keys, "y", "j", "base", "rank", "gap")


def _append(train: DataFrame, made: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = _originals(train)
    made = made.withColumn("id", _new_id(F.col("y"), F.col("j"))).withColumn("synthetic", F.lit(True))
    columns = [*keys, "id", "y", "x", *(["cats"] if "cats" in made.columns else []), "synthetic"]
    return base.select(*columns).unionByName(made.select(*columns))


def rs_smote(train: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """SMOTE: a random row of the class moves a random part of the way to one of its ``k`` class neighbours."""

    wanted = class_deficits(train, keys).select(*keys, "y", "n", F.col("n").alias("n_class"), "deficit")
    draws = _draw(_numbered(train, keys, seed, "smote"), wanted, keys, k, seed, "smote")
    return _append(train, _interpolate(draws, train, _class_pairs(train, keys, k, draws), keys), keys)


def _growing(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the classes that a sampler enlarges; the majority class never needs neighbours of its own."""

    wanted = class_deficits(train, keys).filter("deficit > 0").select(*keys, "y")
    return train.join(wanted, [*keys, "y"], "left_semi")


def _class_pairs(train: DataFrame, keys: Sequence[str], k: int, bases: DataFrame, **how) -> DataFrame:
    """In-class neighbours of the drawn ``bases`` only: DF[keys, y, id, nb_id, rank, distance]."""

    ask = bases.select(*keys, "y", F.col("base").alias("id"))
    return rs_knn(_growing(train, keys), keys, k, True, ask=ask, **how)


def other_class_neighbours(train: DataFrame, keys: Sequence[str], k: int, ask: DataFrame | None = None) -> DataFrame:
    """DF[keys, id, y, others]: rows of another class among the ``k`` nearest rows of any class."""

    labels = train.select(*keys, F.col("id").alias("nb_id"), F.col("y").alias("_ny"))
    own = train.select(*keys, "id", "y")
    return (
        rs_knn(train, keys, k, False, ask=ask)
        .join(labels, [*keys, "nb_id"])
        .join(own, [*keys, "id"])
        .groupBy(*keys, "id", "y")
        .agg(F.count_if(F.col("_ny") != F.col("y")).alias("others"))
    )


def adasyn_allocation(train: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """DF[keys, y, id, share, rows, total, planned] for every row of a growing class."""

    wanted = class_deficits(train, keys).filter("deficit > 0").select(*keys, "y", "deficit")
    near = other_class_neighbours(train, keys, k, _growing(train, keys).select(*keys, "id")).join(wanted, [*keys, "y"])
    near = near.withColumn("share", F.col("others") / F.lit(float(k)))
    totals = near.groupBy(*keys, "y").agg((F.sum("others") / F.lit(float(k))).alias("total"))
    rows = F.rint(F.col("share") / F.col("total") * F.col("deficit")).cast("bigint")
    planned = near.join(totals, [*keys, "y"]).withColumn("rows", F.when(F.col("total") > 0, rows).otherwise(0))
    sums = planned.groupBy(*keys, "y").agg(F.sum("rows").alias("planned"))
    return planned.join(sums, [*keys, "y"]).select(*keys, "y", "id", "share", "rows", "total", "planned")


def rs_adasyn(train: DataFrame, keys: Sequence[str], k: int, seed: int):
    """(Train, failures): rows close to other classes produce more synthetic rows.

    A class without any other-class neighbour, or whose shares all round to zero, is a failure row.
    """

    plan = cut(adasyn_allocation(train, keys, k))
    failures = (
        plan.select(*keys, "y", "total", "planned")
        .distinct()
        .filter("total = 0 or planned = 0")
        .select(
            *keys,
            "y",
            F.when(F.col("total") == 0, f"{rules.NO_BORDER_MESSAGE}. Use SMOTE instead.")
            .otherwise(rules.NO_SAMPLES_MESSAGE)
            .alias("error"),
            F.when(F.col("total") == 0, "RuntimeError").otherwise("ValueError").alias("error_type"),
        )
    )
    sizes = class_deficits(train, keys).select(*keys, "y", F.col("n").alias("n_class"))
    each = plan.select(*keys, "y", F.col("id").alias("base"), "rows").join(sizes, [*keys, "y"])
    named = [seed, "adasyn", *[F.col(c) for c in keys], F.col("y"), F.col("base"), F.col("j")]
    draws = (
        explode_counts(each, "rows", "j")
        .withColumn("rank", (hash_key(*named, "neighbour") % _reach(k) + 1).cast("int"))
        .withColumn("gap", fn_hash_uniform(*named, "gap"))
    )
    made = _interpolate(draws, train, _class_pairs(train, keys, k, draws), keys)
    made = made.withColumn("j", F.concat_ws(":", F.col("base").cast("string"), F.col("j").cast("string")))
    return _append(train, made, keys), failures


def danger_rows(train: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """Rows with at least half but not all of their ``m`` neighbours in other classes."""

    near = other_class_neighbours(train, keys, m, _growing(train, keys).select(*keys, "id"))
    return near.filter((F.col("others") >= F.lit(m / 2.0)) & (F.col("others") < m)).select(*keys, "id", "y")


def rs_borderline(train: DataFrame, keys: Sequence[str], k: int, m: int, seed: int) -> DataFrame:
    """Borderline SMOTE, kind 1: only danger rows start a synthetic row; a class without any stays as it is."""

    danger = cut(danger_rows(train, keys, m))
    sizes = danger.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    wanted = class_deficits(train, keys).select(*keys, "y", F.col("n").alias("n_class"), "deficit").join(sizes, [*keys, "y"])
    draws = _draw(_numbered(danger, keys, seed, "borderline"), wanted, keys, k, seed, "borderline")
    return _append(train, _interpolate(draws, train, _class_pairs(train, keys, k, draws), keys), keys)


def class_penalty(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``penalty``: median over numeric features of their standard deviation inside the class."""

    parts = (
        train.select(*keys, "y", F.posexplode("x").alias("_i", "_v"))
        .groupBy(*keys, "y", "_i")
        .agg(F.stddev_pop("_v").alias("_s"))
        .groupBy(*keys, "y")
        .agg(F.percentile("_s", 0.5).alias("penalty"))
    )
    return train.join(parts, [*keys, "y"])


def rs_smotenc(train: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """SMOTE for mixed rows: categories are voted by the ``k`` neighbours, ties to the smallest value."""

    group = [*keys, "y"]
    wanted = class_deficits(train, keys).select(*group, "n", F.col("n").alias("n_class"), "deficit")
    draws = _draw(_numbered(train, keys, seed, "smotenc"), wanted, keys, k, seed, "smotenc")
    pairs = cut(_class_pairs(class_penalty(train, keys), keys, k, draws, penalty="penalty"))
    numeric = _interpolate(draws, train, pairs, keys)
    first = Window.partitionBy(*group, "base", "_i").orderBy(F.desc("_n"), F.asc("_v"))
    votes = (
        pairs.withColumnRenamed("id", "base")
        .join(train.select(*group, F.col("id").alias("nb_id"), "cats"), [*group, "nb_id"])
        .select(*group, "base", F.posexplode("cats").alias("_i", "_v"))
        .groupBy(*group, "base", "_i", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_r", F.row_number().over(first))
        .filter("_r = 1")
        .groupBy(*group, "base")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("cats"))
    )
    return _append(train, numeric.join(votes, [*group, "base"]), keys)


def rs_enn(train: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Rows whose ``k`` nearest rows all have their class."""

    mixed = other_class_neighbours(train, keys, k).filter("others > 0")
    return train.join(mixed, [*keys, "id"], "left_anti")


def tomek_rows(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of rows that are each other's nearest row while their classes differ."""

    labels = train.select(*keys, F.col("id").alias("nb_id"), F.col("y").alias("_ny"))
    near = rs_knn(train, keys, 1, False).select(*keys, "id", "nb_id")
    # A mutual pair shows up twice under its ordered ends, so one grouping replaces a self-join.
    ends = [F.least("id", "nb_id").alias("a"), F.greatest("id", "nb_id").alias("b")]
    mutual = near.groupBy(*keys, *ends).agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    one, other = (F.struct(F.col(p).alias("id"), F.col(q).alias("nb_id")) for p, q in (("a", "b"), ("b", "a")))
    both = mutual.select(*keys, F.explode(F.array(one, other)).alias("_e"))
    return (
        both.select(*keys, "_e.id", "_e.nb_id")
        .join(train.select(*keys, "id", "y"), [*keys, "id"])
        .join(labels, [*keys, "nb_id"])
        .filter(F.col("y") != F.col("_ny"))
        .select(*keys, "id", "nb_id")
    )


def rs_tomek(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    return train.join(tomek_rows(train, keys), [*keys, "id"], "left_anti")


def _grown(train: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    return cut((rs_smotenc if "cats" in train.columns else rs_smote)(train, keys, k, seed))


def category_codes(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Appends the sorted-order codes of the categories to ``x``; ``cats`` stays as it is."""

    seen = train.select(*keys, F.posexplode("cats").alias("_i", "_v")).distinct()
    order = Window.partitionBy(*keys, "_i").orderBy("_v")
    codes = seen.withColumn("_c", F.row_number().over(order) - 1.0)
    coded = (
        train.select(*keys, "id", F.posexplode("cats").alias("_i", "_v"))
        .join(codes, [*keys, "_i", "_v"])
        .groupBy(*keys, "id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda c: c["_c"]).alias("_codes"))
    )
    joined = train.join(coded, [*keys, "id"])
    return joined.withColumn("_x", F.col("x")).withColumn("x", F.concat("x", "_codes")).drop("_codes")


def _cleaned(train: DataFrame, keys: Sequence[str], clean) -> DataFrame:
    """Cleaning of mixed rows measures distance on category codes, an artificial order kept on purpose."""

    if "cats" not in train.columns:
        return clean(train)
    return clean(category_codes(train, keys)).withColumn("x", F.col("_x")).drop("_x")


def rs_smoteenn(train: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    return _cleaned(_grown(train, keys, k, seed), keys, lambda t: rs_enn(t, keys))


def rs_smotetomek(train: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    return _cleaned(_grown(train, keys, k, seed), keys, lambda t: rs_tomek(t, keys))


def rs_balanced_bootstrap(train: DataFrame, keys: Sequence[str], bags: int, seed: int) -> DataFrame:
    """Per bag: ``n_min`` rows of every class, drawn with replacement."""

    sizes = class_deficits(train, keys).select(*keys, "y", "n", "n_min")
    every = sizes.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    named = [seed, "bag", *[F.col(c) for c in keys], F.col("bag"), F.col("y"), F.col("j")]
    draws = explode_counts(every, "n_min", "j").withColumn("_number", hash_key(*named) % F.col("n") + 1)
    return (
        draws.select(*keys, "y", "bag", "j", "_number")
        .join(_numbered(train, keys, seed, "bag"), [*keys, "y", "_number"])
        .drop("_number")
    )


def rs_row_accounting(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DF[keys, y, before, after]: rows per class on both sides of sampling."""

    count = F.count(F.lit(1))
    return (
        before.groupBy(*keys, "y")
        .agg(count.alias("before"))
        .join(after.groupBy(*keys, "y").agg(count.alias("after")), [*keys, "y"], "full")
        .na.fill(0, ["before", "after"])
    )
