"""Exact nearest neighbours as a partitioned join.

Neither all pairs nor a whole class ever meets in one place:

1. equal vectors are collapsed first (a group of copies becomes one vector with its ``k + 1`` smallest ids);
2. every group is cut into cells around pivot vectors, and the triangle inequality decides which vectors can be
   neighbours of a cell, so far-away cells are never compared. Distances to pivots are found on chunks of a group and never
   leave their task, as a row's list of them is far longer than the row;
3. both sides of a cell are cut into blocks of bounded size. A task sees one block pair, keeps the best ``k + 1``
   candidates of each row, and a windowed top-k merges the blocks.

Pruning only drops vectors that cannot be neighbours, so the result equals the full comparison, with ties
broken by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt.functions import order_hash
from classtilt.operators.tiles import block_join, placing, reaching

#: Rows of a group that a task holds beside the group's pivots.
CHUNK = 65_536
WITHIN = "cell int, _cells array<struct<cell int, lefts bigint, rights bigint>>"


def distance(x, y, cats=None, other_cats=None, penalty=None) -> Column:
    """Euclidean distance in index order; each categorical mismatch adds ``penalty`` squared."""

    zero = F.lit(0.0)
    square = F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), zero, lambda s, v: s + v)
    if cats is not None:
        differ = F.zip_with(cats, other_cats, lambda a, b: F.when(a.eqNullSafe(b), 0.0).otherwise(1.0))
        square = square + penalty * penalty * F.aggregate(differ, zero, lambda s, v: s + v)
    return F.sqrt(square)


def _attach(df: DataFrame, small: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Adds a per-group value; without groups it is a scalar subquery, so no cartesian plan can arise."""

    return df.join(small, list(groups)) if groups else df.withColumn(column, small.select(column).scalar())


def rs_knn(
    train: DataFrame,
    keys: Sequence[str],
    k: int,
    within_class: bool = False,
    id: str = "id",
    y: str = "y",
    penalty: str | None = None,
    cell_rows: int | None = None,
    block_rows: int | None = None,
    max_pivots: int = 1024,
    ask: DataFrame | None = None,
) -> DataFrame:
    """``DF[keys, (y), id, nb_id, rank, distance]``: the ``k`` nearest other rows of every row.

    Neighbours come from the same ``keys`` group and, with ``within_class``, the same class. ``penalty`` names a
    column with the distance added per mismatch of the categories in ``cats``. ``ask`` (DF[keys, (y), id]) names
    the rows whose neighbours are wanted; every row can still be a neighbour.
    """

    mixed = penalty is not None
    groups = [*keys, *([y] if within_class else [])]
    features = ["x", "cats", penalty] if mixed else ["x"]
    rows = train.select(*groups, F.col(id).alias("id"), *features)

    # 1. distinct vectors; the row_number filter is applied before the shuffle, so copies never pile up.
    copies = Window.partitionBy(*groups, *features).orderBy("id")
    distinct = (
        rows.withColumn("_r", F.row_number().over(copies))
        .filter(F.col("_r") <= k + 1)
        .groupBy(*groups, *features)
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("vid", F.col("ids")[0])
    )
    asking = rows
    if ask is None:
        distinct = distinct.withColumn("_asked", F.lit(True))
    else:
        on = [*groups, "id"]
        asking = rows.join(ask.select(*on[:-1], F.col(id).alias("id")).distinct(), on, "left_semi")
        flagged = asking.select(*groups, *features).distinct().withColumn("_asked", F.lit(True))
        distinct = distinct.join(flagged, [*groups, *features], "left").na.fill(False, ["_asked"])
    named = distinct
    if mixed:
        distinct = distinct.withColumnRenamed(penalty, "penalty")

    # 2. pivots: hash-chosen vectors, about one for every ``cell_rows``, at least one and a bounded number per group.
    chosen = Window.partitionBy(*groups).orderBy("_h", "vid")
    # Distances prune well in few dimensions, so cells are small there; in many they only add copies of rows.
    sizes = (cell_rows, cell_rows) if cell_rows else (1024, 65_536)
    low, high = (f"{min(2**32 // n, 2**32 - 1):08x}" for n in sizes)
    share = F.when(F.size("x") <= 3, low).otherwise(high)
    # The share is taken before any window, so about one row in ``cell_rows`` is ranked; the first row by hash of each group,
    # which always is a pivot, comes from a grouped minimum. ``vid`` tells vectors of a group apart.
    hashed = distinct.withColumn("_h", order_hash("pivot", F.col("vid")))
    lows = hashed.groupBy(*groups).agg(F.min(F.struct("_h", "vid")).alias("_m"), F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("_chunks"))
    least = lows.select(*groups, F.col("_m.vid").alias("vid"))
    pivots = (
        hashed.filter(F.col("_h") < share)
        .unionByName(hashed.join(least, [*groups, "vid"], "left_semi"))
        .dropDuplicates([*groups, "vid"])
        .withColumn("_r", F.row_number().over(chosen))
        .filter(F.col("_r") <= max_pivots)
        .groupBy(*groups)
        .agg(F.collect_list(F.struct("x", *(["cats"] if mixed else []))).alias("_pivots"))
    )
    # Distances to pivots are found by tasks on chunks of a group, with the group's pivots beside each, and stay there.
    many = lows.select(*groups, "_chunks")
    chunk = F.pmod(F.xxhash64("vid", F.lit(23)), F.col("_chunks")).alias("_chunk")
    chunked = _attach(distinct, many, groups, "_chunks").select(*distinct.columns, chunk)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)).alias("_chunk")

    def beside(small: DataFrame, work, columns: DataFrame, more: str) -> DataFrame:
        right = _attach(small, many, groups, "_chunks").select(*small.columns, every).toDF(*small.columns, "_chunk")
        fields = [f"`{n}` {k}" for n, k in columns.dtypes if n != "_chunk"]
        on = [*groups, "_chunk"]
        return columns.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(work, ", ".join([*fields, more]))

    shown = chunked.select(*groups, "_chunk", "vid", "_asked", "x", *(["cats", "penalty"] if mixed else []))
    placed = beside(pivots, placing(mixed), shown, "cell int, _near double, _gaps array<double>")

    # 3. reach of a cell: a vector further than this from the pivot is no neighbour of any row of the cell.
    # The k + 1 salted minima belong to k + 1 different vectors, so the largest bounds the k-th neighbour.
    salt = F.pmod(F.xxhash64("vid"), F.lit(k + 1))
    closest = F.array(*[F.min(F.when(salt == s, F.col("_near"))) for s in range(k + 1)])
    reach = (
        placed.groupBy(*groups, "cell")
        .agg(
            F.max("_near").alias("far"),
            F.count("*").alias("n"),
            F.count_if("_asked").alias("asked"),
            F.max("_gaps").alias("gaps"),
            closest.alias("_closest"),
        )
        .withColumn(
            "reach",
            F.when(
                F.forall("_closest", lambda c: c.isNotNull()),
                (F.col("far") * 2 + F.array_max("_closest")) * (1 + 1e-9) + 1e-12,
            ).otherwise(F.lit(float("inf"))),
        )
        .groupBy(*groups)
        .agg(F.collect_list(F.struct("cell", "reach", "far", "n", "asked", "gaps")).alias("_cells"))
    )

    # 4. block pairs of bounded size. Rows that ask are the rows of the cell; rows that answer are all within reach.
    def offered(c):
        near = F.filter("_cells", lambda o: F.element_at(o["gaps"], c["cell"]) - o["far"] <= c["reach"])
        return F.aggregate(near, F.lit(0).cast("bigint"), lambda a, o: a + o["n"])

    # Where nothing is pruned, a row is sent once for each block of the other side: large groups get larger blocks, small ones
    # enough blocks for many tasks.
    total = F.aggregate("_cells", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    least, most = (F.lit(float(v)) for v in ((block_rows, block_rows) if block_rows else (8192, 65_536)))

    def blocks(n):
        return F.ceil(n / F.least(most, F.greatest(least, total / 8)))

    plan = reach.select(
        *groups,
        F.transform(
            F.filter("_cells", lambda c: c["asked"] > 0),
            lambda c: F.struct(
                c["cell"].alias("cell"),
                c["reach"].alias("reach"),
                blocks(c["asked"]).alias("lefts"),
                F.greatest(F.lit(1).cast("bigint"), blocks(offered(c))).alias("rights"),
            ),
        ).alias("_cells"),
    )
    spread = F.abs(F.xxhash64("vid", F.lit(17)) % 1_000_000_007)
    zero = F.lit(0).cast("bigint")

    def roles(c):
        asked = F.transform(
            F.sequence(zero, c["rights"] - 1),
            lambda b: F.struct(F.lit(True).alias("asks"), c["cell"].alias("cell"), (F.col("_spread") % c["lefts"]).alias("lb"), b.alias("rb")),
        )
        answers = F.transform(
            F.sequence(zero, c["lefts"] - 1),
            lambda b: F.struct(F.lit(False).alias("asks"), c["cell"].alias("cell"), b.alias("lb"), (F.col("_spread") % c["rights"]).alias("rb")),
        )
        empty = F.slice(answers, 1, 0)
        return F.concat(
            F.when((c["cell"] == F.col("cell")) & F.col("_asked"), asked).otherwise(empty),
            answers,
        )

    paired = (
        beside(_attach(pivots, plan, groups, "_cells"), reaching(mixed), chunked, WITHIN)
        .withColumn("_spread", spread)
        .withColumn("_role", F.explode(F.flatten(F.transform("_cells", roles))))
        .select(
            *groups,
            F.col("_role.cell").alias("cell"),
            F.col("_role.lb").alias("_lb"),
            F.col("_role.rb").alias("_rb"),
            F.col("_role.asks").alias("asks"),
            "vid",
            "x",
            *(["cats", "penalty"] if mixed else []),
            F.when(~F.col("_role.asks"), F.col("ids")).otherwise(F.slice("ids", 1, 0)).alias("ids"),
        )
    )
    kind = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {kind[g]}" for g in groups], f"vid {kind['id']}", f"nb_id {kind['id']}", "d2 double"])
    candidates = paired.groupBy(*groups, "cell", "_lb", "_rb").applyInArrow(block_join(groups, k, mixed), schema)

    # 5. merge the blocks, then hand the list of a vector to all its copies.
    order = Window.partitionBy(*groups, "vid").orderBy("d2", "nb_id")
    lists = (
        candidates.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= k + 1)
        .groupBy(*groups, "vid")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "nb_id"))).alias("_list"))
    )
    by_vector = named.select(*groups, *features, "vid").join(lists, [*groups, "vid"]).drop("vid")
    others = F.slice(F.filter("_list", lambda c: c["nb_id"] != F.col("id")), 1, k)
    return (
        asking.join(by_vector, [*groups, *features])
        .select(*groups, "id", F.posexplode(others).alias("rank", "_c"))
        .select(
            *groups,
            F.col("id").alias(id),
            F.col("_c.nb_id").alias("nb_id"),
            (F.col("rank") + 1).alias("rank"),
            F.sqrt("_c.d2").alias("distance"),
        )
    )
