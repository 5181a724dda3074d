"""Approximate nearest neighbours on balanced posting lists.

A bounded sample is cut in halves again and again; the means of the last parts are the centroids, and every vector goes to the
posting list of its nearest centroid. Vectors at a boundary go to the next lists too. Centroids are searched through a graph in a
worker's memory. A query asks the lists whose centroids are not farther than ``reach`` times the nearest one; lists and their queries
meet in tiles of bounded size, where distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt.session import cut

SEED = 42
#: A tile holds about so many vectors and queries.
TILE, ASKING = 4096, 1024


def balanced_parts(rows: np.ndarray, parts: int, rounds: int = 8) -> list[np.ndarray]:
    """Positions of ``rows`` in ``parts`` (a power of two) clusters whose sizes differ by one at most: two means, cut at the middle."""

    def halves(own: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1 or len(own) < 2:
            return [own]
        points = rows[own]
        means = points[draw.choice(len(own), 2, replace=False)]
        middle = len(own) // 2
        for _ in range(rounds):
            order = np.argsort(points @ (means[1] - means[0]), kind="stable")
            means = np.stack([points[order[:middle]].mean(axis=0), points[order[middle:]].mean(axis=0)])
        return halves(own[order[:middle]], parts // 2) + halves(own[order[middle:]], parts // 2)

    draw = np.random.default_rng(SEED)
    return halves(np.arange(len(rows)), parts)


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean, all against all; with an error of about 1e-7 of the lengths, for choosing only."""

    squares = (rows**2).sum(axis=1)[:, None] + (others**2).sum(axis=1) - 2 * rows @ others.T
    return np.sqrt(np.maximum(squares, 0))


class CentroidGraph:
    """Centroids, each linked to near ones; a near one is left out if a linked one is nearer to it. A ring joins all."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.centroids = centroids.astype(np.float64)
        n = len(centroids)
        ring = np.arange(n)
        links = [ring[:, None] + step for step in (-1, 1)]
        around = np.concatenate(links, axis=1) % n
        near = np.zeros((n, 0), np.int64)
        if n > 3:
            wide = min(n - 1, 3 * degree)
            found = []
            for low in range(0, n, 512):
                gaps = distances(self.centroids[low : low + 512], self.centroids)
                gaps[np.arange(len(gaps)), low + np.arange(len(gaps))] = np.inf
                some = np.argpartition(gaps, wide - 1, axis=1)[:, :wide]
                order = np.argsort(np.take_along_axis(gaps, some, 1), axis=1, kind="stable")
                found.append(np.take_along_axis(some, order, 1))
            near = np.stack([self._spread(i, row, degree) for i, row in enumerate(np.concatenate(found))])
        self.links = np.concatenate([near, around], axis=1)

    def _spread(self, own: int, near: np.ndarray, degree: int) -> np.ndarray:
        points = self.centroids[near]
        gaps = np.sqrt(((points - self.centroids[own]) ** 2).sum(axis=1))
        between = distances(points, points)
        kept: list[int] = []
        for i in range(len(near)):
            if len(kept) < degree and (not kept or (between[i, kept] >= gaps[i]).all()):
                kept.append(i)
        return np.append(near[kept], np.full(degree - len(kept), own))

    def near(self, rows: np.ndarray, reach: float, beam: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triples (row, centroid, distance) of the centroids found not farther than ``reach`` times the nearest one.

        From a few entries the nearest open centroid is expanded, while it is within reach or among the ``beam`` nearest.
        """

        out = []
        block = max(64, min(4096, (1 << 22) // len(self.centroids)))
        for low in range(0, len(rows), block):
            r, c, d = self._search(rows[low : low + block], reach, beam)
            out.append((r + low, c, d))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _search(self, rows: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(rows), len(self.centroids)
        gaps, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        entries = np.unique(np.linspace(0, k - 1, 8).astype(int))
        gaps[:, entries] = distances(rows, self.centroids[entries])
        live = np.arange(n)
        while len(live):
            own = gaps[live]
            open_gaps = np.where(done[live], np.inf, own)
            nearest = open_gaps.argmin(axis=1)
            at = open_gaps[np.arange(len(live)), nearest]
            bound = np.full(len(live), np.inf)
            if k > beam:
                bound = np.maximum(reach * own.min(axis=1), np.partition(own, beam - 1, axis=1)[:, beam - 1])
            going = np.isfinite(at) & (at <= bound)
            live, nearest = live[going], nearest[going]
            done[live, nearest] = True
            linked = self.links[nearest]
            gaps[live[:, None], linked] = np.sqrt(((self.centroids[linked] - rows[live][:, None]) ** 2).sum(axis=2))
        row, centroid = np.nonzero(gaps <= reach * gaps.min(axis=1, keepdims=True))
        return row, centroid, gaps[row, centroid]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _listed(graph, reach: float, most: int | None):
    """Rows with a vector in column ``v`` to one row per list that they go to, the nearest ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                row, found, gap = graph.value.near(_matrix(part.column("v")), reach)
                order = np.lexsort((found, gap, row))
                row, found = row[order], found[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                taken = slice(None) if most is None else place < most
                out = part.take(pa.array(row[taken]))
                yield pa.record_batch([pa.array(found[taken], pa.int64()), *out.columns], ["list", *part.schema.names])

    return run


def _tile(k: int):
    """Queries (query_id, ask, v) and vectors (v, ids) of a tile to each query's nearest ids, exact."""

    def run(asking: pa.Table, listed: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asking.num_rows and listed.num_rows:
            q, v = _matrix(asking.column("v")), _matrix(listed.column("v"))
            ids = listed.column("ids").to_pylist()
            squares = (q**2).sum(axis=1)[:, None] + (v**2).sum(axis=1) - 2 * q @ v.T
            bound = np.full(len(q), np.inf)
            if len(v) > k + 1:
                # One more than k: the own vector may be among them. The margin covers what the expanded form loses.
                bound = np.partition(squares, k, axis=1)[:, k] + 1e-9 * ((q**2).sum(axis=1) + (v**2).sum(axis=1).max())
            for i, (own, ask) in enumerate(zip(asking.column("query_id").to_pylist(), asking.column("ask").to_pylist(), strict=True)):
                near = np.flatnonzero(squares[i] <= bound[i])
                exact = np.sqrt(((v[near] - q[i]) ** 2).sum(axis=1)).tolist()
                pairs = sorted((d, x) for d, j in zip(exact, near.tolist(), strict=True) for x in ids[j] if x != own)
                found += [(own, ask, x, d) for d, x in pairs[:k]]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "ask", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""

    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def ann_search(
    vectors: DataFrame,
    asks: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    list_rows: int = 512,
    max_lists: int = 8192,
    sample_rows: int = 65_536,
    boundary: float = 1.05,
    copies: int = 2,
    reach: float = 1.12,
) -> DataFrame:
    """The ``k`` nearest found for every row of ``vectors`` that ``asks`` picks: query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's id; the score is the Euclidean distance in double precision, ties go to the
    smaller id. Rows without an id or a :func:`usable` vector take no part, nor do vectors of another length than most rows
    have (of equally frequent lengths, the smaller). Rows that repeat id and vector count once; an id with several vectors
    asks once with each and can be found by each. A table with few candidates gives fewer rows, an empty one none. Other columns
    are ignored, whatever their names.

    Centroids come from a sample of about ``sample_rows`` distinct vectors, ``list_rows`` vectors to a list and ``max_lists``
    lists at most: the sample and the centroids are what the driver holds. Every vector is listed, in up to ``copies`` lists
    whose centroids are within ``boundary`` times the nearest. Copies of one vector are listed once, with the ids that can be
    among the nearest. Recall depends on ``reach``; on uniformly spread vectors it takes most lists.
    """

    spark = vectors.sparkSession
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == length.length)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.select("vec_id", "v").dropDuplicates().withColumn("place", place).filter(F.col("place") <= k + 1)
    items = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = items.count()
    drawn = F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 30)) < (1 << 30) * min(sample_rows, n) // n
    sample = _matrix(items.filter(drawn).select("v").limit(2 * sample_rows).toArrow().column("v"))
    lists = 1 << max(0, min(max_lists, n // list_rows).bit_length() - 1)
    parts = balanced_parts(sample.astype(np.float32), lists) if len(sample) else []
    centroids = [sample[own].mean(axis=0) for own in parts if len(own)] or [np.zeros(length.length)]
    graph = spark.sparkContext.broadcast(CentroidGraph(np.stack(centroids)))  # at most ``max_lists`` centroids
    kind = dict(items.dtypes)["v"]
    listed = cut(items.mapInArrow(_listed(graph, boundary, copies), f"list long, v {kind}, ids array<long>"))
    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("ask"), "v").dropDuplicates()
    asking = cut(asking.mapInArrow(_listed(graph, reach, None), f"list long, query_id long, ask long, v {kind}"))
    # One row per list that is asked, and lists are bounded.
    sizes = asking.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("qs")).join(
        listed.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("vs")), "list"
    )
    sizes = F.broadcast(cut(sizes))

    def tiled(df: DataFrame, own: str, count: str, other: str, others: str, key: list[str]) -> DataFrame:
        df = df.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64(*key), F.col(count)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others).cast("long") - 1))).drop("qs", "vs")

    tile = ["list", "qt", "vt"]
    asked = tiled(asking, "qt", "qs", "vt", "vs", ["query_id", "ask"]).groupBy(*tile)
    found = asked.cogroup(tiled(listed, "vt", "vs", "qt", "qs", ["v"]).groupBy(*tile)).applyInArrow(
        _tile(k), "query_id long, ask long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "ask", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
