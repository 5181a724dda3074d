"""Near copies by word shingles: texts link when the Jaccard similarity of their shingle sets reaches a percentage.

Equal shingle sets are collapsed before anything is compared. Candidates come from two paths:

- SimHash, as in ``simhash.py``, over the set: fingerprints at ``RADIUS`` or fewer differing bits, found by exact buckets of
  ``BLOCKS`` bit blocks and compared by bit planes. At 80 % two fingerprints differ in about 10 of 64 bits, so no radius that
  64 bits can be dealt by finds all of those texts;
- the rest: a sketch of ``BANDS * ROWS`` minima (a byte of each) makes one bucket key per band, so two texts at 80 % share no
  bucket with probability 1e-7. In a bucket sketches are compared, at 20 points below the percentage.

What is linked by either is a candidate component. The shingle sets of those, and no others, are dealt out once more by
component, and there whole sets decide every link:

1. each set goes to one tile of its component, beside the set of the component's representative, and is compared with that
   and with the tile; most copies of a text end in one tree here;
2. only sets outside of their component's largest tree are dealt again, each to meet all other tiles. Sets of the largest
   tree meet those, and not each other.

Buckets with more rows than a tile are cut into tiles by hash and pairs of tiles are dealt to different tasks. Tasks return
spanning trees, never all linked pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt.llm import simhash
from classtilt.llm.common import fresh
from classtilt.llm.components import components
from classtilt.session import cut

SEED = 42
RADIUS, BLOCKS = 7, 9
BANDS, ROWS = 32, 4
FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64) * 2 + 1
#: Most slots of the bitmap that says which rows can be in a component: 8 MB, so it can be broadcast.
SLOTS = 1 << 26


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a UTF-8 text, A-Z in lower case; a shorter text is one shingle."""

    words = text.lower().split()  # on bytes: A-Z only, and the contract's white space
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[min(width, len(words)) - 1 :])  # noqa: B905
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each minimum of the set."""

    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for part in range(0, len(hashes), 2048):
        mixed = (hashes[None, part : part + 2048] ^ FACTORS[0]) * FACTORS[1]
        np.minimum(least, mixed.min(axis=1), out=least)
    return (least >> np.uint64(16)).astype(np.uint8).tobytes()


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sketches = [], [], []
            for text in batch.column(2).cast(pa.large_binary()):
                own = shingles(text.as_py() or b"", width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                prints.append(simhash.of_hashes(own))
                sketches.append(sketch(own))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "mark", "node", "fp", "sketch"])

    return run


def linked_trees(
    n: int, similar: Callable[[int, np.ndarray], np.ndarray], trees: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning trees of the links among n rows, as positions (row, root); rows that are in one tree are not compared.

    ``trees`` says which rows are in one tree already; links inside those are not returned.
    """

    known = np.arange(n)
    if trees is not None:
        _, first, number = np.unique(trees, return_index=True, return_inverse=True)
        known = first[number]
    label = known.copy()
    for i in range(n - 1):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(other) and len(hit := other[similar(i, other)]):
            met = np.unique(np.append(label[hit], label[i]))
            label[np.isin(label, met)] = met[0]
    children = np.flatnonzero(label != known)
    return children, label[children]


def _by_sketch(percent: int):
    least = (percent - 20) * BANDS * ROWS // 100

    def prepare(column: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
        rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return lambda i, other: (rows[other] == rows[i]).sum(axis=1) >= least

    return prepare


def _by_shingles(percent: int):
    def prepare(column: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in column]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.zeros(len(names), bool)

        def similar(i: int, other: np.ndarray) -> np.ndarray:
            own[:] = False
            own[codes[edges[i] : edges[i + 1]]] = True
            before = np.concatenate(([0], np.cumsum(own[codes])))
            both = before[edges[other + 1]] - before[edges[other]]
            return 100 * both >= percent * (sizes[i] + sizes[other] - both)

        return similar

    return prepare


def _sets(width: int):
    """Rows with a text in the last column to the same with its shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            packed = pa.array([shingles(t.as_py() or b"", width).tobytes() for t in texts], pa.binary())
            yield pa.record_batch([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "set"])

    return run


def _trees(prepare: Callable, chunk: int = 1 << 24):
    """Rows (key, a, b, node, what is compared, perhaps tree), sorted by the first three, to links (a, b) of nodes inside each
    group. Nodes of one tree are linked already."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        keys = [rows.column(c).to_numpy() for c in ("key", "a", "b")]
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
        nodes, compared = rows.column("node").to_numpy(), rows.column(4).combine_chunks()
        trees = rows.column(5).to_numpy() if rows.num_columns > 5 else None
        found = []
        for start, end in zip(edges, edges[1:], strict=False):
            if end - start > 1:
                known = None if trees is None else trees[start:end]
                if known is not None and (known == known[0]).all():
                    continue
                child, root = linked_trees(end - start, prepare(compared.slice(start, end - start)), known)
                found.append((nodes[start + child], nodes[start + root]))
        if not found:
            return None
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.nbytes < chunk:
                continue
            same = np.ones(held.num_rows, bool)
            for c in ("key", "a", "b"):
                same &= held.column(c).to_numpy() == held.column(c)[-1].as_py()
            whole = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if whole:
                if (out := solve(held.slice(0, whole))) is not None:
                    yield out
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows and (out := solve(held)) is not None:
            yield out

    return run


def _dealt(rows: DataFrame, compared: str, tile: int) -> DataFrame:
    """Rows (key, count, node, compared) in tiles of their key, each tile beside each other one."""

    rows = rows.withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", compared)
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")


def _row_key(doc_id: Column, mark: Column) -> Column:
    """In a struct null ids match each other."""

    return F.struct(doc_id.cast("long").alias("id"), mark.alias("mark"))


def _can_match(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that are surely not in ``members``, by a bitmap of their ``_key_`` hashes."""

    slots = min(SLOTS, max(1 << 16, 1 << (8 * members.count()).bit_length()))
    slot = F.pmod(F.xxhash64("_key_"), F.lit(slots))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_key_), {slots}) & 63 as int))")
    words = members.groupBy(F.shiftright(slot, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = docs.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(words), "_word")
    return rows.filter(F.col("_bits").bitwiseAND(bit) != 0)


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, a, b, node, set, perhaps tree) to links."""

    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
    return rows.mapInArrow(_trees(_by_shingles(percent)), "a long, b long")


def set_links(sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (a, b) of ``sets`` (key, count, node, set) whose components are those of all pairs in a key at the percentage."""

    tiles = F.ceil(F.col("count") / tile).cast("int")
    own = sets.withColumn("tiles", tiles).withColumn("a", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # The representative of a component is the row that its key is the node of.
    head = own.filter("node = key").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    head = head.filter(F.col("a") != F.pmod(F.xxhash64("node"), F.col("tiles")))
    first = own.unionByName(head).select("key", "a", F.col("a").alias("b"), "node", "set")
    trees = components(_linked(first, percent))
    rooted = sets.join(trees, "node", "left").withColumn("tree", F.coalesce("root", "node")).drop("root")
    sizes = rooted.groupBy("key", "tree").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("n", "tree")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("trees")
    )
    # Components of one tile are settled: there every pair was compared.
    open_keys = largest.filter((F.col("trees") > 1) & (F.col("all") > tile))
    open_keys = cut(open_keys.select("key", F.col("most.tree").alias("large"), F.col("most.n").alias("n"), "all"))
    again = rooted.drop("count").join(open_keys, "key")
    inner, outer = F.ceil(F.col("n") / tile).cast("int"), F.ceil((F.col("all") - F.col("n")) / tile).cast("int")
    again = again.withColumn("inner", inner).withColumn("outer", outer).withColumn("in", F.col("tree") == F.col("large"))
    place = F.xxhash64("node")
    again = again.withColumn("own", F.when(F.col("in"), F.pmod(place, F.col("inner"))).otherwise(F.col("inner") + F.pmod(place, F.col("outer"))).cast("int"))
    meets = F.when(F.col("in"), F.col("inner")).otherwise(F.lit(0))
    again = again.withColumn("other", F.explode(F.sequence(meets, F.col("inner") + F.col("outer") - 1)))
    again = again.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "set", "tree")
    second = _linked(again, percent)
    return second.unionByName(trees.select(F.col("node").alias("a"), F.col("root").alias("b")))


def print_links(nodes: DataFrame, tile: int) -> DataFrame:
    """Links (a, b) of ``nodes`` (node, fp) whose components are those of all pairs of fingerprints within ``RADIUS``."""

    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    links = simhash.near_links(heads.select("fp"), RADIUS, tile, BLOCKS)
    for end in ("a", "b"):
        links = links.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"_{end}")), end)
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(same)


def near_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, tile: int, text_tile: int) -> DataFrame:
    """Links (a, b) of ``nodes`` (node, fp, sketch, least) whose components are those of all pairs at the percentage.

    ``docs`` has (_key_, text); ``least`` names a row of it for each node.
    """

    bands = [F.xxhash64(F.lit(i), F.substring("sketch", i * ROWS + 1, ROWS)) for i in range(BANDS)]
    keys = nodes.select("node", F.explode(F.array(*bands)).alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1")
    rows = keys.join(shared, "key").join(nodes.select("node", "sketch"), "node")
    rest = _dealt(rows, "sketch", tile).mapInArrow(_trees(_by_sketch(percent)), "a long, b long")
    close = components(print_links(nodes.select("node", "fp"), tile).unionByName(rest))
    sizes = close.groupBy("root").count()
    members = cut(
        close.join(sizes, "root").join(nodes, "node").select(
            F.col("root").alias("key"), "count", "node", _row_key(F.col("least.doc_id"), F.col("least.mark")).alias("_key_")
        )
    )
    # Rows that repeat a key have one text: one of them is enough, and links of a node to itself mean nothing.
    rows = _can_match(docs, members).join(members, "_key_").select("key", "count", "node", "text")
    sets = cut(rows.mapInArrow(_sets(width), "key long, count long, node long, set binary"))
    return set_links(sets, percent, text_tile)


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    tile: int = 2048,
    text_tile: int = 256,
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component of links the row with its smallest id.

    Rows link when ``percent`` (80 or more) of all the distinct shingles in two texts are in both. Texts without words,
    null ones included, are equal. Of rows that repeat the smallest id, or of a component without any id, the row with the
    least hash of its text stays; rows that share id and text are one row.
    """

    if percent < 80:
        raise ValueError("percent must be 80 or more: the bands are made for that")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    prints = cut(rows.mapInArrow(_sketches(width), "doc_id long, mark long, node long, fp long, sketch binary"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    nodes = cut(
        prints.groupBy("node").agg(F.min(order).alias("least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))
    )
    texts = rows.select(_row_key(F.col("doc_id"), F.col("mark")).alias("_key_"), "text")
    roots = components(near_links(texts, nodes, width, percent, tile, text_tile))
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("least").alias("least"))
    stays = stays.select(_row_key(F.col("least.doc_id"), F.col("least.mark")).alias("_stay"))
    # Repeated rows are found where the join has dealt them.
    key = fresh(docs, "_key_")
    keyed = docs.withColumn(key, _row_key(F.col(id_col), F.xxhash64(text)))
    kept = keyed.join(stays, keyed[key] == stays["_stay"], "left_semi")
    return kept.dropDuplicates([key]).drop(key)
