"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are collapsed before anything is compared. Two fingerprints at ``radius`` or fewer differing bits agree
on at least ``BLOCKS - radius`` of ``BLOCKS`` bit blocks; each choice of that many blocks makes one bucket key, so
buckets miss no link. A task gets sorted buckets and compares them with bit planes: plane b holds bit b of every
fingerprint, 64 fingerprints to a word, and one pass over the planes updates 64 distances per word operation.

A bucket with more than ``tile`` fingerprints is cut into tiles by hash and its pairs of tiles are dealt to different
tasks. Tasks return spanning trees, never all linked pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt.llm.components import components
from classtilt.session import cut

BLOCKS = 5
SEED = 42


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that are set in over half of them."""

    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of a UTF-8 text, A-Z in lower case."""

    words = text.lower().split()  # on bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = starts + sizes
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    return of_hashes(hashes)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            prints = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "mark", "fp"])

    return run


def linked_trees(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning trees of the links inside each group, as positions (row, root).

    ``group`` ascends. For lag s = 1, 2, ... every row is compared with the row s places on, as long as both are in one
    group and not yet in one tree: the planes are shifted by s bits and XORed with themselves, and carry-save counters
    (ones, twos, fours, over) add up the differing bits of 64 rows per word. After every eight planes the words
    whose rows are all beyond the radius are abandoned.
    """

    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    words = n // 64 + 2
    bits = np.zeros((64, words * 64), np.uint8)
    for b in range(64):
        bits[b, :n] = (fps >> np.uint64(b)) & np.uint64(1)
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    planes = np.concatenate([planes, np.zeros_like(planes)], axis=1)
    ends = np.searchsorted(group, group, side="right")
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows, lag = np.arange(n), 0
    while True:
        lag += 1
        rows = rows[rows + lag < ends[rows]]
        if not len(rows):
            break
        open_rows = rows[label[rows] != label[rows + lag]]
        if not len(open_rows):
            continue
        lanes = np.zeros(words * 64, np.uint8)
        lanes[open_rows] = 1
        valid = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(valid)
        alive = valid[at]
        jump, shift = divmod(lag, 64)
        ones, twos, fours, over = (np.zeros(len(at), np.uint64) for _ in range(4))
        for b in range(64):
            own = planes[b]
            other = own[at + jump]
            if shift:
                other = (other >> np.uint64(shift)) | (own[at + jump + 1] << np.uint64(64 - shift))
            carry = own[at] ^ other
            ones, carry = ones ^ carry, ones & carry
            twos, carry = twos ^ carry, twos & carry
            fours, carry = fours ^ carry, fours & carry
            over |= carry
            if b % 8 == 7:
                alive &= ~_beyond(ones, twos, fours, over, radius)
                going = alive != 0
                if not going.all():
                    at, alive = at[going], alive[going]
                    ones, twos, fours, over = ones[going], twos[going], fours[going], over[going]
                    if not len(at):
                        break
        if not len(at):
            continue
        hits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, lane = np.nonzero(hits)
        for i in (at[which] * 64 + lane).tolist():
            a, c = find(i), find(i + lag)
            if a != c:
                parent[max(a, c)] = min(a, c)
        label = np.array(parent)
        while (nxt := label[label]).tolist() != label.tolist():
            label = nxt
    children = np.flatnonzero(label != np.arange(n))
    return children, label[children]


def _beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (0 to 7, or over) exceeds the radius."""

    out = over.copy()
    for value in range(radius + 1, 8):
        match = np.full_like(over, ~np.uint64(0))
        for plane, bit in ((ones, 1), (twos, 2), (fours, 4)):
            match &= plane if value & bit else ~plane
        out |= match
    return out


def _trees(radius: int, chunk: int = 1 << 16):
    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        keys = [rows.column(c).to_numpy() for c in ("key", "a", "b")]
        change = np.zeros(len(fps), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        child, root = linked_trees(fps, np.cumsum(change), radius)
        if len(child):
            return pa.record_batch([pa.array(fps[child].view(np.int64)), pa.array(fps[root].view(np.int64))], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < chunk:
                continue
            last = [held.column(c)[-1].as_py() for c in ("key", "a", "b")]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("key", "a", "b"), last, strict=True):
                same &= held.column(c).to_numpy() == v
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut_at:
                if (out := solve(held.slice(0, cut_at))) is not None:
                    yield out
                held = held.slice(cut_at).combine_chunks()
        if held is not None and held.num_rows and (out := solve(held)) is not None:
            yield out

    return run


def near_links(prints: DataFrame, radius: int, tile: int, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints ``fp`` to links (a, b) whose components are those of all pairs within the radius (7 at most)."""

    if not 0 <= radius < min(blocks, 8):
        raise ValueError(f"radius must be below {min(blocks, 8)}")
    widths = [64 * (i + 1) // blocks - 64 * i // blocks for i in range(blocks)]
    offsets = [64 * i // blocks for i in range(blocks)]
    masks = [((1 << w) - 1) << o for w, o in zip(widths, offsets, strict=True)]
    keys = []
    for number, picked in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in picked)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().filter(F.col("count") > tile)
    rows = rows.join(sizes, "key", "left").withColumn(
        "tiles", F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    )
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return dealt.mapInArrow(_trees(radius), "a long, b long")


def simhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 3,
    tile: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``radius`` bits (below ``BLOCKS``); component_id is the smallest id
    that is reachable over links. Texts without words, null ones included, have fingerprint zero and link like any other.
    Rows with equal ids are separate rows with their own fingerprints; null ids are never a component's id unless no
    other id is in it. An empty table gives an empty result; other columns are ignored.
    """

    prints = _prints(docs, id_col, text_col, width)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(distinct, radius, tile)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text as it is, null apart from empty) and fp of every row, written once."""

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return cut(rows.mapInArrow(_fingerprints(width), "doc_id long, mark long, fp long"))


def _rooted(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """``distinct`` (fp, least) with the root of each fingerprint's component."""

    roots = components(near_links(distinct.select("fp"), radius, tile))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
