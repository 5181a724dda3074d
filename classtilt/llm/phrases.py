"""Collocations by vertical partitioning: suffixes are grouped by their word prefixes under a memory budget, and each group
builds its part of the suffix tree, cut at ``DEPTH`` words, on its own.

1. One pass counts words per language, and word pairs in a table of hash slots. A slot's count is never below a pair's, so a
   pair in a slot below ``least`` is surely rare, and no phrase that reaches ``least`` crosses it.
2. A second pass writes the suffixes from each word, to at most ``DEPTH`` words and up to the first surely rare pair.
3. Prefixes of one word are packed into groups of at most ``budget`` suffixes; a prefix over the budget is divided by
   its second word, and so on. Whole suffixes over the budget are summed before they are dealt.
4. A group sorts its suffixes; they are the leaves of its subtrees, common prefixes of neighbours are the inner nodes, and
   a node's count is a difference of running leaf totals.

Prefixes are told apart by hash slots, whose number follows from the input: two prefixes in one slot go to one group.
Nodes above the depth at which a prefix was divided are summed over groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt.llm.common import stored, whole
from classtilt.session import cut

DEPTH = 4
SCALE = 2_000_000
SEED = 42
BREAK = b"."
#: A-Z to lower case; marks that end a piece to one of them, which no word can hold.
FOLDED = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + BREAK * 10
)
#: Bytes of text that a worker takes in at a time.
CHUNK = 1 << 22
WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Per language and chunk: the distinct words, and the texts as their numbers, -1 between pieces."""

    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary())
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= CHUNK:
                yield lang, *_numbered(held.pop(lang))
                del sizes[lang]
        for lang, rest in held.items():
            yield lang, *_numbered(rest)


def _numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    folded = b"\n".join(texts).translate(FOLDED).replace(BREAK, b" . ")
    coded = pa.array([BREAK, *folded.split(), BREAK], pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64) - 1  # the break is the first entry


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    start = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.array([xxhash.xxh64_intdigest(w, start) for w in words.to_pylist()[1:]], np.uint64)


def _pair_slots(hashes: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """The slot of the pair that begins at each word, -1 where a piece ends."""

    left, right = codes[:-1], codes[1:]
    both = (left >= 0) & (right >= 0)
    mixed = (hashes[left] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[right]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.append(np.where(both, (mixed >> np.uint64(64 - bits)).astype(np.int64), -1), -1)


COUNTED = "lang string, word string, slot long, n long"


def _counts(bits: int, cap: int):
    """Rows (lang, word, null, n) of words, (lang, null, null, n) of all words and (null, null, slot, n) of pairs.

    A slot's count is held at ``cap`` in a task: sums of such counts reach it exactly when the whole sum does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = ["lang", "word", "slot", "n"], pa.int64()
        pairs = np.zeros(1 << bits, np.uint8 if cap < 256 else np.uint16)
        for lang, words, codes in _chunks(batches):
            found = np.bincount(codes[codes >= 0], minlength=len(words) - 1)
            word = pa.concat_arrays([words[1:].cast(pa.string()), pa.nulls(1, pa.string())])
            n = pa.array(np.append(found, found.sum()), numbers)
            yield pa.record_batch([pa.repeat(lang, len(word)), word, pa.nulls(len(word), numbers), n], names)
            if len(words) > 1:
                slots = _pair_slots(_hashes(words, lang), codes, bits)
                slot, m = np.unique(slots[slots >= 0], return_counts=True)
                pairs[slot] = np.minimum(pairs[slot] + m, cap)
        for low in range(0, 1 << bits, 1 << 17):
            slot = np.flatnonzero(pairs[low : low + (1 << 17)])
            none = pa.nulls(len(slot), pa.string())
            yield pa.record_batch(
                [none, none, pa.array(slot + low, numbers), pa.array(pairs[low + slot].astype(np.int64), numbers)], names
            )

    return run


def _suffixes(bits: int, marked):
    """Rows (lang, w1 to w4, n) of the suffixes of two words and more, equal ones of a chunk combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(marked.value, bitorder="little").view(bool)
        for lang, words, codes in _chunks(batches):
            if len(words) < 2:
                continue
            slots = _pair_slots(_hashes(words, lang), codes, bits)
            goes_on = (slots >= 0) & bitmap[slots]
            at = np.flatnonzero(goes_on)
            columns, alive = [codes[at], codes[at + 1]], np.ones(len(at), bool)
            for k in range(2, DEPTH):
                alive = alive & goes_on[np.minimum(at + k - 1, len(codes) - 1)]
                columns.append(np.where(alive, codes[np.minimum(at + k, len(codes) - 1)], -1))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            fresh = np.ones(len(at), bool)
            if len(at):
                fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(at)))
            named = words.cast(pa.string())
            taken = [named.take(pa.array(c[first] + 1, mask=c[first] < 0)) for c in columns]
            yield pa.record_batch([pa.repeat(lang, len(first)), *taken, pa.array(n, pa.int64())], ["lang", *WORDS, "n"])

    return run


def _nodes(least: int):
    """A group of suffixes (group, depth, lang, w1 to w4, n) to its nodes (lang, phrase, words, n) of two words and more.

    A row's ``depth`` is the length of the prefix that it was dealt by: nodes below that are whole in this group.
    """

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        depth = group.column("depth").to_numpy()
        coded = pa.chunked_array([c for w in ["lang", *WORDS] for c in group.column(w).chunks]).combine_chunks().dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy().reshape(DEPTH + 1, -1)
        order = np.lexsort(codes[::-1])
        codes, n, depth = codes[:, order], n[order], depth[order]
        upto = np.concatenate(([0], np.cumsum(n)))
        changed = np.ones(len(n), bool)
        changed[1:] = codes[0, 1:] != codes[0, :-1]
        out = []
        for level in range(1, DEPTH + 1):
            changed[1:] |= codes[level, 1:] != codes[level, :-1]
            if level == 1:
                continue
            first = np.flatnonzero(changed)
            ends = np.append(first[1:], len(n))
            total = upto[ends] - upto[first]
            shown = (codes[level, first] >= 0) & ((total >= least) | (level < depth[first]))
            first, total = first[shown], total[shown]
            parts = [coded.dictionary.take(pa.array(codes[i, first])) for i in range(level + 1)]
            phrase = pa.compute.binary_join_element_wise(*parts[1:], " ")
            out.append(pa.table([parts[0], phrase, pa.array(np.full(len(first), level, np.int32)), pa.array(total)], ["lang", "phrase", "words", "n"]))
        return pa.concat_tables(out)

    return run


def pack(sizes: dict, budget: int) -> dict:
    """Best fit, the largest first: each key's group; no group is over the budget but for a key that is larger itself."""

    groups, rooms, n = {}, [], 0  # rooms: (what is left, group), sorted
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            left, groups[key] = rooms.pop(at)
        else:
            left, groups[key] = budget, n
            n += 1
        if left > size:
            insort(rooms, (left - size, groups[key]))
    return groups


def _marked(slots: int, found: set) -> Column:
    """Whether column ``slot`` is one of ``found``: a byte for each slot, in a constant."""

    marks = bytes(slot in found for slot in range(slots))
    return F.substring(F.lit(marks), (F.col("slot") + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _dealt(rows: DataFrame, budget: int) -> DataFrame:
    """Suffixes with the depth of the prefix that they are dealt by and its group."""

    spark = rows.sparkSession
    slots = 1 << max(12, (4 * rows.count() // budget).bit_length())
    parts, table = [], []
    for depth in range(1, DEPTH + 1):
        if depth == DEPTH:
            rows = rows.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
        keyed = rows.withColumn("slot", F.pmod(F.xxhash64("lang", *WORDS[:depth]), F.lit(slots))).withColumn("depth", F.lit(depth))
        sizes = {r.slot: r["count"] for r in keyed.groupBy("slot").count().collect()}  # at most ``slots`` rows
        heavy = {s for s, n in sizes.items() if n > budget} if depth < DEPTH else set()
        table += [(depth, s, g) for s, g in pack({s: n for s, n in sizes.items() if s not in heavy}, budget).items()]
        if not heavy:
            parts.append(keyed)
            break
        divided = _marked(slots, heavy)
        parts.append(keyed.filter(~divided))
        rows = keyed.filter(divided).select("lang", *WORDS, "n")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    groups = spark.createDataFrame(table, "depth int, slot long, part int")
    return out.join(F.broadcast(groups), ["depth", "slot"]).select("depth", "part", "lang", *WORDS, "n")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, budget: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (lang, n) of all words, (lang, phrase, n) of words and (lang, phrase, words, n) of phrases, from ``least`` on."""

    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole(F.col(text_col)).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(25, max(16, (size // 24).bit_length()))  # about a slot for every word, while that fits
    cap = min(least, 65_535)
    partial = texts.mapInArrow(_counts(bits, cap), COUNTED)
    found = partial.groupBy("lang", "word", "slot").agg(F.sum("n").alias("n"))
    enough = F.when(F.col("slot").isNotNull(), F.col("n") >= cap).otherwise(F.col("word").isNull() | (F.col("n") >= least))
    found = cut(found.filter(enough))
    totals = found.filter("word is null and slot is null").select("lang", "n")
    words = found.filter("word is not null").select("lang", F.col("word").alias("phrase"), "n")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    block = found.filter("slot is not null").groupBy(F.shiftright("slot", 6).alias("block")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.int64)  # at most 4 MB
    bitmap[block.column("block").to_numpy()] = block.column("bits").to_numpy()
    marked = spark.sparkContext.broadcast(bitmap.view(np.uint8))
    schema = "lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", n long"
    dealt = _dealt(stored(texts.mapInArrow(_suffixes(bits, marked), schema), "suffixes"), budget)
    nodes = dealt.groupBy("depth", "part").applyInArrow(_nodes(least), "lang string, phrase string, words int, n long")
    phrases = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return totals, words, cut(phrases)


def _scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, words, a) with l, r and score of their lowest cut."""

    known = words.unionByName(phrases.select("lang", "phrase", "n"))
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    # Decimals: the product may pass 64 bits.
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(lowest.alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _inside(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer candidate that holds the phrase."""

    parts = F.expr(
        "flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, w), ' '))))"
    )
    longer = phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "n")
    return longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, in stages, so that no task ranks a whole language."""

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for salts in (512, 16, 1):
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        scored = salted.withColumn("rank", rank).filter(F.col("rank") <= top).drop("salt")
    return scored


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    share: int = 80,
    top: int = 2000,
    budget: int = 100_000,
) -> DataFrame:
    """Each language's best phrases of two to four words: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) are folded to lower-case a-z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``; a null language is ``und``. A phrase that occurs ``least`` times or more inside pieces is a candidate. The
    score is that of its lowest cut, ``floor(2000000 * a / (l + r))`` with the counts of both parts, ties to the shortest
    first part. Candidates that stand inside a longer one with ``share`` percent of their count are dropped. Ties in
    score and count go by the bytes of the phrase. Repeated rows count as often as they stand there; a language without
    candidates has no rows, nor has an empty table. Other columns are ignored, whatever their names. ``budget`` is the number
    of suffixes that a task holds at once.
    """

    totals, words, phrases = phrase_counts(docs, lang_col, text_col, least, budget)
    scored = _scored(words, phrases).join(_inside(phrases), ["lang", "phrase"], "left")
    kept = scored.filter(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    ranked = _best(kept.select("lang", "phrase", "a", "l", "r", "score"), top)
    columns = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *columns)
