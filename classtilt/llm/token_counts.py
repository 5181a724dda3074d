"""Token counts by a compiled transducer.

The vocabulary's merges are compiled to a deterministic transducer whose transitions carry emitted-token counts (see
``bpe_automaton``). Texts are cut into chunks where pre-tokens begin: from whatever state a chunk is entered, its first
byte restarts the transducer, so the state map of a chunk is a constant map with a count. Maps of this kind compose by
adding counts: the prefix sum over all chunks of a block is their scan, and a document's count is the difference of the
scan at its ends. All chunks of a block run side by side.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt.llm.bpe_automaton import PrefixTransducer

#: Printable bytes of the byte alphabet, the endings that are split off after an apostrophe, and Unicode's
#: white space.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
BLOCK = 1 << 21  # bytes of text that run side by side


def byte_letters() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for code points from 256 on, in order."""

    own = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def character_kinds() -> np.ndarray:
    """Kind of every code point."""

    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group in "LN":
            kinds[c] = LETTER if group == "L" else NUMBER
    kinds[[ord(c) for c in WHITE]] = SPACE
    return kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: whether a byte begins a character, and at the beginning its code point."""

    lead = (data & 0xC0) != 0x80
    points = data.astype(np.int32)
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        at = np.flatnonzero((data >= low) & (data < high))
        value = (data[at] & mask).astype(np.int32)
        for k in range(1, more + 1):
            value = value << 6 | (data[at + k] & 0x3F)
        points[at] = value
    return lead, points


def split_endings(data: np.ndarray, kind: np.ndarray, begins: np.ndarray, start: np.ndarray) -> None:
    """An apostrophe that stands alone before one of ENDINGS takes it: ``start`` is changed in place."""

    n = len(data)
    mark = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~begins[1:])
    if not len(mark):
        return
    ends = np.flatnonzero(begins)
    stop = np.append(ends, n)[np.searchsorted(ends, mark, side="right")]
    for ending in ENDINGS:
        size = len(ending)
        fits = mark + size < stop
        for k, c in enumerate(ending):
            fits &= data[np.minimum(mark + 1 + k, n - 1)] == ord(c)
        start[mark[fits] + 1] = False
        after = mark[fits] + 1 + size
        start[after[after < n]] = True


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte begins a character, and the kind of its character."""

    lead, points = code_points(data)
    kind = character_kinds()[points]
    if not lead.all():
        kind = kind[np.maximum.accumulate(np.where(lead, np.arange(len(data), dtype=np.int32), 0))]
    return lead, kind


def pre_tokens(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as flags over the bytes. ``begins``: flags where a text (or a part of it) begins.

    Runs of letters, numbers or other characters each take one space before them; white space before them keeps its last
    character apart; an apostrophe alone before one of ENDINGS takes it.
    """

    lead, kind = kinds_of(data)
    start = begins | (lead & np.concatenate(([True], kind[1:] != kind[:-1])))
    # The last character of white space that something follows.
    follower = np.flatnonzero(start[1:] & ~begins[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    last = follower - 1
    while not (inside := lead[last]).all():
        last = np.where(inside, last, last - 1)
    start[last] = True
    start[follower[data[last] == 0x20]] = False
    split_endings(data, kind, begins, start)
    return start


class ByteLevelCounter:
    """Counts the tokens of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()

        def spell(s: str) -> bytes:
            return bytes(letters[c] for c in s)

        ranks = {(spell(a), spell(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        vocab = {spell(t): i for t, i in spec["model"]["vocab"].items()}
        self.machine = PrefixTransducer(
            vocab, lambda a, b: ranks.get((a, b)), lambda t: [t[i : i + 1] for i in range(len(t))], counting=True
        )
        self.special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)

    def _special(self, text: bytes, offset: int) -> list[tuple[int, int]]:
        """(begin, end) of special tokens in a text, the leftmost first and the longest of equals."""

        found, at = [], 0
        while hits := [(i, -len(s)) for s in self.special if (i := text.find(s, at)) >= 0]:
            begin, size = min(hits)
            at = begin - size
            found.append((offset + begin, offset + at))
        return found

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""

        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        begins = np.zeros(len(data), bool)
        begins[(ends - sizes)[sizes > 0]] = True
        special = []
        if any(s in joined for s in self.special):
            for text, end in zip(texts, ends.tolist(), strict=True):
                special += self._special(text, end - len(text))
        for begin, end in special:
            begins[begin] = True
            begins[end : end + 1] = True
        flags = pre_tokens(data, begins)
        for begin, end in special:
            flags[begin + 1 : end] = False
        starts = np.flatnonzero(flags)
        lengths = np.diff(starts, append=len(data))
        if special:
            own = np.isin(starts, [begin for begin, _ in special])
            found = np.ones(len(starts), np.int64)
            found[~own] = self.machine.run(data, starts[~own], lengths[~own])[0]
        else:
            found = self.machine.run(data, starts, lengths)[0]
        scan = np.concatenate(([0], np.cumsum(found)))
        edge = np.searchsorted(starts, np.concatenate(([0], ends)))
        return np.diff(scan[edge])


@cache
def counter(path: str) -> ByteLevelCounter:
    gc.disable()  # states hold no garbage cycles, and walking over them again and again costs a third of the time
    return ByteLevelCounter(path)


def blocks(texts: Iterator[bytes], size: int = BLOCK) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""

    block, total = [], 0
    for text in texts:
        if block and total + len(text) > size:
            yield block
            block, total = [], 0
        block.append(text)
        total += len(text)
    if block:
        yield block


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Texts of a column as UTF-8; null is empty."""

    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            sizes, totals = [], [np.zeros(0, np.int64)]
            for block in blocks(utf8(batch.column(1))):
                sizes += map(len, block)
                totals.append(machine.counts(block))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(totals), pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` names a byte-level ``tokenizers`` file that every executor has. Counts are those of its library without
    begin and end tokens; a special token's string inside a text counts as that token. Null and empty texts have no
    tokens. Repeated rows and ids are counted one by one; other columns are ignored; there is no shuffle.
    """

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
