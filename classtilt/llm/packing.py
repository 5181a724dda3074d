"""Packing into training sequences: vector bin packing by the dot-product heuristic.

An example has three sizes: tokens, segments (one) and loss-bearing tokens; a sequence has a limit on each. One sequence is
open at a time. Of the examples that fit it takes the one whose sizes have the largest weighted dot product with what is
left of the limits, so a sequence short of tokens but rich in segments takes long examples first, and the other way
round. Where cutting is allowed, the rest of a sequence that no example fits is filled by the head of one.

Every task packs its own rows batch by batch, so nothing is shuffled and no group grows with the table. Sequence ids hold
the partition's number, so a task that runs again writes the same ids.
"""

from __future__ import annotations

import gc
import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt.llm.bpe_automaton import PrefixTransducer
from classtilt.llm.token_counts import NUMBER, SPACE, blocks, byte_letters, kinds_of, split_endings, utf8

END = b"\xff"  # ends a word; no UTF-8 text holds this byte
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def pack(
    tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool, remainder: bool = False
) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length).

    ``cut``: an example may be divided anywhere, and then carries loss on all its tokens or on none. ``remainder``: the
    last, unfull sequence is divided again into sequences whose sizes are powers of two, which need no padding. An
    example beyond a limit that may not be cut raises ValueError.
    """

    room = np.array([limits.tokens, limits.segments, limits.loss], float)
    left, start = tokens.astype(np.int64), np.zeros(len(tokens), np.int64)
    bearing = loss > 0
    whole = min(limits.tokens, limits.loss) if bearing.any() else limits.tokens
    out: list[list[tuple[int, int, int]]] = []
    if cut:
        if (bearing & (loss != tokens)).any():
            raise ValueError("examples that are cut bear loss on all tokens or on none")
        for i in np.flatnonzero(left >= whole).tolist():
            while left[i] >= whole:
                out.append([(i, int(start[i]), whole)])
                start[i] += whole
                left[i] -= whole
    elif (tokens > limits.tokens).any() or (loss > limits.loss).any():
        raise ValueError("an example is beyond the limits of a sequence")
    size = np.stack([left, np.ones(len(left)), np.where(bearing, left if cut else loss, 0)], axis=1).astype(float)
    waiting = np.flatnonzero(left > 0)
    # Weights put the three sizes on one scale: their mean over the examples against the limits.
    weight = (size[waiting].mean(axis=0) / room if len(waiting) else np.ones(3)) / room
    # Examples alike in all sizes score alike: one queue per size keeps a step short, whatever the number of examples.
    order = waiting[np.lexsort((waiting, size[waiting, 2], size[waiting, 0]))]
    queues: dict[tuple[float, float], list[int]] = {}
    for i in order[::-1].tolist():
        queues.setdefault((size[i, 0], size[i, 2]), []).append(i)
    kinds = np.array([(t, 1.0, m) for t, m in queues]).reshape(-1, 3)
    names = list(queues)
    live = np.ones(len(kinds), bool)

    def put_back(i: int) -> None:
        nonlocal kinds, live  # queues, names and at are looked up anew as well
        key = (float(left[i]), float(left[i]) if bearing[i] else 0.0)
        if key not in queues:
            queues[key] = []
            names.append(key)
            kinds = np.vstack([kinds, [key[0], 1.0, key[1]]])
            live = np.append(live, False)
            at[key] = len(names) - 1
        queues[key].append(i)
        live[at[key]] = True

    at = {key: k for k, key in enumerate(names)}
    while live.any():
        if live.sum() * 2 < len(live):
            kinds, names = kinds[live], [names[k] for k in np.flatnonzero(live).tolist()]
            queues = {name: queues[name] for name in names}
            at = {key: k for k, key in enumerate(names)}
            live = np.ones(len(kinds), bool)
        rest, row = room.copy(), []
        while True:
            pull = weight * rest
            score = kinds[:, 0] * pull[0] + kinds[:, 2] * pull[2] + pull[1]
            score[~live | (kinds[:, 0] > rest[0]) | (kinds[:, 2] > rest[2])] = -1.0
            k = int(np.argmax(score))
            if rest[1] < 1 or score[k] < 0:
                break
            i = queues[names[k]].pop()
            live[k] = bool(queues[names[k]])
            row.append((i, int(start[i]), int(left[i])))
            rest -= kinds[k]
        if cut and live.any() and rest[0] >= 1 and rest[1] >= 1 and (rest[2] >= 1 or (live & (kinds[:, 2] == 0)).any()):
            able = live & ((kinds[:, 2] == 0) | (rest[2] >= 1))
            k = int(np.argmax(np.where(able, kinds[:, 0], -1.0)))
            i = queues[names[k]].pop()
            live[k] = bool(queues[names[k]])
            part = int(rest[0] if not bearing[i] else min(rest[0], rest[2]))
            row.append((i, int(start[i]), part))
            start[i] += part
            left[i] -= part
            put_back(i)
        out.append(row)
    if remainder and cut and out and (total := sum(n for _, _, n in out[-1])) < limits.tokens:
        out[-1:] = _powers(out[-1], total)
    return out


def _powers(row: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A sequence divided into sequences whose sizes are the powers of two of its own."""

    out, pieces = [], list(row)
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        if not need:
            continue
        part = []
        while need:
            i, start, length = pieces.pop(0)
            taken = min(need, length)
            part.append((i, start, taken))
            if taken < length:
                pieces.insert(0, (i, start + taken, length - taken))
            need -= taken
        out.append(part)
    return out


class WordIds:
    """Ids of whole texts as a word-level BPE file of the ``tokenizers`` library gives them.

    The file's normaliser composes characters, lower-cases them and turns white space into one space; pre-tokens are runs
    of letters, single numbers, runs of other characters, and endings after an apostrophe. All pre-tokens of a block
    run side by side through the prefix transducer, each with an end byte after it. Texts with a special token, or
    with a letter whose lower case depends on its neighbours, go to the library itself.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, suffix = byte_letters(), spec["model"]["end_of_word_suffix"]

        def spell(s: str) -> bytes:
            body = bytes(letters[c] for c in s.removesuffix(suffix))
            return body + END if s.endswith(suffix) else body

        def split(text: bytes) -> list[bytes]:
            whole = [text[i : i + 1] for i in range(len(text) - text.endswith(END))]
            return [*whole[:-1], whole[-1] + END] if text.endswith(END) else whole

        ranks = {(spell(a), spell(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        vocab = {spell(t): i for t, i in spec["model"]["vocab"].items()}
        self.machine = PrefixTransducer(vocab, lambda a, b: ranks.get((a, b)), split, counting=False)
        self.special = tuple(t["content"].encode() for t in spec["added_tokens"])
        self.end = np.array([end_id], "<u4").tobytes()

    def _normal(self, text: bytes) -> bytes | None:
        """The text as the normaliser gives it, white space apart; None if only the library can tell."""

        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower()
        plain = text.decode()
        if "\u03a3" in plain:
            return None
        return (plain if unicodedata.is_normalized("NFC", plain) else unicodedata.normalize("NFC", plain)).lower().encode()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text, with the end id."""

        normal = [self._normal(t) for t in texts]
        sizes = np.fromiter((len(t or b"") for t in normal), np.int64, len(normal))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(t or b"" for t in normal), np.uint8)
        ids = np.full(len(data), -1, np.int32)
        if len(data):
            begins = np.zeros(len(data), bool)
            begins[(ends - sizes)[sizes > 0]] = True
            lead, kind = kinds_of(data)
            start = begins | (lead & np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))))
            split_endings(data, kind, begins, start)
            starts = np.flatnonzero(start)
            lengths = np.diff(starts, append=len(data))
            word = kind[starts] != SPACE
            starts, lengths = starts[word], lengths[word]
            lasts = np.empty(len(data), np.int32)
            finals = self.machine.run(data, starts, lengths, lasts, END[0])[1]
            self.machine.recover(lasts, starts, lengths, ids, finals)
        there = ids >= 0
        flat = ids[there].astype("<u4").tobytes()
        edge = np.concatenate(([0], np.cumsum(there)))[np.concatenate(([0], ends))].tolist()
        out = []
        for text, known, a, b in zip(texts, normal, edge, edge[1:], strict=False):
            if known is None:
                asked = self.library.encode(text.decode(), add_special_tokens=False).ids
                out.append(np.array(asked, "<u4").tobytes() + self.end)
            else:
                out.append(flat[4 * a : 4 * b] + self.end)
        return out


@cache
def word_ids(path: str, end_id: int) -> WordIds:
    gc.disable()  # states hold no garbage cycles, and walking over them again and again costs time
    return WordIds(path, end_id)


def _pack(path: str, end_id: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path, end_id)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = [packed for block in blocks(utf8(batch.column(1))) for packed in ids_of.encode(block)]
            names = batch.column(0).to_pylist()
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            rows = []
            for sequence in pack(tokens, tokens, limits, cut=True, remainder=True):
                offset = 0
                for i, start, length in sequence:
                    check = zlib.crc32(ids[i][4 * start : 4 * (start + length)])
                    rows.append((names[i], start, length, check, int(tokens[i]), number, offset))
                    offset += length
                number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Whole documents as pieces in sequences: one row per piece.

    A document's ids are those of the ``tokenizers`` file at ``path``, then ``end_id``; each id lies in exactly one piece. All
    tokens bear loss. A null or empty text has the end id only. Repeated rows and ids are packed one by one; an empty
    table gives no piece; other columns are ignored.
    """

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(path, end_id, limits), PIECE)


def _pack_examples(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            names = batch.column(0).to_pylist()
            tokens, loss = (np.array(batch.column(c).fill_null(0), np.int64) for c in (1, 2))
            rows = []
            for sequence in pack(tokens, loss, limits, cut=False):
                offset = 0
                for i, _, length in sequence:
                    rows.append((names[i], int(tokens[i]), int(loss[i]), number, offset))
                    offset += length
                number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns], ["example_id", "n_tokens", "n_loss", "sequence_id", "offset"]
            )

    return run


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "example_id",
    tokens_col: str = "n_tokens",
    loss_col: str = "n_loss",
) -> DataFrame:
    """Instruction examples, never cut, placed under all three limits: example_id, n_tokens, n_loss, sequence_id, offset.

    Examples without tokens (or with null sizes) lie in no sequence and give no row; one beyond a limit is an error.
    """

    rows = examples.select(
        F.col(id_col).cast("long").alias("a"), F.col(tokens_col).cast("long").alias("b"), F.col(loss_col).cast("long").alias("c")
    )
    out = "example_id long, n_tokens long, n_loss long, sequence_id long, offset long"
    return rows.mapInArrow(_pack_examples(limits), out)
