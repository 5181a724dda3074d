"""SentencePiece BPE encoding and decoding by a table of last tokens.

A text is cut into chunks that no piece crosses: before a run of spaces, and around characters without a piece of their
own, which become byte pieces. Inside the chunks the prefix transducer finds the unique last token of every prefix by
automaton matches and pair-compatibility tests. The table keeps one token per byte of the block, all chunks run side by
side, and ids are recovered backwards from the chunks' ends.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classtilt.llm.bpe_automaton import PrefixTransducer
from classtilt.llm.token_counts import blocks, code_points, utf8

MARK = "▁"  # how the model writes a space; a space stands for it here


def _characters(text: bytes) -> list[bytes]:
    return [c.encode() for c in text.decode()]


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback, a leading space and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        pieces, scores, self.spelled = {}, {}, {}
        self.bytes = np.full(256, -1, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes((int(piece[3:5], 16),))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled[i] = b""
            else:
                spelled = self.spelled[i] = piece.replace(MARK, " ").encode()
                pieces[spelled], scores[spelled] = i, -model.get_score(i)
        if any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError("a piece of this model crosses a space")
        if (self.bytes < 0).any():
            raise ValueError("this model has no byte fallback")
        known = {c for p in pieces for c in _characters(p) if c in pieces}
        usable = {p: i for p, i in pieces.items() if known.issuperset(_characters(p))}
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c.decode()) for c in known]] = True
        self.machine = PrefixTransducer(
            usable, lambda a, b: scores.get(c) if (c := a + b) in usable else None, _characters, counting=False
        )

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""

        mark = MARK.encode()
        texts = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else t for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ids = np.full(len(data), -1, np.int32)
        if len(data):
            lead, points = code_points(data)
            known = self.known[points]
            known = known[np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))]
            ids[~known] = self.bytes[data[~known]]
            begins = np.zeros(len(data) + 1, bool)
            begins[ends - sizes] = True
            begins = begins[:-1]
            space = data == 0x20
            begins[1:] |= (space[1:] & ~space[:-1]) | (known[1:] != known[:-1])
            starts = np.flatnonzero(begins)
            lengths = np.diff(starts, append=len(data))
            chunk = known[starts]
            starts, lengths = starts[chunk], lengths[chunk]
            lasts = np.empty(len(data), np.int32)
            self.machine.run(data, starts, lengths, lasts)
            self.machine.recover(lasts, starts, lengths, ids)
        there = ids >= 0
        flat = ids[there].astype("<u4").tobytes()
        edge = np.concatenate(([0], np.cumsum(there)))[np.concatenate(([0], ends))].tolist()
        begin, end = (int(i).to_bytes(4, "little") for i in (self.bos, self.eos))
        return [begin + flat[4 * a : 4 * b] + end for a, b in zip(edge, edge[1:], strict=False)]

    def decode(self, packed: bytes) -> bytes:
        """The text of packed ids: pieces joined, one leading space dropped, bytes put together."""

        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace").encode()


@cache
def codec(path: str) -> PieceCodec:
    gc.disable()  # states hold no garbage cycles, and walking over them again and again costs a third of the time
    return PieceCodec(path)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for block in blocks(utf8(batch.column(1))):
                for packed in own.encode(block):
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(packed)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            packed = [p for block in blocks(utf8(batch.column(1))) for p in own.encode(block)]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(ids.as_py() or [], "<u4").tobytes()).decode() for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def piece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, begin and end included) of every row; null and empty texts have begin and end only."""

    return _rows(docs, id_col, text_col).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def piece_texts(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give an empty text."""

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path), "doc_id long, text string")


def piece_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, all with begin and end ids.

    Null counts as empty and has the two ids only. Repeated rows and ids are encoded one by one; other columns are
    ignored. ``path`` names a model that every executor has. There is no shuffle.
    """

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(docs, id_col, text_col).mapInArrow(_round_trip(path), out)
