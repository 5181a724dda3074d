"""Fill-in-middle: texts are cut at two unit boundaries and written as prefix, suffix, middle, or suffix first.

Boundaries are found on a wavelet matrix over the character classes of many texts at once (:mod:`classtilt.llm.wavelet`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt.llm.common import whole
from classtilt.llm.wavelet import Units

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four draws of 32 bits from the sha256 of ``seed:doc_id``; a null id counts as an empty one."""

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _formatted(texts: list[bytes], draws: np.ndarray, unit: str, fim_percent: int, spm_percent: int) -> list[tuple]:
    """Rows (n, form, prefix_chars, middle_chars, output) of some texts."""

    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    units = Units(data, starts, ends, unit)
    points = draws[:2] % (units.n + 1)
    first, second = units.cut(points.min(axis=0)), units.cut(points.max(axis=0))
    prefixes, middles = units.chars(starts, first), units.chars(first, second)
    p, s, m = (mark.encode() for mark in MARKS)
    rows = []
    for i, text in enumerate(texts):
        if not text or draws[2, i] % 100 >= fim_percent or p in text or s in text or m in text:
            rows.append((int(units.n[i]), "plain", None, None, text))
            continue
        a, b = int(first[i] - starts[i]), int(second[i] - starts[i])
        form = "spm" if draws[3, i] % 100 < spm_percent else "psm"
        pieces = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
        rows.append((int(units.n[i]), form, int(prefixes[i]), int(middles[i]), b"".join(pieces)))
    return rows


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    chunk: int = 1 << 22,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output. No shuffle.

    ``unit`` is line (its line end included), word (with the white space behind it) or char. A text of n units is cut after
    two of the 0 to n units, drawn from its id. ``plain`` texts stay as they are: empty and null ones (n is 0), those that
    hold one of the marks, and those that ``fim_percent`` leaves out. Repeated rows give repeated rows, a null id draws like
    an empty one, an empty table gives an empty result, and other columns are ignored, whatever their names. Ranks are taken
    over ``chunk`` bytes of texts at a time, or one longer text: that bounds a task's memory, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
            pieces = np.concatenate(([0], np.cumsum(sizes)))[:-1] // chunk
            edges = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(sizes)]
            draws = np.stack([batch.column(2 + i).to_numpy() for i in range(4)]) if len(sizes) else None
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                rows = _formatted(texts[a:b].to_pylist(), draws[:, a:b], unit, fim_percent, spm_percent)
                n, form, prefixes, middles, outputs = zip(*rows, strict=True)
                output = pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                columns = [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(form), pa.array(prefixes, pa.int64())]
                yield pa.record_batch([*columns, pa.array(middles, pa.int64()), output], SCHEMA.replace(" long", "").replace(" string", "").split(", "))

    doc_id = F.col(id_col).cast("long")
    draws = [draw.alias(f"h{i}") for i, draw in enumerate(_draws(doc_id, seed))]
    return docs.select(doc_id.alias("doc_id"), whole(F.col(text_col)).alias("text"), *draws).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again. Marks occur once each in an output that is not plain, so splitting at them is exact."""

    def part(mark: str, i: int, of: Column) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(i))

    tail = part(MIDDLE, 1, output)
    middle = part(MIDDLE, 2, output)
    psm = F.concat(part(SUFFIX, 1, part(PREFIX, 2, tail)), middle, part(SUFFIX, 2, tail))
    spm = F.concat(part(PREFIX, 2, tail), middle, part(PREFIX, 1, part(SUFFIX, 2, tail)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
