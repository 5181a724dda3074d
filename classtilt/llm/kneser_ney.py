"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text, and perplexity per document.

An n-gram is the last ``order`` bytes of UTF-8 text packed into a long (start of text: byte 255, which UTF-8 never has), so
a context is a shift, a suffix is a mask, and every count is a plain grouping. Counts, contexts and probabilities are
tables sharded by (language, n-gram) and joined; a row has the values of all folds' models. None is collected, and only tables
with one row per language are broadcast, if they are small.

No text is judged by a model that has seen it: texts fall into folds by a hash of the text, so copies share a fold, and
the model of a fold is trained on the trusted texts of the other folds. All texts of a fold, trusted or not, are scored by
that model, so the perplexities of trusted texts, which give the thresholds, are those of unseen text.

Scoring: texts are dealt to blocks of one fold and neighbouring ids. A block asks once for each distinct n-gram in it, the
distinct n-grams of all blocks get their probabilities, backing off where one is unseen, and the answers return to the block.
A text's perplexity is an average that a short bad passage hardly moves; the worst window of the text is the second score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt.llm.common import stored, whole
from classtilt.llm.token_counts import blocks
from classtilt.session import cut

START = 255

#: n-grams in one row of the asked table; rows hold arrays because a checkpoint writes every row's header uncompressed.
CHUNK = 1 << 15


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram that ends at each byte of the texts, and each text's number of bytes."""

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes([START]) * (order - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    codes = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        codes = codes << 8 | data[k : k + len(codes)]
    # A window that ends inside the padding of the next text belongs to no text.
    own = np.ones(len(codes), bool)
    edge = np.cumsum(sizes + order - 1)[:-1]
    for k in range(order - 1):
        own[edge - (order - 1) + k] = False
    return codes[own], sizes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, lang, text) to (block, payload): the rows of a block in one compressed Arrow stream."""

    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for batch in batches:
        held = batch.column(0).to_numpy()
        order = np.argsort(held, kind="stable")
        edges = np.flatnonzero(np.diff(held[order])) + 1
        keys, payloads = [], []
        for rows in np.split(order, edges) if len(order) else []:
            part = batch.select([1, 2, 3]).take(pa.array(rows))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                stream.write_batch(part)
            keys.append(int(held[rows[0]]))
            payloads.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["block", "payload"])


def _unpacked(packed: pa.Table) -> Iterator[tuple[int | None, str, bytes]]:
    for payload in packed.column("payload"):
        part = pa.ipc.open_stream(payload.as_buffer()).read_all()
        texts = part.column("text").combine_chunks().cast(pa.large_binary())
        for doc_id, lang, text in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), texts, strict=True):
            yield doc_id, lang, text.as_py()


def _count(order: int):
    """Distinct n-grams of a block by language, each with its count in the block's trusted texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trusted = set(right.column("_trusted").to_pylist())
        groups: dict[tuple[str, bool], list[bytes]] = {}
        block = left.column("block")[0].as_py() if left.num_rows else None
        for doc_id, lang, text in _unpacked(left):
            groups.setdefault((lang, doc_id in trusted), []).append(text)
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (lang, sure), texts in groups.items():
            for part in blocks(iter(texts), 1 << 23):
                codes, counts = np.unique(_grams(part, order)[0], return_counts=True)
                found.setdefault(lang, []).append((codes, counts * sure))
        langs, codes, counts = [], [], []
        for lang, parts in found.items():
            own, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), len(own)).astype(np.int32)
            for k in range(0, len(own), CHUNK):
                langs.append(lang)
                codes.append(own[k : k + CHUNK])
                counts.append(n[k : k + CHUNK])
        return pa.table(
            {
                "block": pa.array([block] * len(langs), pa.int64()),
                "lang": pa.array(langs, pa.string()),
                "codes": pa.array(codes, pa.list_(pa.int64())),
                "counts": pa.array(counts, pa.list_(pa.int32())),
            }
        )

    return run


def _score(order: int, window: int):
    """Log probability of every text of a block and of its least likely window, from the answers to what the block has asked."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        langs = right.column("lang").to_pandas().to_numpy()
        asked, value = right.column("code").to_numpy(), right.column("logp").to_numpy()
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in set(langs.tolist()):
            own = langs == lang
            at = np.argsort(asked[own])
            known[lang] = asked[own][at], value[own][at]
        ids, names, sizes, sums, worst = [], [], [], [], []
        for doc_id, lang, text in _unpacked(left):
            ids.append(doc_id)
            names.append(lang)
            sizes.append(len(text))
            total = lowest = 0.0
            if text:
                codes, at = np.unique(_grams([text], order)[0], return_inverse=True)
                sorted_codes, logs = known[lang]
                passed = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(sorted_codes, codes)][at])])
                wide = min(window, len(text))
                total, lowest = float(passed[-1]), float((passed[wide:] - passed[:-wide]).min()) / wide
            sums.append(total)
            worst.append(lowest)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "lang": pa.array(names, pa.string()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "log_prob": pa.array(sums, pa.float64()),
                "window_log_prob": pa.array(worst, pa.float64()),
            }
        )

    return run


def _mask(order: int) -> Column:
    return F.lit((1 << 8 * order) - 1).cast("long")


def _small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table with a row per language, to be joined without dealing the other side by language; a large one is left to Spark."""

    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def _levels(asked: DataFrame, order: int, folds: int) -> list[DataFrame]:
    """Tables (lang, code, n, asked) of each order, from order 1 up, one row per n-gram that any text has.

    ``asked`` has (lang, fold, code, n) with counts in trusted text, and may repeat n-grams. In the tables ``n`` holds a count
    for each fold's model, which are the trusted texts of the other folds, and ``asked`` says whether the fold has the n-gram. The
    highest order uses its counts; lower orders use the number of distinct bytes that the model has seen before the n-gram.
    """

    own = [F.sum(F.when(F.col("fold") == f, F.col("n"))).alias(f"_{f}") for f in range(folds)]
    total = asked.groupBy("lang", "code").agg(*own)
    known = [F.coalesce(F.col(f"_{f}"), F.lit(0)) for f in range(folds)]
    others = [sum((c for g, c in enumerate(known) if g != f or folds == 1), F.lit(0)).cast("long") for f in range(folds)]
    wanted = F.array(*[F.col(f"_{f}").isNotNull() for f in range(folds)])
    levels = [stored(total.select("lang", "code", F.array(*others).alias("n"), wanted.alias("asked")), "ngrams")]
    for k in range(order - 1, 0, -1):
        below = levels[-1].withColumn("code", F.col("code").bitwiseAND(_mask(k))).groupBy("lang", "code").agg(
            F.array(*[F.count_if(F.col("n")[f] > 0) for f in range(folds)]).alias("n"),
            F.array(*[F.bool_or(F.col("asked")[f]) for f in range(folds)]).alias("asked"),
        )
        levels.append(stored(below, "ngrams"))
    return levels[::-1]


def _discounts(level: DataFrame, folds: int) -> DataFrame:
    """(lang, d): for each model the discounts of n-grams seen once, twice and more often."""

    kinds = [F.count_if(F.col("n")[f] == k).alias(f"n{k}_{f}") for f in range(folds) for k in (1, 2, 3, 4)]

    def discounts(f: int) -> Column:
        n = {k: F.col(f"n{k}_{f}") for k in (1, 2, 3, 4)}
        y = F.when(n[1] > 0, n[1] / (n[1] + 2 * n[2])).otherwise(F.lit(0.5))

        def discount(k: int) -> Column:
            # Counts of counts can be empty on little text: then the usual value of each discount holds.
            found = k - (k + 1) * y * n[k + 1] / F.when(n[k] > 0, n[k])
            return F.least(F.greatest(F.coalesce(found, F.lit(k * 0.5)), F.lit(k * 0.1)), F.lit(k * 0.9))

        return F.array(*[discount(k) for k in (1, 2, 3)])

    return _small(level.groupBy("lang").agg(*kinds).select("lang", F.array(*[discounts(f) for f in range(folds)]).alias("d")))


def _contexts(level: DataFrame, k: int, folds: int) -> DataFrame:
    """One row (lang, mid, ctx) per context of order ``k`` with its at most 256 n-grams, their sum and its back-off weight per
    model. Rows are dealt by ``mid``, the bytes between the first and the last one, which are the context one order below."""

    rows = level.withColumn("mid", F.shiftright(F.col("code").bitwiseAND(_mask(k - 1)), 8)).repartition("lang", "mid")
    n = [F.col("n")[f] for f in range(folds)]
    rows = rows.groupBy("lang", "mid", F.shiftright("code", 8).alias("ctx")).agg(
        F.collect_list(F.struct(F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n", "asked")).alias("grams"),
        F.array(*[F.sum(c) for c in n]).alias("total"),
        *[F.array(*[F.count_if(c == j) for c in n]).alias(f"m{j}") for j in (1, 2)],
        F.array(*[F.count_if(c >= 3) for c in n]).alias("m3"),
    )
    rows = rows.join(_discounts(level, folds), "lang")
    taken = [sum((F.col("d")[f][j - 1] * F.col(f"m{j}")[f] for j in (2, 3)), F.col("d")[f][0] * F.col("m1")[f]) for f in range(folds)]
    gamma = [F.when(F.col("total")[f] > 0, taken[f] / F.col("total")[f]) for f in range(folds)]
    return rows.select("lang", "mid", "ctx", "grams", "total", F.array(*gamma).alias("gamma"), "d")


def _interpolated(folds: int, lowest: bool):
    """From an n-gram of a row of :func:`_contexts` to its last byte and its probability under each model that is asked."""

    def of(g: Column, f: int) -> Column:
        n, total = g["n"][f], F.col("total")[f]
        lower = F.lit(1 / 256) if lowest else F.try_element_at("_next", g["byte"])[f]
        share = F.when(n > 0, (n - F.col("d")[f][F.least(n, F.lit(3)).cast("int") - 1]) / total).otherwise(F.lit(0.0))
        return F.when(g["asked"][f], F.when(total > 0, share + F.col("gamma")[f] * lower).otherwise(lower))

    return lambda g: F.struct(g["byte"].alias("byte"), F.array(*[of(g, f) for f in range(folds)]).alias("p"))


def probabilities(asked: DataFrame, order: int = 4, folds: int = 1) -> DataFrame:
    """Distinct n-grams (lang, code, p) of ``asked`` (lang, fold, code, n): ``p`` has a probability for each fold's model, null where
    the fold does not ask for the n-gram.

    An n-gram has its discounted share in its context plus the context's weight times the probability of its suffix, and
    that of its suffix alone where the model has not seen the context. So every order needs one row per context of the
    order below, and no n-gram is looked up more than once an order, however many blocks and models ask for it.
    """

    below = None
    for k, level in enumerate(_levels(asked, order, folds), 1):
        rows = _contexts(level, k, folds)
        if below is not None:
            rows = rows.join(below, ["lang", "mid"])
        grams = F.transform("grams", _interpolated(folds, below is None))
        rows = rows.select("lang", "ctx", grams.alias("grams"))
        below = rows.select("lang", F.col("ctx").alias("mid"), F.map_from_entries("grams").alias("_next"))
    rows = rows.select("lang", "ctx", F.inline("grams"))
    return rows.select("lang", F.shiftleft("ctx", 8).bitwiseOR(F.col("byte").cast("long")).alias("code"), "p")


def quality_classifier(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = 0.995,
    order: int = 4,
    rows_per_block: int = 4096,
    folds: int = 4,
    window: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_bytes, perplexity (per byte), threshold, window_perplexity,
    window_threshold, kept.

    ``trusted`` names the ids whose texts train the models, all of them. A text is scored by the model of its fold, trained on
    the trusted texts of the other ``folds - 1`` folds (``folds=1``: one model of all trusted texts, which has then seen them).
    ``window_perplexity`` is the highest of any ``window`` bytes in a row (of the whole text if it is shorter). A share of
    ``1 - quantile`` of a language's trusted texts may be rejected, half of it by either score: both thresholds are that
    quantile of the trusted texts' scores (an approximate percentile, to a ten-thousandth), and texts above one of them are not kept.

    A language without trusted text has no threshold and loses nothing; where all its trusted texts are in one fold, that fold's
    model is even (perplexity 256). Null text counts as empty; an empty text has perplexity 1. A null language is a language of
    its own. Repeated rows are judged one by one; other columns are ignored.
    """

    def stripe(key: Column) -> Column:
        return F.floor(key / (rows_per_block * folds)).cast("long") * folds

    named = trusted.select(F.col(id_col).cast("long").alias("_trusted")).filter("_trusted is not null").distinct()
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        whole(F.col(text_col)).alias("text"),
    )
    block = stripe(F.coalesce("doc_id", F.xxhash64("text"))) + F.pmod(F.xxhash64("text"), F.lit(folds))
    rows = rows.select(block.alias("block"), "doc_id", "lang", "text")
    packed = rows.mapInArrow(_packed, "block long, payload binary").groupBy("block")
    # An id does not tell its text's fold, so each fold's block of its stripe gets it.
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    sure = named.select(stripe(F.col("_trusted")).alias("stripe"), "_trusted", each.alias("fold"))
    sure = sure.select((F.col("stripe") + F.col("fold")).alias("block"), "_trusted").groupBy("block")
    asked = cut(
        packed.cogroup(sure).applyInArrow(_count(order), "block long, lang string, codes array<long>, counts array<int>")
    )
    asked = asked.select("block", "lang", F.pmod("block", F.lit(folds)).alias("fold"), F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n"))))
    known = probabilities(asked.select("lang", "fold", "code", "n"), order, folds)
    logp = F.log(F.col("p")[F.col("fold").cast("int")]).alias("logp")
    answers = asked.select("block", "lang", "fold", "code").join(known, ["lang", "code"]).select("block", "lang", "code", logp)
    scored = packed.cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, window), "doc_id long, lang string, n_bytes long, log_prob double, window_log_prob double"
    )
    per_byte = F.exp(-F.col("log_prob") / F.greatest("n_bytes", F.lit(1)))
    scored = cut(scored.withColumns({"perplexity": per_byte, "window_perplexity": F.exp(-F.col("window_log_prob"))}))
    scored = scored.join(named, scored["doc_id"] == named["_trusted"], "left").withColumn(
        "trusted", F.col("_trusted").isNotNull()
    )

    def limit(score: str) -> Column:
        return F.percentile_approx(score, F.lit(1 - (1 - quantile) / 2), F.lit(10000))

    limits = _small(
        scored.filter("trusted").groupBy("lang").agg(
            limit("perplexity").alias("threshold"), limit("window_perplexity").alias("window_threshold")
        )
    )
    over = (F.col("perplexity") > F.col("threshold")) | (F.col("window_perplexity") > F.col("window_threshold"))
    return scored.join(limits, "lang", "left").select(
        "doc_id",
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"),
        "n_bytes",
        "perplexity",
        "threshold",
        "window_perplexity",
        "window_threshold",
        (~F.coalesce(over, F.lit(False))).alias("kept"),
    )
