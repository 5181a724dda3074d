"""Exact deduplication by skew-safe combining.

Equal texts are combined three times, and each time the grouping key holds the whole normalised text beside its digest,
so a digest collision never merges two texts:

1. locally: the map-side half of the first aggregation keeps one row per text and task, so a text that fills a third of
   the table leaves each task once;
2. by (digest, salt, text): the salt comes from the id, so the local winners of one hot text meet in ``salts`` tasks;
3. globally by (digest, text): at most ``salts`` winners per text are left.

What comes back per document needs only the digest. Texts are compared again where one digest has several texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt.llm.common import SPACE_RUN, fresh, whole
from classtilt.session import cut

DECISION = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = F.regexp_replace(whole(F.col(text_col)), SPACE_RUN, " ")
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    return rows.withColumn("_digest", digest(F.col("_norm")))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: _digest, _norm, _keep, _n."""

    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_norm").agg(
        F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    return salted.groupBy("_digest", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def _winners(rows: DataFrame, salts: int) -> tuple[DataFrame, bool]:
    """Per text: _digest, _text, _keep, _n; _text is null where the digest has one text. And whether any has several."""

    groups = _groups(rows, salts)
    per_digest = cut(
        groups.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"), F.sum("_n").alias("_n")
        )
    )
    single = per_digest.filter("_texts = 1").select("_digest", F.lit(None).cast("string").alias("_text"), "_keep", "_n")
    several = per_digest.filter("_texts > 1").select("_digest")
    if several.isEmpty():
        return single, False
    apart = groups.join(several, "_digest").select("_digest", F.col("_norm").alias("_text"), "_keep", "_n")
    return single.unionByName(apart), True


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. The smallest id
    of a group stays. Rows that share id and text cannot be told apart: all of them carry the same mark, and
    :func:`drop_copies` leaves one of them. A null id stays only in a group without any id; then keep_id is null. An
    empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """

    rows = _keyed(docs, id_col, text_col, digest)
    winners, collided = _winners(rows, salts)
    whole_text = collided or digest is not sha256_hex
    # A hot digest may fill one partition of the join: rows are a few bytes here, and Spark splits it at run time.
    side = rows if whole_text else rows.drop("_norm")
    match = side["_digest"] == winners["_digest"]
    if collided:
        match &= winners["_text"].isNull() | (winners["_text"] == side["_norm"])
    sha = sha256_hex(F.col("_norm")) if whole_text else side["_digest"]
    return side.join(winners, match, "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        sha.alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that share id and text, one stays.

    The join is dealt by (digest, id), so a hot text does not meet in one task. Both stand in one struct: null ids match
    each other there, and what is left of repeated rows is found without dealing the texts out again.
    """

    norm = F.regexp_replace(whole(F.col(text_col)), SPACE_RUN, " ")
    winners, collided = _winners(_keyed(docs, id_col, text_col, sha256_hex), salts)
    stays, key = fresh(docs, "_stays_"), fresh(docs, "_key_")
    winners = winners.select("*", F.struct("_digest", "_keep").alias(stays))
    rows = docs.withColumn(key, F.struct(sha256_hex(norm).alias("_digest"), F.col(id_col).alias("_keep")))
    match = rows[key] == winners[stays]
    if collided:
        match &= winners["_text"].isNull() | (winners["_text"] == norm)
    kept = rows.join(winners, match, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
