"""Identity scans, redaction and path rules over text and path tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classtilt import rules



def txt_identity_scan(df: DataFrame, id: str, text: str, terms: Sequence[str] = ()) -> DataFrame:
    """``DF[id, kind]``: e-mail, local path, revision or forbidden term; terms ignore case."""

    body = F.col(text)
    low = F.lower(body)
    kinds = [
        F.when(_may_have_email(body) & body.rlike(rules.EMAIL), "email"),
        F.when(_may_have_path(body) & body.rlike(rules.LOCAL_PATH), "local_path"),
        F.when(body.rlike(rules.REVISION), "revision"),
    ]
    kinds += [F.when(F.contains(low, F.lit(t.lower())), f"term:{t}") for t in terms if t]
    return df.select(id, F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def _may_have_email(body: Column) -> Column:
    return F.contains(body, F.lit("@"))


def _may_have_path(body: Column) -> Column:
    low = F.lower(body)
    return F.contains(low, F.lit("/home/")) | F.contains(low, F.lit("users"))


def redacted(body: Column) -> Column:
    """Local paths first, then revisions, then e-mail addresses.

    A plain substring test keeps the costly patterns off the many texts that cannot match.
    """

    out = F.when(_may_have_path(body), F.regexp_replace(body, rules.LOCAL_PATH, "<local-path>")).otherwise(body)
    out = F.regexp_replace(out, rules.REVISION, "<revision>")
    return F.when(_may_have_email(body), F.regexp_replace(out, rules.EMAIL, "<email>")).otherwise(out)


def _count(body: Column, pattern: str, possible: Column) -> Column:
    n = F.regexp_count(body, F.lit(pattern)).cast("bigint")
    return F.when(body.isNotNull(), F.when(possible, n).otherwise(F.lit(0).cast("bigint")))


def txt_redact(df: DataFrame, text: str) -> DataFrame:
    """Replaces identifying text in place and adds the number of replacements per kind.

    Counts are taken from the original text, so one span can count under two kinds.
    """

    body = F.col(text)
    return df.withColumns(
        {
            "local_paths": _count(body, rules.LOCAL_PATH, _may_have_path(body)),
            "revisions": _count(body, rules.REVISION, F.lit(True)),
            "emails": _count(body, rules.EMAIL, _may_have_email(body)),
            text: redacted(body),
        }
    )


def txt_json_redact(df: DataFrame, col: str, names: Sequence[str] = rules.REVISION_FIELDS) -> DataFrame:
    """Sets the listed keys to null at any depth of a JSON text, whatever their value: scalar, object or array.

    All other text stays as it was written. Texts without such a key skip Python; where the value after a key is not
    JSON, everything after the key is dropped, for a redaction must not leak.
    """

    key = re.compile(rf'(?i)(?<!\\)"(?:{"|".join(names)})"\s*:\s*')

    @F.pandas_udf("string")
    def nulled(bodies: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder(strict=False)

        def one(body: str) -> str:
            out, at = [], 0
            while found := key.search(body, at):
                out += [body[at : found.end()], "null"]
                try:
                    at = decoder.raw_decode(body, found.end())[1]
                except ValueError:
                    at = len(body)
            return "".join(out) + body[at:]

        return bodies.map(one, na_action="ignore")

    listed = F.col(col).rlike(rf'(?i)"(?:{"|".join(names)})"\s*:')
    return df.withColumn(col, F.when(listed, nulled(F.when(listed, F.col(col)))).otherwise(F.col(col)))


def txt_hash_rebind(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``DF[.., path, sha256]`` with the digest of the mapping where the path is listed there."""

    new = mapping.select("path", F.col("sha256").alias("_new"))
    return refs.join(new, "path", "left").withColumn("sha256", F.coalesce("_new", "sha256")).drop("_new")


def prov_set_digest(df: DataFrame, path: str) -> DataFrame:
    """``DF[paths, digest]`` of the sorted, NUL-joined distinct path list.

    The digest is defined on one byte string, so this is for file lists; ``acc_table_digest`` serves tables.
    """

    listed = df.select(path).distinct().agg(F.array_sort(F.collect_list(path)).alias("_p"))
    return listed.select(
        F.size("_p").cast("bigint").alias("paths"), F.sha2(F.array_join("_p", "\x00"), 256).alias("digest")
    )


def prov_generated_paths(df: DataFrame, path: str) -> DataFrame:
    """Paths below generated prefixes that are neither placeholders nor on the allow-list."""

    generated = F.lit(False)
    for prefix in rules.GENERATED_PREFIXES:
        generated = generated | F.col(path).startswith(prefix)
    allowed = F.col(path).endswith(".gitkeep") | F.col(path).isin(*rules.TRACKED_PROVENANCE)
    return df.filter(generated & ~allowed)


def prov_path_rules(df: DataFrame, path: str) -> DataFrame:
    """``DF[path, problem]``: unsafe names and names that differ only by case."""

    p = F.col(path)
    unsafe = (
        F.when(p == "", "empty")
        .when(F.contains(p, F.lit("\\")), "backslash")
        .when(p.startswith("/"), "absolute")
        .when(p.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(F.split(p, "/"), lambda s: s.isin("", ".", "..")), "empty or dot segment")
    )
    # Copies are counted per lower-cased name with a combiner; only names that collide are joined back.
    clashing = (
        df.groupBy(F.lower(p).alias("_low")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_low")
    )
    collisions = (
        df.withColumn("_low", F.lower(p))
        .join(clashing, "_low", "left_semi")
        .select(path, F.lit("duplicate or case collision").alias("problem"))
    )
    return df.select(path, unsafe.alias("problem")).filter(F.col("problem").isNotNull()).unionByName(collisions)


def prov_member_digest(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Member list and digests against the manifest: ``DF[name, problem]``."""

    left = members.select("name", F.col("sha256").alias("_have"))
    right = manifest.select("name", F.col("sha256").alias("_want"))
    problem = (
        F.when(F.col("_have").isNull(), "listed but missing")
        .when(F.col("_want").isNull(), "present but not listed")
        .when(F.lower("_have") != F.lower("_want"), "digest mismatch")
    )
    return left.join(right, "name", "full").select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())
