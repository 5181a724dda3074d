"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

Only DataFrame functions are used. Hosts are never a join key by themselves: a url contributes one short hash per
expression, and the rules' side is broadcast only where Spark finds it under its size limit; beyond that both sides are
dealt by (hash prefix, salt), so a host with a third of all urls spreads over ``salts`` tasks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hex digits of the hash that are joined on: 32 bits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://`` or url."""

    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def url_filters(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    salts: int = 8,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains of it if the url's path starts with the
    rule's path. The longest rule wins; of equally long ones that with the longer host, then a block. Urls without a
    fitting rule, empty and null urls get ``default`` and a null rule. Repeated rows are judged one by one.

    The lengths of the rules' paths go to the driver: distinct lengths only, so no more than the longest url has
    characters. Paths of other lengths cannot fit and are not expanded.
    """

    known = rules.select(
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("_rule"),
        F.char_length(F.coalesce("host", F.lit(""))).alias("_host_chars"),
        F.char_length(F.coalesce("path", F.lit(""))).alias("_path_chars"),
        F.col("verdict").alias("_verdict"),
    ).filter("_host_chars > 0")
    lengths = sorted(r[0] for r in known.select("_path_chars").distinct().collect())
    digest = F.sha2(F.col("_rule"), 256)
    known = known.select(
        "_rule", "_host_chars", "_verdict", digest.alias("_full"), F.substring(digest, 1, PREFIX).alias("_short")
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")
    )
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    fitting = F.filter(
        F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path")
    )
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.when(
        F.col("host") != "",
        F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256)))),
    )
    asked = rows.select("_row", "page_id", "host", "path", F.explode_outer(expressions).alias("_asked")).withColumn(
        "_short", F.substring("_asked", 1, PREFIX)
    )
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    found = asked.join(known, ["_short", "_salt"], "left")
    ranked = F.when(
        F.col("_asked") == F.col("_full"),
        F.struct(
            F.char_length("_rule").alias("chars"),
            F.col("_host_chars").alias("host_chars"),
            (F.col("_verdict") == "block").alias("blocks"),
            F.col("_rule").alias("rule"),
            F.col("_verdict").alias("verdict"),
        ),
    )
    best = found.groupBy("_row", "page_id", "host", "path").agg(F.max(ranked).alias("_best"))
    return best.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
