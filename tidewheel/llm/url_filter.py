"""URL filters: expand every URL into host-suffix and path-prefix expressions and equi-join them with the rules.

The join key is a short hash prefix; the full digest is compared afterwards, then the longest rule wins.  Path
prefixes are cut at the lengths that rule paths have.  Rules up to ``broadcast_rules`` are broadcast; a larger list is
joined by a shuffle with every rule repeated ``SALTS`` times, so a host that holds a third of all pages is spread.
Everything runs on built-in functions, and only the URL column is read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import native

SALTS = 16
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return native.ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_frame(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _key(expression: Column) -> Column:
    return F.substring(F.sha2(expression, 256), 1, PREFIX_HEX)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """One row per page: id, host, path, rule (host and path, null if none fits) and verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's path.  The longest rule (host and
    path together, then host) wins; of equal rules with different verdicts ``block`` does.  Null URLs and texts without
    ``://`` have an empty host and path and get the default.  Repeated pages are judged one by one.
    """
    # the separator \0 keeps "a.b" + "/c" apart from other ways to cut the same text
    known = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    known = known.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "rule_verdict", F.sha2(F.concat_ws("\0", "host", "path"), 256).alias("digest"), _key(F.concat_ws("\0", "host", "path")).alias("key"), F.length("path").alias("cut"))
    cuts = F.array(*(F.lit(r["cut"]) for r in known.select("cut").distinct().orderBy("cut").collect())).cast("array<int>")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("tag", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\0"), p))))
    each = rows.withColumn("expression", F.explode_outer(F.array_distinct(expressions))).withColumn("key", _key(F.col("expression")))
    if known.limit(broadcast_rules + 1).count() <= broadcast_rules:
        met = each.join(F.broadcast(known), "key", "left")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod("tag", F.lit(SALTS)).cast("int")).join(known, ["key", "salt"], "left")
    fits = F.col("digest") == F.sha2(F.col("expression"), 256)
    rank = F.when(fits, F.struct(F.length("rule").alias("n"), "host_length", "rule", "rule_verdict"))
    best = met.groupBy("tag", "id", "host", "path").agg(F.max(rank).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
