"""Repeated lines: every line whose normalised form occurs in several documents goes, but for the first document that has it.

Lines are exploded with their position, normalised and hashed (128 bits) once, into a narrow written table.  Documents
per hash are counted by a pre-aggregated grouping, so a line that every document has is one row per task.  Its
occurrences find the verdict by a broadcast of the hottest hashes (at most ``HOT`` of them, by construction) and by an
equi-join for all others.  Texts meet only the positions that they lose and are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm.native import ascii_lower

#: fixed: what a line loses at both ends
SPACE = " \t\n\x0b\x0c\r"
HOT = 10_000


def hashed_lines(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """One row per line of at least ``least_chars`` characters: document, text hash, position and hash of its key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = lines.select("id", "body", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key"))
    key = key.where(F.char_length("key") >= least_chars)
    return key.select("id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """Hashes found in at least ``least_docs`` documents: h1, h2, the first document (as a struct) and the number of lines."""
    doc = F.struct("id")  # a null id is a document before all others
    if least_docs == 2:  # two documents differ exactly if the first is not the last: no distinct needed
        found = lines.groupBy("h1", "h2").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.count("*").alias("n"))
        return found.where("first < last").drop("last")
    each = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    found = each.groupBy("h1", "h2").agg(F.min(doc).alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n"))
    return found.where(F.col("docs") >= least_docs).drop("docs")


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, body, gone): the positions that a text of a document loses."""
    total = repeated.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") * HOT > total  # each has over 1/HOT of the lines, so there are fewer than HOT of them
    keeper = repeated.select("h1", "h2", "first", hot.alias("hot"))
    common = lines.join(F.broadcast(keeper.where("hot")), ["h1", "h2"], "left")
    lost = F.struct("id") > F.col("first")
    by_hot = common.where(F.col("hot") & lost)
    by_rest = common.where("hot IS NULL").drop("first", "hot").join(keeper.where("NOT hot"), ["h1", "h2"]).where(lost)
    gone = by_hot.select("id", "body", "pos").unionByName(by_rest.select("id", "body", "pos"))
    return gone.groupBy("id", "body").agg(F.collect_set("pos").alias("gone"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """Per row of ``df``: its id, n_lines, n_dropped and ``kept``, the remaining lines joined again.

    A line's key is the line without white space at both ends and with A-Z in lower case.  Keys of at least
    ``least_chars`` characters that at least ``least_docs`` documents hold stay only in the document with the smallest
    id, there with all their lines.  Null and empty texts are one empty line.  Rows with equal ids are one document: they
    keep or lose a line together, and equal rows give equal rows.  A null id is the smallest document.  Texts of any length
    are whole rows; other columns are not read.  An empty table gives an empty table.
    """
    lines = storage.materialize(hashed_lines(df, id_col, text_col, least_chars), "lines")
    gone = dropped_positions(lines, storage.materialize(repeated_keys(lines, least_docs), "repeated-lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_body"))
    met = rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_body") == F.col("body")), "left")
    split = F.split("_text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    again = F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n")
    met = met.withColumn("_lines", F.when(F.col("gone").isNotNull(), split))
    return met.select(
        F.col("_id").alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("_text")).otherwise(again).alias("kept"),
    )
