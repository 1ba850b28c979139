"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed: words are runs of digits, lower-case ASCII letters and everything outside ASCII; this matches what lies between
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII takes the built-in, which does the same there."""
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(letters)


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def starts(n: Column, length: int) -> Column:
    """1, 2, … up to the last place where ``length`` words begin; empty if there is none."""
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def once(df: DataFrame, value: Column | str, name: str) -> DataFrame:
    """``df`` with a column that is computed once per row: a generator keeps the optimizer from copying it into lambdas."""
    return df.select("*", F.inline(F.array(F.struct((F.col(value) if isinstance(value, str) else value).alias(name)))))
