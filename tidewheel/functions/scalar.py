"""Small column functions: names, sampling plans, rows since refit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_name(name: Column) -> Column:
    """Drop characters a metric store refuses."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-.\s:/]", "")


def config_name(**parts: Column) -> Column:
    """name_value pairs joined by underscores."""
    return F.concat_ws("_", *(x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))))


def chunks_for_coverage(total: Column, chunk: int, percent: float = 20.0) -> Column:
    """Chunks needed to cover a share of the rows."""
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    return F.ceil(total * F.lit(percent / 100.0) / chunk)


def rows_since_refit(rn: Column, every: int) -> Column:
    return (rn - 1) % every


def as_json(**parts: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
