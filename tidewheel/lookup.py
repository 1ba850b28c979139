"""Joining large tables with small ones, safe for hot keys and large 'small' sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.storage import materialize

MAX_BROADCAST_ROWS = 100_000
SALTS = 64


def bounded(small: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side after counting it; larger sides are refused."""
    if small.limit(limit + 1).count() > limit:
        raise ValueError(f"side has more than {limit} rows; it may not be broadcast")
    return F.broadcast(small)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], limit: int = MAX_BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Inner join with a table of few rows per key.

    The small side is written once and counted.  Up to ``limit`` rows it is
    broadcast.  Beyond that it is repeated per salt and the large side is spread
    by a hash of its row, so one hot key is shared by ``salts`` tasks.
    """
    small = materialize(small, "lookup")
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(small), list(keys))
    hashed = [c for c, t in df.dtypes if not t.startswith("map")]
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"]).drop("_salt")
