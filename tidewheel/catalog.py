"""Named queries over the test tables, each next to the SQL it must agree with.

All read whole tables.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources import views
from tidewheel.timeline import Timeline

C = F.col
CHUNK_ROWS = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ Spark side
def ticks(spark, sf) -> Timeline:
    return Timeline.build(views.raw_ticks(spark, sf), chunk_rows=CHUNK_ROWS, derive=views.priced)


def one(spark, sf) -> Timeline:
    raw = views.raw_ticks(spark, sf).withColumn("symbol", F.lit("ALL"))
    return Timeline.build(raw, chunk_rows=CHUNK_ROWS, derive=views.priced)


def daily(spark, sf) -> Timeline:
    return Timeline.build(views.bars_daily(spark, sf), chunk_rows=CHUNK_ROWS)


def six_places(x):
    """Same double arithmetic as the SQL side; the border lies off all short fractions, so no tie can differ."""
    return F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.50037)) / F.lit(1e6)


def shape(df: DataFrame | Timeline, keys: Sequence[str] = ("symbol", "seq"), d: Sequence[str] = (), i: Sequence[str] = ()) -> DataFrame:
    """Keys, rounded doubles and big integers under lower-case names."""
    df = df.df if isinstance(df, Timeline) else df
    return df.select(
        *(C(k).alias(k.lower()) for k in keys),
        *(six_places(C(c)).alias(c.lower()) for c in d),
        *(C(c).cast("bigint").alias(c.lower()) for c in i),
    )


# ------------------------------------------------------------------ SQL side
_PRICE = "100 + value"
TICKS = f"""ticks AS MATERIALIZED (
  SELECT event_type AS symbol, ts, event_id AS seq, {_PRICE} AS open, {_PRICE} AS high, {_PRICE} AS low, {_PRICE} AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         ({_PRICE}) * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume_usdt, 1 AS trade_count,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events)"""
ONE = TICKS.replace("event_type AS symbol", "'ALL' AS symbol").replace("PARTITION BY event_type ", "")
_TIE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus"
DAILY = f"""bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (
  SELECT l_returnflag AS symbol, l_shipdate AS ts, 0 AS seq,
         first(l_extendedprice / l_quantity ORDER BY {_TIE}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_TIE}) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS volume_usdt, count(*) AS trade_count
  FROM lineitem GROUP BY 1, 2))"""

PART = "PARTITION BY symbol ORDER BY rn"


def over(n: int) -> str:
    return f"OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER ({PART}))"


def lead(x: str, k: int = 1) -> str:
    return f"(lead({x}, {k}) OVER ({PART}))"


def nz(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 1e-9 ELSE ({x}) END)"


def final(body: str, ctes: Sequence[str] = (TICKS,), keys=("symbol", "seq"), d=(), i=()) -> str:
    cols = [
        *keys,
        *(f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.50037) / 1e6 AS {c}" for c in d),
        *(f"CAST({c} AS BIGINT) AS {c}" for c in i),
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {', '.join(cols)} FROM ({body}) AS q"


def recursion(name: str, base: str, first: dict[str, str], step: dict[str, str]) -> str:
    """One row of ``base`` (b) after the other, state columns from the row before (e)."""
    f = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in first.items())
    s = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in step.items())
    return f"""{name} AS (
  SELECT b.symbol, b.rn, {f} FROM {base} b WHERE b.rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {s} FROM {name} e JOIN {base} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


def ema(prev: str, x: str, span: float) -> str:
    a = 2.0 / (span + 1.0)
    return f"({1 - a!r} * {prev} + {a!r} * {x})"


def load() -> None:
    """Import the modules that register queries."""
    from tidewheel import catalog_bars, catalog_indicators, catalog_labels, catalog_models, catalog_stats  # noqa: F401
