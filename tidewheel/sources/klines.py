"""Candle files in, result tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.fills import time_range

C = F.col

# Column order of the header-less exchange candle files.
KLINE_SCHEMA = (
    "unix BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time BIGINT, "
    "volume_usdt DOUBLE, trade_count BIGINT, taker_base DOUBLE, taker_quote DOUBLE, ignore STRING"
)
CANDLE_SCHEMA = "ts TIMESTAMP_NTZ, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE, volume_usdt DOUBLE, trade_count BIGINT"
# Names of the normalised columns in the files the loader accepts.
COLUMN_MAP = {
    "date": "ts", "timestamp": "ts", "open": "Open", "high": "High", "low": "Low", "close": "Close",
    "Volume BTC": "Volume", "volume": "Volume", "Volume USDT": "volume_usdt", "tradeCount": "trade_count",
}


def epoch_time(unix: str = "unix") -> Column:
    """Milliseconds or microseconds since 1970 by digit count, decided per row."""
    micro = F.length(C(unix).cast("string")) > 13
    return F.when(micro, F.timestamp_micros(unix)).otherwise(F.timestamp_millis(unix)).cast("timestamp_ntz")


def kline_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All lines of header-less candle files with their file; ``_bad`` holds the text of lines that do not fit the schema.

    A file that cannot be read at all (such as a broken archive) fails the job.
    """
    raw = spark.read.schema(f"{KLINE_SCHEMA}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return raw.select("*", C("_metadata.file_name").alias("_file"))


def kline_quality(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Good and bad lines per file."""
    bad = C("_bad").isNotNull() | C("unix").isNull()
    return kline_lines(spark, path).groupBy(C("_file").alias("file")).agg(
        F.count(F.when(~bad, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_bad")
    )


def read_klines(spark: SparkSession, path: str | Sequence[str], symbol: str | None = None) -> DataFrame:
    """Header-less candle files; lines that do not fit the schema are left out, ``kline_quality`` counts them."""
    raw = kline_lines(spark, path).where(C("_bad").isNull()).withColumnRenamed("_file", "_name")
    named = F.lit(symbol) if symbol else F.regexp_extract("_name", "^([A-Za-z0-9]+)", 1)
    return raw.where(C("unix").isNotNull()).select(
        named.alias("symbol"),
        epoch_time().alias("ts"),
        C("unix").alias("seq"),
        *(C(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")),
        "volume_usdt",
        "trade_count",
    )


def consolidate(spark: SparkSession, path: str, out: str, symbol: str | None = None, unique: bool = False) -> DataFrame:
    """Candle files to one table partitioned by symbol and day, sorted inside each file.

    Returns row and distinct-time counts per symbol.  The table lies outside the
    input folder, so it is never read as input.  ``unique`` drops repeated times.
    """
    rows = read_klines(spark, path, symbol)
    if unique:
        rows = rows.dropDuplicates(["symbol", "ts"])
    (
        rows.withColumn("date", F.to_date("ts"))
        .repartition("symbol", "date").sortWithinPartitions("symbol", "date", "ts", "seq")
        .write.mode("errorifexists").partitionBy("symbol", "date").parquet(out)
    )
    back = spark.read.parquet(out)
    return back.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ts").alias("n_times")
    )


def read_candles(spark: SparkSession, path: str, start=None, end=None, fmt: str = "csv", symbol: str = "BTCUSDT") -> DataFrame:
    """Candle table with a header (or Parquet), renamed to the engine schema and cut to a time range."""
    if fmt == "csv":
        names = spark.read.option("header", "true").csv(path).columns
        types = {c: t for c, t in (x.strip().split(" ") for x in CANDLE_SCHEMA.split(","))}
        fields = ", ".join(f"`{n}` {types.get(COLUMN_MAP.get(n, n), 'STRING')}" for n in names)
        df = spark.read.option("header", "true").schema(fields).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    # a consolidated table has its times and, beside them, the day as a folder
    df = df.withColumnsRenamed({k: v for k, v in COLUMN_MAP.items() if k in df.columns and v not in df.columns})
    if "ts" not in df.columns:
        raise ValueError(f"no time column among {df.columns}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol))
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.unix_micros(C("ts").cast("timestamp")))
    return time_range(df, start, end)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction log with a header; the time loses its zone."""
    df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    other = [c for c in df.columns if c != "timestamp"]
    text = F.regexp_replace("timestamp", r"(Z|[+-]\d\d:?\d\d)$", "")
    return df.select(text.cast("timestamp_ntz").alias("ts"), *(C(f"`{c}`").cast("double").alias(c) for c in other))


def profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time, rows and number of columns."""
    return df.agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
    )


def transaction_rows(df: DataFrame, epoch_ms: str = "timestamp") -> DataFrame:
    """Trade rows with the time as text, in log order of columns."""
    text = F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss")
    return df.select(text.alias("timestamp"), "side", "price", "quantity", "value", "strategy")


def append_transactions(df: DataFrame, path: str) -> None:
    transaction_rows(df).write.mode("append").option("header", "true").csv(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("errorifexists").partitionBy(*partition_by) if partition_by else df.write.mode("errorifexists")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path))
