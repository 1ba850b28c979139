"""Candle views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the keys of a tick, not yet parsed."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value", "props")


def priced(raw: DataFrame) -> DataFrame:
    """Raw ticks to candles: price 100 + value, integer volume from the JSON properties."""
    price = F.col("value") + 100
    # a lone whole number is cut out; any other text goes through the parser, which costs ten times as much
    lone = F.nullif(F.regexp_extract("props", r'^\{"k": ?(0|[1-9][0-9]{0,14})\}$', 1), F.lit(""))
    volume = F.coalesce(lone, F.get_json_object("props", "$.k")).cast("double")
    return raw.select(
        "symbol",
        "ts",
        "seq",
        *(price.alias(c) for c in ("Open", "High", "Low", "Close")),
        volume.alias("Volume"),
        (price * volume).alias("volume_usdt"),
        F.lit(1).cast("bigint").alias("trade_count"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event."""
    return priced(raw_ticks(spark, sf_dir))


def ticks_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks as one series: the hot-symbol case."""
    return ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles per return flag: unit prices of shipped lines."""
    li = table(spark, sf_dir, "lineitem")
    tie = F.struct(*(c for c in li.columns if c not in ("l_returnflag", "l_shipdate")))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.withColumn("price", price)
        .withColumn("tie", tie)
        .groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"))
        .agg(
            F.lit(0).cast("bigint").alias("seq"),
            F.min_by("price", "tie").alias("Open"),
            F.max("price").alias("High"),
            F.min("price").alias("Low"),
            F.max_by("price", "tie").alias("Close"),
            F.sum("l_quantity").alias("Volume"),
            F.sum("l_extendedprice").alias("volume_usdt"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a trade of its user."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").cast("string").alias("user"),
            "ts",
            F.col("event_id").alias("trade_id"),
            F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            (F.col("value") + 100).alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("quantity"),
            F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("strategy"),
        )
    )


