"""Batch job: candle file to bars.

    spark-submit -m tidewheel INPUT {volume,dollar,price_change} THRESHOLD [-o OUTPUT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewheel.operators import bars
from tidewheel.sources.klines import read_candles, write_result
from tidewheel.timeline import Timeline

KINDS = {
    "volume": bars.volume_bars,
    "dollar": bars.dollar_bars,
    "price_change": bars.price_change_bars,
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Aggregate a candle table into bars.")
    p.add_argument("input")
    p.add_argument("bar_type", choices=sorted(KINDS))
    p.add_argument("threshold", type=float)
    p.add_argument("-o", "--output", help="folder for the result; the first rows are printed without it")
    p.add_argument("--format", default="csv")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewheel-bars").getOrCreate()
    made = KINDS[a.bar_type](Timeline.build(read_candles(spark, a.input, fmt=a.format)), a.threshold)
    if a.output:
        write_result(made.drop("bar_id"), a.output, "csv")
    else:
        made.orderBy("symbol", "ts").show(50, truncate=False)


if __name__ == "__main__":
    main()
