import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(n, symbol="A", seed=42, nulls=0.0):
    """Seeded random-walk candles."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(np.round(rng.normal(0, 1, n), 2))
    close = np.abs(close) + 10
    op = np.concatenate(([close[0]], close[:-1]))
    high = np.maximum(op, close) + np.round(rng.random(n), 2)
    low = np.minimum(op, close) - np.round(rng.random(n), 2)
    vol = rng.integers(0, 100, n).astype(float)
    pdf = pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"),
            "seq": np.arange(n),
            "Open": op,
            "High": high,
            "Low": low,
            "Close": close,
            "Volume": vol,
            "volume_usdt": close * vol,
            "trade_count": 1,
        }
    )
    if nulls:
        pdf.loc[rng.random(n) < nulls, "Close"] = np.nan
    return pdf


SCHEMA = (
    "symbol string, ts timestamp_ntz, seq bigint, Open double, High double, Low double, "
    "Close double, Volume double, volume_usdt double, trade_count bigint"
)


def candles(spark, *frames):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True), SCHEMA)
