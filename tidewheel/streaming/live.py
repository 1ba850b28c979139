"""Streaming twins of the batch operators.

Each is an ordered fold (see :mod:`tidewheel.streaming.ordered`): rows count in (ts, seq) order once the watermark has
passed them, whatever the order of their arrival inside the delay.  Rows behind the watermark are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.streaming.ordered import keep_state_on_disk, ordered_fold

C = F.col
WARM_UP = 35


def candle_stream(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Watermarked candles without repeated (symbol, ts, seq); a row without a symbol is a heartbeat that only moves the watermark."""
    keep_state_on_disk(raw.sparkSession)
    stream = raw.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", delay)
    return stream.dropDuplicatesWithinWatermark(["symbol", "ts", "seq"])


def time_bars(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling bars, emitted when the watermark passes their end."""
    at = F.struct("ts", "seq")
    return (
        stream.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("Open", at).alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"),
            F.max_by("Close", at).alias("Close"), F.sum("Volume").alias("Volume"),
            F.sum("volume_usdt").alias("volume_usdt"), F.sum("trade_count").alias("trade_count"),
        )
        # naming the window keeps the filter above the watermark, which heartbeats must reach
        .where(C("symbol").isNotNull() | C("w.start").isNull())
        .select("symbol", C("w.start").alias("bucket"), "Open", "High", "Low", "Close", "Volume", "volume_usdt", "trade_count")
    )


def threshold_bars(stream: DataFrame, metric: str, threshold: float, bucket: str = "1 minute") -> DataFrame:
    """Volume (``Volume``), dollar (``volume_usdt``) or price-change (``change``) bars as they close."""
    if metric not in ("Volume", "volume_usdt", "change"):
        raise ValueError(f"unknown metric: {metric}")
    out = "symbol string, us bigint, seq bigint, kind string, bar_id bigint, Open double, High double, Low double, Close double, Volume double, volume_usdt double, trade_count bigint"
    state = "bar_id bigint, n bigint, acc double, o double, h double, l double, v double, u double, t bigint, prev double"

    def step(r, s):
        bar, n, acc, o, h, lo, v, u, t, prev = s
        x = (abs(r.Close / prev - 1) if prev else 0.0) if metric == "change" else getattr(r, metric)
        o = r.Open if n == 0 else o
        h = r.High if n == 0 else max(h, r.High)
        lo = r.Low if n == 0 else min(lo, r.Low)
        v, u, t = v + r.Volume, u + r.volume_usdt, t + int(r.trade_count)
        n, acc, prev, made = n + 1, acc + x, r.Close, []
        if acc >= threshold:
            made = [dict(us=r.us, seq=r.seq, kind="bar", bar_id=bar, Open=o, High=h, Low=lo, Close=r.Close, Volume=v, volume_usdt=u, trade_count=t)]
            bar, n, acc, o, h, lo, v, u, t = bar + 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
        return [bar, n, acc, o, h, lo, v, u, t, prev], made

    return ordered_fold(stream, (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0), state, out, step, bucket)


def imbalance_bars(stream: DataFrame, initial_bar_size: float, span_bar_size: int = 20, span_sign: int = 20, bucket: str = "1 minute") -> DataFrame:
    """Closing rows of tick imbalance bars with the moving bar-size threshold."""
    out = "symbol string, us bigint, seq bigint, kind string, threshold double, cum_imbalance double, size bigint"
    state = "n bigint, cum double, mean_size double, mean_sign double, sign double, prev double, seen bigint"
    a, b = 2 / (span_bar_size + 1), 2 / (span_sign + 1)

    def step(r, s):
        n, cum, size, mean, sign, prev, seen = s
        if seen and r.Close != prev:
            sign = 1.0 if r.Close > prev else -1.0
        mean = (1 - b) * mean + b * sign if seen else sign
        n, cum, made = n + 1, cum + sign, []
        theta = abs(size * mean)
        if theta > 0 and abs(cum) >= theta:
            made = [dict(us=r.us, seq=r.seq, kind="bar", threshold=theta, cum_imbalance=cum, size=n)]
            size, n, cum = (1 - a) * size + a * n, 0, 0.0
        return [n, cum, size, mean, sign, r.Close, 1], made

    return ordered_fold(stream, (0, 0.0, float(initial_bar_size), 0.0, 1.0, 0.0, 0), state, out, step, bucket)


def cusum_events(stream: DataFrame, h: float, bucket: str = "1 minute") -> DataFrame:
    """Rows where the two-sided sum around the running mean passes ``h``."""
    out = "symbol string, us bigint, seq bigint, kind string"
    state = "n bigint, total double, up double, down double"

    def step(r, s):
        n, total, up, down = s
        n, total = n + 1, total + r.Close
        x = r.Close - total / n
        up, down = max(0.0, up + x), min(0.0, down + x)
        if up >= h or down <= -h:
            return [n, total, 0.0, 0.0], [dict(us=r.us, seq=r.seq, kind="event")]
        return [n, total, up, down], []

    return ordered_fold(stream, (0, 0.0, 0.0, 0.0), state, out, step, bucket)


def macd_signals(stream: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, warm_up: int = WARM_UP, bucket: str = "1 minute") -> DataFrame:
    """BUY / SELL / HOLD per candle after the warm-up rows."""
    out = "symbol string, us bigint, seq bigint, kind string, macd double, macd_signal double, action string"
    state = "n bigint, f double, s double, sig double, line double"
    af, as_, ag = (2 / (k + 1) for k in (fast, slow, signal))

    def step(r, st):
        n, f, s, sig, line = st
        before = line - sig
        f = r.Close if n == 0 else (1 - af) * f + af * r.Close
        s = r.Close if n == 0 else (1 - as_) * s + as_ * r.Close
        line = f - s
        sig = line if n == 0 else (1 - ag) * sig + ag * line
        n += 1
        if n < warm_up:
            return [n, f, s, sig, line], []
        now = line - sig
        action = "BUY" if now > 0 >= before else "SELL" if now < 0 <= before else "HOLD"
        return [n, f, s, sig, line], [dict(us=r.us, seq=r.seq, kind="signal", macd=line, macd_signal=sig, action=action)]

    return ordered_fold(stream, (0, 0.0, 0.0, 0.0, 0.0), state, out, step, bucket)


def trade_log(stream: DataFrame, path: str, checkpoint: str):
    """Append trades to files with a checkpoint (exactly once)."""
    return (
        stream.writeStream.format("csv").outputMode("append").option("header", "true")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def refit_every(stream: DataFrame, rows: int, refit: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``refit(batch, rows seen)`` in the micro-batches in which the row count passes a multiple of ``rows``.

    The stream resumes at its checkpoint after a restart.  The row count after each
    micro-batch is a table beside the checkpoint, so a restart or a repeated batch
    keeps the cadence.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark, n = batch.sparkSession, batch.count()
        before = spark.read.schema("n bigint").parquet(f"{checkpoint}-rows/{epoch - 1}").head()["n"] if epoch else 0
        spark.range(1).select(F.lit(before + n).cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{checkpoint}-rows/{epoch}")
        if before // rows != (before + n) // rows:
            refit(batch, before + n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
