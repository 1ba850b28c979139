"""Files, batch job, streams and model layer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import candles, walk
from tidewheel import Timeline
from tidewheel.__main__ import main
from tidewheel.operators import bars, fills, joins, labels, stats
from tidewheel.plans import ml, splits
from tidewheel.sources import klines
from tidewheel.streaming import live


def kline(ms, close):
    return f"{ms},1,2,0.5,{close},10,{ms},100,7,1,1,0"


def test_kline_files(spark, tmp_path):
    (tmp_path / "BTCUSDT-1.csv").write_text("\n".join([kline(1704067200000, 1.5), "broken,line", kline(1704067200000000, 1.6)]))
    (tmp_path / "ETHUSDT-1.csv").write_text(kline(1704067260000, 2.5))
    got = klines.read_klines(spark, str(tmp_path)).orderBy("symbol", "Close").toPandas()
    assert got["symbol"].tolist() == ["BTCUSDT", "BTCUSDT", "ETHUSDT"]
    assert got["ts"].astype(str).tolist() == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:01:00"]
    out = str(tmp_path.parent / "consolidated")
    counts = klines.consolidate(spark, str(tmp_path), out).orderBy("symbol").collect()
    assert [(r.n_rows, r.n_times) for r in counts] == [(2, 1), (1, 1)]
    unique = klines.consolidate(spark, str(tmp_path), out + "-unique", unique=True).orderBy("symbol").collect()
    assert unique[0].n_rows == 1


def test_bar_job(spark, tmp_path):
    f = walk(300, "A")
    path = tmp_path / "c.csv"
    f.rename(columns={"ts": "timestamp", "volume_usdt": "Volume USDT", "trade_count": "tradeCount"}).drop(columns=["symbol", "seq"]).to_csv(path, index=False)
    main([str(path), "volume", "500", "-o", str(tmp_path / "out")])
    got = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    want = bars.volume_bars(Timeline.build(candles(spark, f)), 500)
    assert got.count() == want.count() > 10
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        klines.read_candles(spark, str(tmp_path / "bad.csv"))


def test_predictions_and_log(spark, tmp_path):
    (tmp_path / "p.csv").write_text("timestamp,actual_close,mean,0.1\n2024-01-01 00:00:00+00:00,1,2,3\n2024-01-01T01:00:00Z,1,2,3\n")
    got = klines.read_predictions(spark, str(tmp_path / "p.csv"))
    assert got.columns == ["ts", "actual_close", "mean", "0.1"]
    assert [str(r.ts) for r in got.collect()] == ["2024-01-01 00:00:00", "2024-01-01 01:00:00"]
    row = spark.createDataFrame([(1704067200000, "BUY", 1.0, 2.0, 2.0, "x")], "timestamp bigint, side string, price double, quantity double, value double, strategy string")
    klines.append_transactions(row, str(tmp_path / "log"))
    klines.append_transactions(row, str(tmp_path / "log"))
    log = spark.read.option("header", "true").csv(str(tmp_path / "log"))
    assert log.count() == 2 and log.first()["timestamp"] == "2024-01-01 00:00:00"


def test_join_guards(spark):
    with pytest.raises(ValueError):
        joins.bounded(spark.range(11), 10)
    with pytest.raises(ValueError):
        joins.asof_join(spark.range(1), spark.range(1), direction="nearest")


def test_asof_ties_and_offsets(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("a", 1, 3), ("b", 5, 4)], "symbol string, ts int, id int")
    right = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 3, 3, "w"), ("c", 1, 4, "z")], "symbol string, ts int, k int, v string")
    go = lambda **kw: {r.id: r.v for r in joins.asof_join(left, right, right_cols=["v"], right_tie=["k"], chunk_rows=2, **kw).collect()}
    assert go() == {1: "y", 2: "y", 3: None, 4: None}
    assert go(strict=True) == {1: "w", 2: "y", 3: None, 4: None}
    assert go(direction="forward") == {1: "x", 2: None, 3: "w", 4: None}
    assert go(direction="forward", strict=True) == {1: None, 2: None, 3: "w", 4: None}


def run_stream(spark, tmp_path, f, pieces, made, per_trigger=1):
    """Bars of ``made`` over files written one after the other; the progress of the query comes along."""
    src = str(tmp_path / "in")
    for piece in pieces:
        candles(spark, piece).coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema(candles(spark, f).schema).option("maxFilesPerTrigger", per_trigger).parquet(src)
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = made(raw).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").toPandas(), q.recentProgress


def heartbeat(f, days):
    return f.iloc[-1:].assign(symbol=None, ts=f["ts"].iloc[-1] + pd.Timedelta(days=days))


def test_stream_in_disorder_equals_batch(spark, tmp_path):
    """Rows out of order within and across micro-batches, inside the delay: bars are those of the ordered series."""
    f = pd.concat([walk(400, "A", 8), walk(300, "B", 9)])
    rng = np.random.default_rng(1)
    disorder = f.iloc[np.argsort(f["ts"].to_numpy().astype("datetime64[s]").astype(int) + rng.integers(0, 3000, len(f)))]
    pieces = [disorder.iloc[i : i + 120] for i in range(0, len(f), 120)] + [disorder.iloc[:50], heartbeat(f, 2)]
    got, _ = run_stream(spark, tmp_path, f, pieces, lambda raw: live.threshold_bars(live.candle_stream(raw, "60 minutes"), "Volume", 700, "10 minutes"))
    want = bars.volume_bars(Timeline.build(candles(spark, f)), 700).toPandas().sort_values(["symbol", "bar_id"])
    got = got.sort_values(["symbol", "bar_id"])
    for c in ("symbol", "bar_id", "ts", "Open", "High", "Low", "Close", "Volume", "trade_count"):
        assert got[c].tolist() == want[c].tolist(), c


def test_stream_drops_and_counts_rows_behind_the_watermark(spark, tmp_path):
    f = walk(400, "A", 8)
    old = f.iloc[[3]].assign(seq=9999, Close=1e6, ts=f["ts"].iloc[3] + pd.Timedelta(seconds=1))
    pieces = [f.iloc[:200], f.iloc[200:300], pd.concat([old, f.iloc[300:]]), heartbeat(f, 1)]
    got, progress = run_stream(spark, tmp_path, f, pieces, lambda raw: live.cusum_events(live.candle_stream(raw, "30 minutes"), 6))
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1
    assert 9999 not in set(got["seq"]) and len(got) > 3
    assert (got["ts"] <= f["ts"].iloc[-1]).all()


def test_refit_and_trade_log(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    calls = []
    raw = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)
    live.refit_every(raw, 20, lambda b, n: calls.append(n), str(tmp_path / "cp1")).awaitTermination()
    assert calls == [20, 40]
    spark.range(40, 55).coalesce(1).write.mode("append").parquet(src)
    spark.range(55, 61).coalesce(1).write.mode("append").parquet(src)
    live.refit_every(raw, 20, lambda b, n: calls.append(n), str(tmp_path / "cp1")).awaitTermination()  # started anew
    assert calls == [20, 40, 61]
    live.trade_log(raw, str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 61


@pytest.fixture(scope="module")
def table(spark):
    f = walk(600, "A", 6)
    tl = Timeline.build(candles(spark, f), chunk_rows=200)
    df = labels.direction_target(tl, out="label").df.withColumns(
        {"good": F.col("label") + F.rand(1), "noise": F.rand(2), "t1": F.col("ts") + F.expr("interval 1 minute")}
    )
    return tl.with_df(df).settle()


def test_models(spark, table):
    folds = splits.fold_set(table, 3, "t1", 0.01)
    make = lambda: ml.scaled_pipeline(["good", "noise"], ml.random_forest(trees=5, depth=3))
    pred, scores = ml.cross_validate(folds, make, ["symbol", "ts"])
    assert pred.count() == 600
    report = {r.row: r.support for r in ml.pooled_report(pred).collect()}
    assert report["weighted avg"] == 600
    assert all(r.f1_weighted > 0.9 for r in scores.collect())
    imp = ml.permutation_importance(folds, ["good", "noise"], ml.random_forest(trees=5, depth=3), ["symbol", "ts"]).toPandas().set_index("feature")["importance"]
    assert imp["good"] > 0.1 > abs(imp["noise"])
    f1 = ml.permutation_importance(folds, ["good", "noise"], ml.random_forest(trees=5, depth=3), ["symbol", "ts"], scoring="f1").toPandas().set_index("feature")["importance"]
    assert f1["good"] > 0.1


def sides(folds):
    return sorted((s, r.ts, role) for s in range(len(folds.plan)) for role, df in (("train", folds.train(s)), ("test", folds.test(s))) for r in df.collect())


def test_splits_are_filters_on_rows_written_once(spark, table):
    """Both kinds of split give the rows of the long tables, whatever their number, from one written table."""
    folds = splits.fold_set(table, 4, "t1", 0.02)
    long = splits.purged_folds(table, 4, "t1", 0.02).collect()
    assert sides(folds) == sorted((r.fold, r.ts, r.role) for r in long)
    tl = table.with_df(table.df.withColumn("t1", F.col("ts") + F.expr("interval 45 minutes")))
    for n, k in ((4, 1), (5, 2)):
        got = splits.combinatorial_set(tl.df, n, k, embargo=0.03)
        want = splits.purged_splits(splits.time_groups(tl.df, n), splits.combinatorial_splits(spark, n, k), embargo=0.03).collect()
        assert sides(got) == sorted((r.split, r.ts, r.role) for r in want)
        assert got.rows.count() == 600
        assert {tuple(r) for r in got.sizes().collect()} == {(s, got.train(s).count(), got.test(s).count()) for s in range(len(got.plan))}


def test_components_and_filters(spark, table):
    df = ml.assemble(table.df.withColumn("copy", F.col("good") * 2), ["good", "copy", "noise"])
    out, shares = ml.principal_components(df, 3, 0.99)
    assert len(shares) == 2 and sum(shares) >= 0.99
    assert fills.drop_constant(table.df.withColumn("one", F.lit(1)).select("rn", "one", "good")).columns == ["rn", "good"]
    kept, missing = fills.keep_listed(table.df, ["good", "absent"])
    assert kept.columns == ["good"] and missing == ["absent"]
    assert "Open" not in fills.drop_levels(table.df, ["Open", "unknown"]).columns


def test_report_without_predictions(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "y int, p int")
    rep = stats.classification_report(df.withColumn("k", F.lit(1)), ["k"], "y", "p").toPandas().set_index("row")
    assert rep.loc["1", "precision"] == 1 and rep.loc["1", "recall"] == 0.5
    assert rep.loc["accuracy", "f1"] == pytest.approx(2 / 3)


def test_release_deletes_only_own_tables(spark, tmp_path):
    import os

    from tidewheel import storage

    kept = list(storage._WRITTEN)
    storage._WRITTEN.clear()
    df = storage.materialize(spark.range(3), "probe")
    path = storage._WRITTEN[0]
    assert df.count() == 3 and os.path.exists(path)
    assert storage.release(spark) == 1 and not os.path.exists(path)
    storage._WRITTEN.extend(kept)


def test_large_small_side_is_salted(spark):
    from tidewheel.lookup import attach

    big = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach(big, small, ["k"], limit=10, salts=4)
    assert got.count() == 1000 and got.where("k = 0").agg(F.min("n")).first()[0] == 900
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_no_ordered_window_on_a_bare_key(spark):
    """Windows over rows are keyed by (key, chunk); filters and columns reach the scan."""
    from tidewheel.operators import indicators

    tl = Timeline.build(candles(spark, walk(200, "A")), chunk_rows=50)
    plan = tl.apply(indicators.sma(), indicators.bollinger(), keep=["Close"]).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Volume" not in plan
