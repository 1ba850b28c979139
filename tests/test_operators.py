"""Independent pandas / NumPy oracles for operators without SQL, edge rules and chunk invariance."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, candles, walk
from tidewheel import Timeline
from tidewheel.catalog import roll
from tidewheel.functions import rolling as R
from tidewheel.functions import tails
from tidewheel.operators import features, fills, fracdiff, indicators, labels, recursive, signals, stats, volatility, weights
from tidewheel.plans import overfit, splits
from tidewheel.timeline import Recipe

N = 700


@pytest.fixture(scope="module")
def frame():
    return walk(N, "A", 5)


@pytest.fixture(scope="module")
def small(spark, frame):
    """Small chunks: every operator crosses borders."""
    return Timeline.build(candles(spark, frame), chunk_rows=150)


@pytest.fixture(scope="module")
def whole(spark, frame):
    return Timeline.build(candles(spark, frame), chunk_rows=1_000_000)


def rows(tl, *cols):
    df = tl.df if isinstance(tl, Timeline) else tl
    return df.select("rn", *cols).orderBy("rn").toPandas()


def test_feature_table(small, whole, frame):
    a, b = (features.create_features(t, fill=None) for t in (small, whole))
    cols = features.feature_columns()
    x, y = rows(a, *cols), rows(b, *cols)
    assert len(x) == N and len(cols) == 74
    np.testing.assert_allclose(x[cols].astype(float), y[cols].astype(float), rtol=1e-9, atol=1e-9)
    c, h, lo, v = (frame[k] for k in ("Close", "High", "Low", "Volume"))
    em = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = em(c, 12) - em(c, 26)
    np.testing.assert_allclose(x["MACD_Signal"], em(line, 9), rtol=1e-9, atol=1e-9)
    p = c.pct_change()
    np.testing.assert_allclose(x["VPT"].astype(float), (v * p).cumsum(), rtol=1e-9)
    s = np.sign(p.fillna(0)).replace(0, np.nan).ffill().fillna(0).astype(int)
    run = s.groupby(s.diff().ne(0).cumsum()).cumsum()
    assert x["run"].tolist() == run.tolist()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    pc = c.diff()
    tsi = 100 * em(em(pc, 13), 25) / em(em(pc.abs(), 13), 25)
    np.testing.assert_allclose(x["TSI_25_13"].astype(float), tsi, rtol=1e-9)
    width = 2 * em(tr, 39)
    np.testing.assert_allclose(x["KCP"].astype(float), (c - em(c, 20) + width) / (2 * width), rtol=1e-9)
    lag = p.fillna(0).shift(3)
    np.testing.assert_allclose(x["close_pct_lag_3"].astype(float), lag, rtol=1e-9)


def test_feature_fill(small, frame):
    raw = rows(features.create_features(small, fill=None), *features.feature_columns())
    want = raw.drop(columns="rn").astype(float)
    got = rows(features.create_features(small), *features.feature_columns()).drop(columns="rn").astype(float)
    np.testing.assert_allclose(got, want.ffill().bfill().fillna(0), rtol=1e-12, atol=1e-12)
    causal = rows(features.create_features(small, fill="causal"), *features.feature_columns())
    np.testing.assert_allclose(causal.drop(columns="rn").astype(float), want.ffill().fillna(0), rtol=1e-12, atol=1e-12)


def test_fill_with_long_gaps(spark):
    f = walk(400, "A", 3)
    f["x"] = np.where((f.index > 40) & (f.index < 390), np.nan, f["Close"])
    f.loc[395, "x"] = np.inf
    sdf = spark.createDataFrame(f, SCHEMA + ", x double")
    tl = Timeline.build(sdf, chunk_rows=50)
    got = rows(fills.fill(tl, ["x"], ("bfill", "ffill"), zero=False), "x")
    x = f["x"].replace(np.inf, np.nan)
    np.testing.assert_allclose(got["x"], x.bfill().ffill())


@pytest.mark.parametrize("price", ["flat", "up", "down"])
def test_edge_prices(spark, price):
    f = walk(60, "A", 1)
    k = {"flat": 0.0, "up": 1.0, "down": -1.0}[price]
    for c in ("Open", "High", "Low", "Close"):
        f[c] = 100 + k * np.arange(60)
    tl = Timeline.build(candles(spark, f), chunk_rows=25)
    got = rows(tl.apply(indicators.rsi(), indicators.stochastic(), indicators.rolling_z_score(), indicators.money_flow_index()), "rsi", "stoch_k", "zscore", "mfi")
    last = got.iloc[-1]
    if price == "flat":
        assert math.isnan(last["rsi"]) and last["stoch_k"] == 0 and last["zscore"] == 0 and math.isnan(last["mfi"])
    else:
        assert last["rsi"] == (100 if price == "up" else 0)
    assert got["rsi"].isna().sum() == (60 if price == "flat" else 13)


def test_short_series(spark):
    tl = Timeline.build(candles(spark, walk(1, "A"), walk(2, "B"), walk(5, "C")), chunk_rows=2)
    got = recursive.kama(tl, out="k").df.toPandas()
    assert len(got) == 8 and got["k"].isna().all()
    assert labels.fixed_horizon_labels(tl, 10, 0.1, 0.1).count() == 0


def test_kama_and_kalman(small, frame):
    c = frame["Close"]
    er = (c - c.shift(10)).abs() / c.diff().abs().rolling(10).sum().replace(0, 1e-9)
    sc = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    want = np.full(N, np.nan)
    want[9] = c[9]
    for i in range(10, N):
        want[i] = want[i - 1] + sc[i] * (c[i] - want[i - 1])
    np.testing.assert_allclose(rows(recursive.kama(small), "kama")["kama"].astype(float), want, rtol=1e-9)
    m, var, out = 0.0, 1.0, []
    for i, z in enumerate(c):
        var = var + (1 if i else 0)
        k = var / (var + 1)
        m, var = m + k * (z - m), (1 - k) * var
        out.append(m)
    np.testing.assert_allclose(rows(recursive.kalman_level(small), "kalman")["kalman"], out, rtol=1e-9)


def greedy_peaks(x, threshold, distance):
    found = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            mid = (i + j) // 2
            drop = min(x[mid] - x[mid - 1], x[mid] - x[mid + 1])
            if drop >= threshold:
                found.append(mid)
        i = j + 1
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda q: (x[q], q), reverse=True):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return [p + 1 for p in found if keep[p]]


@pytest.mark.parametrize("threshold,distance", [(0.0, 1), (0.5, 1), (0.0, 12)])
def test_peaks(spark, threshold, distance):
    rng = np.random.default_rng(7)
    f = walk(300, "A", 4)
    f["Close"] = rng.integers(0, 6, 300).astype(float)
    tl = Timeline.build(candles(spark, f), chunk_rows=40)
    got = sorted(labels.peaks(tl, "Close", threshold, distance).toPandas()["rn"])
    assert got == greedy_peaks(f["Close"].to_numpy(), threshold, distance)


def test_triple_barrier_edges(spark):
    f = walk(6, "A")
    f["Close"] = [100.0, 111.0, 90.0, 100.0, 100.0, 100.0]
    f["vol"] = [0.1, np.nan, 0.0, 0.1, 0.1, 0.1]
    tl = Timeline.build(spark.createDataFrame(f, SCHEMA + ", vol double").withColumn("vol", F.nanvl("vol", F.lit(None))), chunk_rows=3)
    got = labels.triple_barrier_labels(tl, "vol", 2, (1.0, 1.0)).orderBy("rn").toPandas()
    # row 1 touches up at once; row 2 has the filled volatility and touches down; row 3 has none; row 4 times out flat
    assert got["rn"].tolist() == [1, 2, 4]
    assert got["label"].tolist() == [1, -1, 0]
    assert got["end_rn"].tolist() == [2, 3, 6]
    flat = labels.triple_barrier_labels(tl, "vol", 2, (5.0, 5.0), timeout_by_sign=False).toPandas()
    assert (flat["label"] == 0).all()


@pytest.mark.parametrize("mode", ["aggressive", "conservative"])
def test_swings(small, frame, mode):
    got = rows(signals.swings(small, 0.05, mode, warm_up=60), "direction", "signal")
    side, hi, lo, highs, lows, used = 0, 0.0, math.inf, [], [], False
    want = [(0, 0)]
    h, low, c = (frame[k].tolist() for k in ("High", "Low", "Close"))
    for i in range(1, N):
        sig = 0
        if side == 0:
            if h[i] > h[i - 1]:
                side, hi = 1, h[i]
                lows.append(low[i - 1])
            elif low[i] < low[i - 1]:
                side, lo = -1, low[i]
                highs.append(h[i - 1])
        elif side == -1:
            if low[i] < lo:
                lo = low[i]
                if mode == "conservative" and len(lows) >= 2 and not used and lo < lows[-2]:
                    sig, used = -1, True
            if h[i] - lo > 0.05 * c[i]:
                side, hi, used = 1, h[i], False
                lows.append(lo)
                sig = 1 if mode == "aggressive" else sig
        else:
            if h[i] > hi:
                hi = h[i]
                if mode == "conservative" and len(highs) >= 2 and not used and hi > highs[-2]:
                    sig, used = 1, True
            if hi - low[i] > 0.05 * c[i]:
                side, lo, used = -1, low[i], False
                highs.append(hi)
                sig = -1 if mode == "aggressive" else sig
        want.append((side, sig))
    assert list(zip(got["direction"], got["signal"])) == want


def test_frac_diff_with_gaps(spark):
    f = walk(300, "A", 9)
    f["Close"] = f["Close"].where(np.arange(300) % 17 != 3)
    f.loc[:4, "Close"] = np.nan
    sdf = candles(spark, f).withColumn("Close", F.nanvl("Close", F.lit(None)))
    tl = Timeline.build(sdf, chunk_rows=40)
    got = rows(fracdiff.frac_diff(tl, ["Close"], 0.4, 1e-2), "Close")["Close"].astype(float).to_numpy()
    w = fracdiff.ffd_weights(0.4, 1e-2)
    filled = f["Close"].ffill()
    start = filled.first_valid_index()
    want = np.full(300, np.nan)
    want[start:] = 0.0
    for i in range(start + len(w) - 1, 300):
        if not np.isnan(f["Close"][i]):
            want[i] = (filled.to_numpy()[i - len(w) + 1 : i + 1][::-1] * w).sum()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("strict", [True, False])
def test_har_backtest(spark, strict):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"symbol": "A", "bucket": pd.date_range("2024-01-01", periods=160), "rv": rng.gamma(2, 1e-4, 160)})
    tl = Timeline.build(spark.createDataFrame(f, "symbol string, bucket timestamp_ntz, rv double"), order=("bucket",), chunk_rows=30)
    got = volatility.har_backtest(tl, 60, strict=strict).orderBy("bucket").toPandas()
    d = pd.DataFrame({"y": f["rv"].shift(-1), "a": f["rv"].shift(1), "rv": f["rv"]})
    d["b"], d["c"] = d["a"].rolling(5).mean(), d["a"].rolling(22).mean()
    d["t"] = f["bucket"]
    d = d.dropna().reset_index(drop=True)
    want = []
    for i in range(len(d)):
        if d["t"][i] - d["t"][0] < pd.Timedelta(days=60):
            continue
        tr = d.iloc[: i - 1 if strict else i]
        X = np.column_stack([np.ones(len(tr)), tr[["a", "b", "c"]]])
        beta = np.linalg.lstsq(X, tr["y"], rcond=None)[0]
        want.append(beta @ np.concatenate(([1.0], d.loc[i - 1, ["a", "b", "c"]].astype(float))))
    np.testing.assert_allclose(got["forecast_rv"], want, rtol=1e-6)


def test_overfitting(spark):
    rng = np.random.default_rng(11)
    T, S, K = 50, 4, 5
    mat = rng.normal(0, 1, (T, K))
    long = [(k, t, float(mat[t, k])) for k in range(K) for t in range(T)]
    df = spark.createDataFrame(long, "config int, ts int, ret double")
    tl = Timeline.build(df, ("config",), ("ts",), 20)
    size = T // S
    want = {}
    for combo in itertools.combinations(range(S), S // 2):
        idx = np.concatenate([np.arange(b * size, (b + 1) * size) for b in combo])
        out = np.setdiff1d(np.arange(size * S), idx)
        sh = lambda m: m.mean(0) / m.std(0, ddof=1)
        best = int(np.argmax(sh(mat[idx])))
        rank = pd.Series(sh(mat[out])).rank(ascending=False, method="first")[best]
        want[sum(1 << b for b in combo)] = (best, rank)
    for convention in ("paper", "reference"):
        got = overfit.symmetric_cv(tl, S, convention=convention).toPandas()
        for r in got.itertuples():
            best, rank = want[r.choice]
            assert r.best == best
            assert r.omega == pytest.approx((rank if convention == "reference" else K + 1 - rank) / (K + 1))
    with pytest.raises(ValueError):
        overfit.symmetric_cv(tl, 3)
    with pytest.raises(ValueError):
        overfit.symmetric_cv(tl, 64)


def test_equal_configs_tie_in_any_layout(spark):
    """Configs with the same returns have the same sums, however their rows lie in partitions; the first of them is best."""
    x = np.random.default_rng(7).normal(0, 0.01, 800)
    df = spark.createDataFrame([(k, t, t + 1, float(v)) for k in range(5) for t, v in enumerate(x)], "config int, ts int, rn bigint, ret double")
    seen = []
    for parts in (3, 7, 12):
        tl = Timeline(df.repartition(parts, F.xxhash64("rn", "config", F.lit(parts))), ("config",), ("ts",), 50, True)
        m = overfit.block_moments(tl, 4).toPandas()
        assert (m.groupby("block")[["n", "s", "q"]].nunique() == 1).all(axis=None)
        seen.append(m.groupby("block")[["n", "s", "q"]].first())
        got = overfit.symmetric_cv(tl, 4).toPandas()
        assert (got["best"] == 0).all() and np.allclose(got["omega"], 5 / 6)
    assert all(f.equals(seen[0]) for f in seen)
    np.testing.assert_allclose(seen[0]["s"], x.reshape(4, 200).sum(1), rtol=1e-12)


def runs_of_prices(runs: int = 20):
    """Every price stands 60 or 300 times in a row, so that many means of prices are exact ties."""
    prices = 100 + np.round(np.random.default_rng(3).gamma(1, 50, runs), 2)
    close = np.repeat(prices, np.resize([60, 300], runs))
    f = walk(len(close), "A", 1)
    f[["Open", "High", "Low", "Close"]] = np.column_stack([close] * 4)
    return f


def sql_signals(f, body):
    con = duckdb.connect()
    con.register("f", f)
    con.execute("CREATE TABLE ticks AS SELECT symbol, seq, Close AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM f")
    return con.execute(f"SELECT rn, signal FROM (SELECT symbol, rn, {body} AS signal FROM ({TIES}) AS q) AS q2 ORDER BY symbol, rn").df()["signal"].to_numpy()


MEANS = ", ".join(f"{roll('avg', 'close', n)} AS m{n}" for n in (10, 16, 17, 20, 31, 50, 200))
TIES = f"SELECT *, {MEANS}, m20 + 2 * {roll('stddev_samp', 'close', 20)} AS u, m20 - 2 * {roll('stddev_samp', 'close', 20)} AS l FROM ticks"


def exact_ties(f, fast, slow):
    cents = pd.Series(np.rint(f["Close"].to_numpy() * 100).astype(np.int64))
    return (cents.rolling(fast).sum() * slow == cents.rolling(slow).sum() * fast).sum()


@pytest.mark.parametrize("fast,slow", [(10, 20), (16, 17), (31, 50), (50, 200)])
def test_level_signal_ties_as_in_sql(spark, fast, slow):
    f = runs_of_prices()
    assert exact_ties(f, fast, slow) > 100
    want = sql_signals(f, f"CASE WHEN m{fast} > m{slow} THEN 1 ELSE 0 END")
    for chunk in (1_000_000, 250):
        got = rows(Timeline.build(candles(spark, f), chunk_rows=chunk).apply(signals.level_signal(fast, slow)), "signal")
        assert (got["signal"].to_numpy() == want).all()


def test_trend_side_ties_as_in_sql(spark):
    f = runs_of_prices()
    want = sql_signals(f, "CASE WHEN close > m50 THEN 1 WHEN close < m50 THEN -1 ELSE 0 END")
    got = rows(Timeline.build(candles(spark, f), chunk_rows=250).apply(signals.trend_side()), "signal")
    assert (got["signal"].to_numpy() == want).all()


def test_band_signals_tie_as_in_sql(spark):
    f = runs_of_prices()
    tl = Timeline.build(candles(spark, f), chunk_rows=250)
    both = {
        "trend": (signals.trend_breakout(), "CASE WHEN close > u AND m50 > m200 THEN 1 WHEN close < l AND m50 < m200 THEN -1 ELSE 0 END"),
        "band": (signals.band_breach(), "CASE WHEN close < l THEN 1 WHEN close > u THEN -1 ELSE 0 END"),
    }
    for name, (recipe, body) in both.items():
        got = rows(tl.apply(recipe.named(name)), name)[name].to_numpy()
        assert (got == sql_signals(f, body)).all(), name


def test_means_by_blocks_keep_nulls(spark):
    f = walk(400, "A", 6, nulls=0.03)
    tl = Timeline.build(candles(spark, f).withColumn("Close", F.nanvl("Close", F.lit(None).cast("double"))), chunk_rows=150)
    x = F.col("Close")
    stages = (
        lambda w: {"_k": R.block_sums(x, w), "a": R.mean_by_blocks(x, 20, w), "c": R.mean_by_blocks(x, 40, w)},
        lambda w: {"b": R.mean_by_blocks(x, 20, w, F.col("_k")), "d": R.mean_by_blocks(x, 40, w, F.col("_k"))},
    )
    got = rows(tl.apply(Recipe(("a", "b", "c", "d"), stages, ("Close",), 40)), "a", "b", "c", "d")
    for names, n in (("ab", 20), ("cd", 40)):
        want = f["Close"].rolling(n).mean().to_numpy()
        assert 0 < np.isnan(want).sum() < 400
        np.testing.assert_array_equal(got[names[0]], got[names[1]])
        np.testing.assert_allclose(got[names[0]], want, rtol=1e-12)


def test_paths_cover_groups(spark):
    for mode in ("all", "partition"):
        p = splits.backtest_paths(spark, 6, 2, mode).toPandas()
        assert all(sorted(part["grp"]) == list(range(6)) for _, part in p.groupby("path"))
        assert not p.duplicated(["grp", "split"]).any()
    assert splits.backtest_paths(spark, 6, 2).toPandas()["path"].nunique() == 5
    with pytest.raises(ValueError):
        splits.combinatorial_splits(spark, 3, 3)


def test_purge_leaves_no_overlap(spark, frame):
    tl = Timeline.build(candles(spark, frame), chunk_rows=100)
    lab = labels.fixed_horizon_labels(tl, 20, 0.01, 0.01).withColumnRenamed("event_end_time", "t1")
    g = splits.time_groups(lab, 5)
    got = splits.purged_splits(g, splits.combinatorial_splits(spark, 5, 2)).toPandas()
    for _, part in got.groupby("split"):
        test, train = part[part.role == "test"], part[part.role == "train"]
        for grp, block in test.groupby("grp"):
            lo, hi = block["ts"].min(), block["ts"].max()
            assert not ((train["ts"] <= hi) & (train["t1"] >= lo)).any()


def test_weights_sum_to_one(small):
    lab = labels.fixed_horizon_labels(small, 7, 0.01, 0.01)
    w = weights.sample_weights(small, lab).toPandas()
    assert w["sample_weight"].sum() == pytest.approx(1)
    assert ((w["uniqueness"] > 0) & (w["uniqueness"] <= 1)).all()


def test_causal_columns_ignore_the_future(spark, frame):
    later = frame.copy()
    later.loc[600:, ["Open", "High", "Low", "Close"]] *= 3
    a, b = (
        rows(features.create_features(Timeline.build(candles(spark, f), chunk_rows=150), fill="causal"), *features.feature_columns())
        for f in (frame, later)
    )
    np.testing.assert_allclose(a.iloc[:600].astype(float), b.iloc[:600].astype(float), rtol=1e-9, atol=1e-9)


def test_tails():
    assert tails.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_tail(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.adf_p_value(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert tails.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)


def test_unit_root_direction(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    f = pd.concat([walk(400, s, 1).assign(Close=v) for s, v in (("still", noise), ("walk", noise.cumsum()), ("flat", np.ones(400)))])
    got = stats.adf(Timeline.build(candles(spark, f), chunk_rows=100), "Close").toPandas().set_index("symbol")
    assert got.loc["still", "stationary"] and not got.loc["walk", "stationary"] and not got.loc["flat", "stationary"]
    x = noise.cumsum()
    d = np.diff(x)
    X = np.column_stack([x[1:-1], d[:-1], np.ones(398)])
    beta, rss, *_ = np.linalg.lstsq(X, d[1:], rcond=None)
    se = math.sqrt(rss[0] / (398 - 3) * np.linalg.inv(X.T @ X)[0, 0])
    assert got.loc["walk", "adf"] == pytest.approx(beta[0] / se, rel=1e-6)


@pytest.mark.parametrize("chunk_rows", [64, 1000, 5000])
def test_exponential_means_remember_through_long_gaps(spark, chunk_rows):
    """Runs of nulls over many chunks, sparse values, and a key without any value: chunks agree with one long scan."""
    frames = []
    for symbol, seed in (("A", 1), ("B", 2), ("C", 3)):
        f = walk(4000, symbol, seed)
        r = np.random.default_rng(seed)
        lost = np.zeros(4000, bool)
        lost[900:2600] = True
        lost[2700:3900] = r.random(1200) < 0.97 if symbol == "A" else False
        if symbol == "B":
            lost[:50] = True
        if symbol == "C":
            lost[:] = True
        f.loc[lost, ["High", "Low", "Close"]] = np.nan
        frames.append(f)
    tl = Timeline.build(candles(spark, *frames), chunk_rows=chunk_rows)
    whole = Timeline.build(candles(spark, *frames), chunk_rows=10_000)
    many = [
        (lambda t: recursive.ewm(t, "Close", {"a": 5, "b": 60}, keep=[]), ["a", "b"]),
        (lambda t: recursive.macd(t, keep=[]), ["macd", "macd_signal", "macd_hist"]),
        (lambda t: recursive.adx(t, keep=[]), ["adx", "dmp", "dmn"]),
        (lambda t: recursive.schaff_trend_cycle(t, keep=[]), ["stc", "stc_stoch"]),
    ]
    for make, names in many:
        got, want = (make(t).df.orderBy("symbol", "rn").select("symbol", "rn", *names).toPandas() for t in (tl, whole))
        assert got["rn"].tolist() == want["rn"].tolist()
        for n in names:
            np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-9, atol=1e-9, err_msg=n)
    plain = pd.concat(frames).groupby("symbol")["Close"].transform(lambda x: x.ewm(span=60, adjust=False).mean())
    got = recursive.ewm(tl, "Close", {"b": 60}, keep=["seq"]).df.orderBy("symbol", "rn").toPandas()
    np.testing.assert_allclose(got["b"].astype(float), plain.to_numpy(), rtol=1e-12)


def slow_tau(x, y):
    def one(a, b):
        rank = np.empty(len(x))
        rank[np.lexsort((b, a))[::-1]] = np.arange(len(x))
        w = 1 / (rank + 1)
        s, n, m = 0.0, 0.0, 0.0
        for i, j in itertools.combinations(range(len(x)), 2):
            sx, sy, p = np.sign(x[i] - x[j]), np.sign(y[i] - y[j]), w[i] + w[j]
            s, n, m = s + sx * sy * p, n + abs(sx) * p, m + abs(sy) * p
        return s / math.sqrt(n * m) if n * m else math.nan

    return (one(x, y) + one(y, x)) / 2


@pytest.mark.parametrize("seed", range(6))
def test_weighted_tau_counts_partners_without_pairs(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 60))
    x, y = (r.integers(0, [3, 10, 1000][seed % 3], n).astype(float) for _ in range(2))
    assert stats._weighted_tau(x, y) == pytest.approx(slow_tau(x, y), nan_ok=True)


def test_pairwise_tau_and_long_rankings(spark):
    r = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(12)]
    f = pd.DataFrame(r.integers(0, 40, (80, 12)).astype(float), columns=cols)
    got = {(t["first"], t["second"]): t["weighted_tau"] for t in stats.pairwise_tau(spark.createDataFrame(f), cols).collect()}
    assert len(got) == 66
    for (a, b), v in list(got.items())[::13]:
        assert v == pytest.approx(slow_tau(f[a].to_numpy(), f[b].to_numpy()))
    x = r.random(300_000)
    assert stats._weighted_tau(x, x) == pytest.approx(1.0) and stats._weighted_tau(x, -x) < -0.9


def test_percent_ranks_with_ties_and_nulls(spark):
    values = [3.0, 1.0, None, 1.0, 2.0, None, 3.0, 3.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "feature int, v double")
    got = stats.percent_ranks(df, "v", "r", 2).orderBy("feature").toPandas()["r"].tolist()
    smaller = lambda a, b: a is None and b is not None or a is not None and b is not None and a < b
    assert got == [sum(smaller(b, a) for b in values) / 8 for a in values]


@pytest.mark.parametrize("chunk_rows", [16, 4096])
def test_rising_peaks_are_thinned_in_few_rounds(spark, chunk_rows, monkeypatch):
    """Two hundred peaks, each higher than the one before: every second one goes, settled by chunks."""
    n = 400
    x = np.where(np.arange(n) % 2 == 1, np.arange(n) * 1.0, 0.0)
    f = walk(n, "A", 1).assign(Close=x)
    rounds = []
    kept = labels.materialize
    monkeypatch.setattr(labels, "materialize", lambda df, *a: rounds.append(1) or kept(df, *a))
    got = labels.peaks(Timeline.build(candles(spark, f), chunk_rows=chunk_rows), "Close", 0.0, 10).toPandas()["rn"]
    assert sorted(got) == greedy_peaks(x, 0.0, 10)
    assert len(rounds) <= (3 if chunk_rows > n else n // chunk_rows + 3)


def test_concurrency_keeps_rows_of_equal_time(spark):
    at = "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, {})".format
    events = spark.createDataFrame([(0, 2), (0, 2), (1, 2)], "a int, b int").selectExpr("'A' symbol", f"{at('a')} ts", f"{at('b')} event_end_time")
    index = spark.createDataFrame([(s,) for s in (0, 0, 1, 1, 1, 2)], "a int").selectExpr("'A' symbol", f"{at('a')} ts")
    got = weights.concurrent_labels(events, index, chunk_rows=2).select(F.second("ts").alias("s"), "concurrency").collect()
    assert sorted(map(tuple, got)) == [(0, 2), (0, 2), (1, 3), (1, 3), (1, 3), (2, 0)]


def test_percent_ranks_of_values_made_anew(spark):
    """Two runs of an average may differ in the last digit; here every run gives other values."""
    df = spark.range(200).select(F.col("id").alias("feature"), F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()().alias("y"))
    got = stats.ensemble_score(df, {"y": 1.0}).toPandas()
    assert sorted(got["score"] * 199) == pytest.approx(range(200))


@pytest.mark.parametrize("chunk_rows", [7, 64, 4096])
def test_open_events_are_not_copied_to_every_chunk(spark, monkeypatch, chunk_rows):
    """Events to the end of the series touch where a plain loop does, and meet two chunks a level, not all they cross."""
    pdf = walk(900, seed=8, nulls=0.02)
    tl = Timeline.build(candles(spark, pdf), chunk_rows=chunk_rows)
    sent, search = [], labels._search
    monkeypatch.setattr(labels, "_search", lambda rows, asked, *a: sent.append(asked.count()) or search(rows, asked, *a))
    ends = [min(900, i + 1 + 37 * (i % 30)) for i in range(900)]
    asked = pd.DataFrame({"symbol": "A", "start_rn": range(1, 901), "end_rn": ends, "upper": pdf["Close"] + 6, "lower": pdf["Close"] - 9}).fillna({"upper": 1e9, "lower": -1.0})
    got = labels.first_touch(tl, spark.createDataFrame(asked)).toPandas().set_index("start_rn")
    assert len(got) == 900 and max(sent) <= 900
    close = pdf["Close"].to_numpy()
    for e in asked.itertuples():
        part = close[e.start_rn : e.end_rn]
        hits = np.flatnonzero((part >= e.upper) | (part <= e.lower))
        if len(hits):
            assert got.loc[e.start_rn, "touch_rn"] == e.start_rn + 1 + hits[0]
            assert got.loc[e.start_rn, "touch_side"] == (1 if part[hits[0]] >= e.upper else -1)
        else:
            assert pd.isna(got.loc[e.start_rn, "touch_rn"])
