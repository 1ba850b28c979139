import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import candles, walk
from tidewheel import Timeline
from tidewheel.operators import bars, scans, sweeps
from tidewheel.operators.scans import first_hit, reset_scan
from tidewheel.sources import views


def frames():
    return [walk(500, "A", 1), walk(133, "B", 2), walk(1, "C", 3)]


@pytest.fixture(scope="module")
def data(spark):
    return candles(spark, *frames()).cache()


def seq_bars(metric, T):
    acc, out = 0.0, []
    for i, x in enumerate(metric):
        acc += x
        if acc >= T:
            out.append(i + 1)
            acc = 0.0
    return out


def test_row_numbers(spark, data):
    tl = Timeline.build(data.repartition(13), chunk_rows=64)
    got = tl.df.select("symbol", "seq", "rn").toPandas()
    assert (got["seq"] + 1 == got["rn"]).all()
    assert len(got) == 634


@pytest.mark.parametrize("chunk", [7, 100_000])
@pytest.mark.parametrize("T", [333.0, 4_000.0])
def test_threshold_bars(spark, data, chunk, T):
    tl = Timeline.build(data, chunk_rows=chunk)
    done = bars.assign_threshold_bars(tl, "Volume", T).df
    got = done.where("closes").select("symbol", "rn", "bar_id").toPandas()
    for f in frames():
        want = seq_bars(f["Volume"], T)
        g = got[got.symbol == f.symbol[0]].sort_values("rn")
        assert g["rn"].tolist() == want
        assert g["bar_id"].tolist() == list(range(len(want)))


def seq_two_sided(step, limit):
    acc, out = 0.0, []
    for i, (x, t) in enumerate(zip(step, limit)):
        acc += x
        if t > 0 and abs(acc) >= t:
            out.append(i + 1)
            acc = 0.0
    return out


def seq_cusum(dev, h):
    u = v = 0.0
    out = []
    for i, x in enumerate(dev):
        u, v = max(0.0, u + x), min(0.0, v + x)
        if u >= h or v <= -h:
            out.append(i + 1)
            u = v = 0.0
    return out


@pytest.mark.parametrize("chunk", [9, 100_000])
@pytest.mark.parametrize("h", [2.5, 9.0, 60.0])
def test_two_sided_and_clamped(spark, data, chunk, h):
    tl = Timeline.build(data, chunk_rows=chunk)
    step = (F.col("Close") - F.col("Open"))
    ready = tl.extend(s=step, h=F.lit(h) + F.pmod("seq", F.lit(3)))
    got = reset_scan(ready, "s", "h", [], two_sided=True).df.where("closes").toPandas()
    got2 = reset_scan(ready, "s", "h", [], two_sided=True, clamp=True).df.where("closes").toPandas()
    for f in frames():
        d = f["Close"] - f["Open"]
        lim = h + f["seq"] % 3
        assert sorted(got[got.symbol == f.symbol[0]]["rn"]) == seq_two_sided(d, lim)
        u = v = 0.0
        want = []
        for i, (x, t) in enumerate(zip(d, lim)):
            u, v = max(0.0, u + x), min(0.0, v + x)
            if u >= t or v <= -t:
                want.append(i + 1)
                u = v = 0.0
        assert sorted(got2[got2.symbol == f.symbol[0]]["rn"]) == want


def test_first_hit():
    rng = np.random.default_rng(0)
    up, down = rng.normal(size=200), rng.normal(size=200)
    start = rng.integers(0, 200, 200)
    bu, bd = rng.normal(size=200) + 2, rng.normal(size=200) - 2
    got = first_hit(up, down, bu, bd, start)
    for i in range(200):
        want = next((j for j in range(start[i], 200) if up[j] >= bu[i] or down[j] <= bd[i]), 200)
        assert got[i] == want


def ref_signs(close):
    d = close.diff()
    s = np.sign(d).replace(0, np.nan).ffill().fillna(1)
    return s


@pytest.mark.parametrize("chunk", [50, 100_000])
def test_dynamic_imbalance(spark, data, chunk):
    tl = Timeline.build(data, chunk_rows=chunk)
    got = bars.tick_imbalance(tl, initial_bar_size=5, warm_up=60).toPandas()
    vib = bars.volume_imbalance(tl, warm_up=60).toPandas()
    for f in frames():
        s = ref_signs(f["Close"])
        m = s.ewm(span=20, adjust=False).mean()
        size, cum, start, out, th = 5.0, 0.0, 0, [], []
        a = 2 / 21
        for i in range(len(f)):
            t = abs(size * m[i])
            th.append(t)
            cum += s[i]
            if t > 0 and abs(cum) >= t:
                out.append(i + 1)
                size = (1 - a) * size + a * (i + 1 - start)
                start, cum = i + 1, 0.0
        g = got[got.symbol == f.symbol[0]].sort_values("rn")
        assert g[g.closes]["rn"].tolist() == out
        np.testing.assert_allclose(g["threshold"], th, rtol=1e-9)
        mean, cum, start, out = f["Volume"].sum() / 100, 0.0, 0, []
        for i in range(len(f)):
            t = abs(mean * m[i])
            cum += s[i] * f["Volume"][i]
            if t > 0 and abs(cum) >= t:
                out.append(i + 1)
                mean = (1 - a) * mean + a * f["Volume"][start : i + 1].sum()
                start, cum = i + 1, 0.0
        g = vib[vib.symbol == f.symbol[0]].sort_values("rn")
        assert g[g.closes]["rn"].tolist() == out


@pytest.mark.parametrize("chunk", [30, 100_000])
def test_run_threshold(spark, data, chunk):
    tl = Timeline.build(data, chunk_rows=chunk)
    got = bars.tick_imbalance(tl, "dynamic_runs", window_run_length=12).toPandas()
    for f in frames():
        s = ref_signs(f["Close"]).tolist()
        lim = []
        for i in range(len(s)):
            if i < 11:
                lim.append(np.nan)
                continue
            w = pd.Series(s[i - 11 : i + 1])
            lim.append((w != w.shift()).cumsum().value_counts().median())
        g = got[got.symbol == f.symbol[0]].sort_values("rn")
        np.testing.assert_allclose(g["threshold"].astype(float), lim)
        assert g[g.closes]["rn"].tolist() == seq_two_sided(s, lim)


@pytest.mark.parametrize("chunk", [16, 100_000])
def test_sweep_matches_single(spark, data, chunk):
    tl = Timeline.build(data, chunk_rows=chunk)
    got = bars.threshold_sweep(tl, "Volume", 4).toPandas()
    f = frames()[0]
    for k, T in enumerate(np.linspace(f["Volume"].mean(), 4 * f["Volume"].max(), 4)):
        assert len(got[(got.symbol == "A") & (got.step == k)]) == len(seq_bars(f["Volume"], T))


@pytest.mark.parametrize("chunk", [7, 256, 4096, 100_000])
def test_chunks_do_not_change_fractional_bars(spark, chunk):
    rng = np.random.default_rng(11)
    n = 300
    df = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "seq": np.arange(n)})
    df["lots"] = rng.integers(0, 30, n) / 100.0
    df["move"] = rng.integers(-9, 10, n) / 100.0
    df["h"] = 0.5
    tl = Timeline.build(spark.createDataFrame(df), chunk_rows=chunk)
    one = reset_scan(tl, "lots", "h", []).df.toPandas().sort_values("rn")
    want, bar, total = [], 0, 0.0
    for x in df["lots"]:
        want.append(bar)
        total += x
        if total >= 0.5:
            bar, total = bar + 1, 0.0
    assert one["bar_id"].tolist() == want
    both = reset_scan(tl, "move", "h", [], two_sided=True).df.where("closes").toPandas()
    assert sorted(both["rn"]) == seq_two_sided(df["move"], df["h"])


def test_null_keys_raise_and_equal_times_are_stable(spark):
    df = pd.DataFrame({"symbol": ["A", "A", None], "ts": pd.Timestamp("2024-01-01"), "seq": [1, 1, 2], "x": [1.0, 2.0, 3.0]})
    with pytest.raises(ValueError, match="1 rows"):
        Timeline.build(spark.createDataFrame(df))
    even = spark.createDataFrame(df[df.symbol.notna()])
    runs = [sorted((r.x, r.rn) for r in Timeline.build(d).df.collect()) for d in (even, even.orderBy("x"), even.orderBy("x", ascending=False))]
    assert runs[0] == runs[1] == runs[2] and [r for _, r in sorted(runs[0])] in ([1, 2], [2, 1])


@pytest.mark.parametrize("task_rows", [1, 64, 500, 65_536])
def test_chunks_of_a_task_do_not_change_bars(spark, monkeypatch, task_rows):
    """Threshold scans take many small chunks at once; borders between tasks, wherever they are, change nothing."""
    monkeypatch.setattr(scans, "TASK_ROWS", task_rows)
    pdf = walk(1500, seed=3)
    pdf["Volume"] = pdf["Volume"] * 0.01
    tl = Timeline.build(candles(spark, pdf), chunk_rows=50)
    got = bars.volume_bars(tl, 2.5).orderBy("bar_id").toPandas()
    total, want = 0.0, []
    for ts, x in zip(pdf["ts"], pdf["Volume"]):
        total += x
        if total >= 2.5:
            want.append(ts)
            total = 0.0
    assert got["ts"].tolist() == want and got["bar_id"].tolist() == list(range(len(want)))
    assert scans.task_chunks(tl).chunk_rows == {1: 50, 64: 50, 500: 500, 65_536: 65_500}[task_rows]


@pytest.mark.parametrize("floor", [0.0, -np.inf])
def test_lanes_give_the_functions_of_the_descent(floor):
    """Step functions of all thresholds at once equal those of one threshold after the other, and closes the plain loop."""
    rng = np.random.default_rng(5)
    step, rn = rng.integers(0, 9, 300).astype(float), np.arange(300) + 41
    limits = np.array([1.0, 4.0, 5.0, 17.0, 200.0, 700.0, 1e6])
    for t, got in zip(limits, sweeps._functions(step, limits, rn, floor), strict=True):
        want = scans._chunk_function(step, np.full(300, t), rn, False, False, floor)
        for entry in np.arange(0, t, max(1.0, t // 40)):
            state = [[entry], [entry], [7.0], [3.0]]
            assert [x[0] for x in scans._evaluate(got, *state)] == [x[0] for x in scans._evaluate(want, *state)]
    fired, u = sweeps._closes(step, limits, np.zeros(7))
    for j, t in enumerate(limits):
        *_, closes, end = scans._replay(step, np.full(300, t), rn, [0.0, 0.0, 41.0, 0], False, False)
        assert fired[:, j].tolist() == closes.tolist() and u[j] == end[0]


def test_border_passes_read_packed_steps_only(spark, data, monkeypatch):
    """Rows are shuffled for the step functions and for the bars, not again for every round of border checks."""
    read, write = [], scans.materialize

    def spy(df, label="cut", by=()):
        if label == "states":
            read.extend(f.split("/")[-2].split("-")[0] for f in df.inputFiles())
        return write(df, label, by)

    monkeypatch.setattr(scans, "TASK_ROWS", 50)
    monkeypatch.setattr(scans, "materialize", spy)
    tl = Timeline.build(data, chunk_rows=50).extend(move=F.col("Volume") * 0.01, h=F.lit(2.5))
    got = reset_scan(tl, "move", "h", []).df.where("closes").toPandas()
    for f in frames():
        mine = got[got.symbol == f.symbol[0]].sort_values("rn")
        assert mine["rn"].tolist() == seq_bars(f["Volume"] * 0.01, 2.5)
    assert "steps" in read and not {"timeline", "series"} & set(read)


def test_ticks_are_parsed_behind_the_range_shuffle(spark):
    props = ['{"k": 7}', '{"k":70}', '{"k": 007}', '{"k": -3}', '{"k": 1.5}', '{"k": 7, "j": 1}', '{"k": "8"}', '{"k": null}', None, "x"]
    rows = [("a", i, i, float(i), p) for i, p in enumerate(props)]
    raw = spark.createDataFrame(rows, "symbol string, ts int, seq int, value double, props string")
    want = raw.select("seq", F.get_json_object("props", "$.k").cast("double").alias("Volume")).orderBy("seq").collect()
    done = Timeline.build(raw, derive=views.priced).df.orderBy("rn")
    assert done.select("seq", "Volume").collect() == want
    assert done.columns == [*views.priced(raw).columns, "rn"]
