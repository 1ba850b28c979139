"""The assembled feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import rolling as R
from tidewheel.operators import fills
from tidewheel.operators import indicators as I
from tidewheel.operators.recursive import kama, smoothed_features, volume_price_trend
from tidewheel.timeline import Recipe, Timeline

C = F.col
EMA_SPANS = (10, 15, 20, 30, 40, 50, 60)


def _pct_inputs() -> Recipe:
    cols = ("Open", "High", "Low", "Close")

    def s(w):
        return {f"_p{c}": F.coalesce(R.pct(C(c), w), F.lit(0.0)) for c in cols}

    return Recipe(tuple(f"_p{c}" for c in cols), (s,), cols, 1)


def _bounded(volume: bool) -> list[Recipe]:
    """Recipes of the columns with bounded look-back (the change series are stage one)."""
    later = lambda r: Recipe(r.out, (lambda w: {}, *r.stages), (), r.back + 1, r.fwd)
    recipes = [
        _pct_inputs(),
        later(I.rsi("_pClose", 14, "RSI_pct")),
        later(I.stochastic("_pHigh", "_pLow", "_pClose", out=("Stoch_K_pct", "Stoch_D_pct"))),
        later(I.bollinger("_pClose", 20, 2.0, ("_bbp_pct", "BB_Upper_pct", "BB_Lower_pct"))),
        I.lag_block(),
        I.rsi("Close", 14, "RSI"),
        I.awesome_oscillator(out="AO"),
        I.williams_r(out="WR"),
        I.roc(out="ROC"),
        I.ultimate_oscillator(out="UO_7_14_28"),
        I.stochastic(out=("Stoch_K", "Stoch_D")),
        I.aroon(out=("AROONU_14", "AROOND_14")),
        I.cci(out="CCI"),
        I.vortex(out=("VTXP_14", "VTXM_14")),
        I.return_stats(),
        I.bollinger(out=("BBP", "_bbu", "_bbl")),
        I.donchian(out=("_dcu", "_dcl")),
    ]
    if volume:
        recipes += [
            later(I.money_flow_index("_pHigh", "_pLow", "_pClose", "Volume", 14, "MFI_pct")),
            I.sma("Volume", 20, "avg_volume_20"),
            I.volume_oscillator(out="VO"),
            I.chaikin_money_flow(out="CMF"),
        ]
    return recipes


def run_length(tl: Timeline, x: str, out: str = "run", keep=None) -> Timeline:
    """Signed length so far of the block of equal change signs; zeros carry the sign.

    Block starts are remembered by row number, so the running value needs only a
    running last, never a window over a block.
    """
    keep = list(tl.df.columns) if keep is None else list(keep)

    def s(w):
        return {"_sg": F.when(C(x) > 0, 1).when(C(x) < 0, -1)}

    signed = tl.apply(Recipe(("_sg",), (s,), (x,)), keep=keep).running(keep=keep, _cur=("last", "_sg"))
    signed = signed.extend(_cur=F.coalesce("_cur", F.lit(0)))

    def starts(w):
        new = (C("rn") == 1) | (C("_cur") != R.prev(C("_cur"), w))
        return {"_at": F.when(new, C("rn"))}

    marked = signed.apply(Recipe(("_at",), (starts,), ("_cur",), 1), keep=[*keep, "_cur"])
    done = marked.running(keep=[*keep, "_cur"], _from=("last", "_at"))
    value = C("_cur") * (C("rn") - C("_from") + 1)
    res = done.df.withColumn(out, value.cast("int"))
    return done.with_df(res.select(*dict.fromkeys([*tl.by, "rn", *keep, out])))


def feature_columns(volume: bool = True) -> list[str]:
    cols = [
        "pct_change", "RSI_pct", "Stoch_K_pct", "Stoch_D_pct", "MACD_pct", "MACD_Signal_pct", "MACD_Hist_pct",
        "BB_Upper_pct", "BB_Lower_pct", "BB_Width_pct",
        *(f"{c}_pct_lag_{k}" for k in range(1, 6) for c in ("open", "high", "low", "close")),
        "RSI", "AO", "WR", "ROC", "UO_7_14_28", "TSI_25_13", "TSIs_25_13", "Stoch_K", "Stoch_D", "KAMA",
        "MACD", "MACD_Signal", "MACD_Hist", "ADX_14", "DMP_14", "DMN_14", "AROONU_14", "AROOND_14", "CCI",
        "STC_10_23_50", "STCst_10_23_50", "VTXP_14", "VTXM_14", "VORTEX_diff",
        "returns_roll_sum", "returns_roll_mean", "returns_roll_std", "returns_z_score", "BBP", "KCP", "DCP",
        *(f"above_ema_{e}" for e in EMA_SPANS), "run",
    ]
    return cols + ["MFI_pct", "avg_volume_20", "VO", "VPT", "CMF"] if volume else cols


def create_features(tl: Timeline, fill: str | None = "reference", volume: bool | None = None) -> Timeline:
    """About 75 technical columns per row, next to the key, time and candle columns.

    ``fill="reference"`` fills forward, then backward, then with 0; ``"causal"``
    leaves the backward fill out; ``"older"`` fills backward first; ``None``
    leaves warm-up rows null.  Look-back columns share one shuffle, smoothed
    columns one Arrow pass; the slow or endless memories (KAMA, running sum, run)
    use exact carries.
    """
    volume = ("Volume" in tl.df.columns) if volume is None else volume
    base, keys = list(tl.df.columns), [*tl.by, "rn"]
    # long memories on the narrowest possible series
    slim = tl.settle(base).narrow("Close", *(["Volume"] if volume else []))
    long = kama(slim, out="KAMA")
    extra = ["KAMA", "run"]
    if volume:
        long = volume_price_trend(long, out="VPT")
        extra.append("VPT")
    long = long.apply(I.pct_change("Close", 1, "pct_change", 0.0))
    long = run_length(long, "pct_change", "run", ["pct_change", *(c for c in extra if c != "run")])
    cur = tl.with_df(tl.df.join(long.df, keys))
    cur = smoothed_features(cur, keep=list(cur.df.columns))
    cur = cur.apply(*_bounded(volume), keep=list(cur.df.columns))
    close = C("Close")
    cur = cur.extend(
        BB_Width_pct=F.try_divide(C("BB_Upper_pct") - C("BB_Lower_pct"), C("returns_roll_mean")),
        VORTEX_diff=C("VTXP_14") - C("VTXM_14"),
        KCP=F.try_divide(close - C("_kcl"), C("_kcu") - C("_kcl")),
        DCP=F.try_divide(close - C("_dcl"), C("_dcu") - C("_dcl")),
        **{f"above_ema_{e}": F.when(close > C(f"_ema_{e}"), 1).otherwise(0) for e in EMA_SPANS},
    )
    cols = feature_columns(volume)
    cur = cur.with_df(cur.df.select(*dict.fromkeys([*keys, *base, *cols])))
    if fill is None:
        return cur
    order = {"reference": ("ffill", "bfill"), "causal": ("ffill",), "older": ("bfill", "ffill")}[fill]
    return fills.fill(cur.settle(), cols, order, zero=fill != "older")


def small_features(tl: Timeline) -> Timeline:
    """Compact set filled backward, then forward."""
    cur = tl.apply(*I.compact_features(), keep=[*tl.order, "Close"])
    cols = ["rsi", "momentum", "volatility", "lagged_return", "sma_ratio", "bb_width"]
    ready = cur.settle()
    return fills.fill(ready, cols, ("bfill", "ffill"), zero=False)


def analysis_features(tl: Timeline, volume: str = "Volume", window: int = 20) -> Timeline:
    """Changes over 1..7 rows, volatility, running maximum and its age, average spread, next sign.

    Complete rows only.
    """
    lags = range(1, 8)

    def s1(w):
        out = {f"price_pct_change_lag_{k}": R.pct(C("Close"), w, k) for k in lags}
        out |= {f"volume_pct_change_lag_{k}": R.pct(C(volume), w, k) for k in lags}
        out["_nxt"] = R.following(C("Close"), w) / C("Close") - 1
        slow = R.mean(C("Close"), 200, w)
        out["ma_diff_pct"] = F.try_divide(R.mean(C("Close"), 100, w) - slow, slow)
        return out

    def s2(w):
        return {
            "volatility": R.std(C("price_pct_change_lag_1"), window, w),
            "target": F.signum("_nxt").cast("int"),
        }

    names = [f"{p}_pct_change_lag_{k}" for p in ("price", "volume") for k in lags]
    outs = (*names, "ma_diff_pct", "volatility", "target")
    cur = tl.apply(Recipe(outs, (s1, s2), ("Close", volume), 200, 1), keep=[*tl.order, "Close"])
    cur = cur.running(max_close=("max", "Close")).extend(
        _peak=F.when(C("Close") == C("max_close"), C("rn"))
    )
    done = cur.running(_at=("last", "_peak"))
    df = done.df.withColumn("periods_since_max", C("rn") - C("_at")).drop("_at", "_peak")
    return done.with_df(df.na.drop())
