"""The bars -> features -> labels -> folds dataflow as three replaceable steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.lookup import attach
from tidewheel.operators import bars as B
from tidewheel.operators import features as X
from tidewheel.operators import indicators as I
from tidewheel.operators import labels as L
from tidewheel.operators import weights as W
from tidewheel.operators.sweeps import sweep_bars
from tidewheel.plans import ml, splits
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

C = F.col


@dataclass(frozen=True)
class Steps:
    """Three functions: raw series to bars, bars to features, bars to labels.

    The label table carries ``rn``, ``label``, ``weight`` and ``t1``.
    """

    bars: Callable[[Timeline], Timeline]
    features: Callable[[Timeline], Timeline]
    labels: Callable[[Timeline], DataFrame]
    feature_names: Sequence[str] = field(default_factory=tuple)

    def table(self, raw: Timeline) -> tuple[Timeline, DataFrame]:
        """Bars and the aligned (inner joined) modelling table."""
        series = self.bars(raw)
        feats = self.features(series).df
        names = list(self.feature_names) or [c for c in feats.columns if c not in (*series.by, *series.order, "rn")]
        labelled = self.labels(series).select(*series.by, "rn", "label", "weight", "t1")
        joined = feats.select(*series.by, *series.order, "rn", *names).join(labelled, [*series.by, "rn"])
        return series, joined.na.drop()


def bar_series(bars: DataFrame, by: Sequence[str], chunk_rows: int) -> Timeline:
    """Closed bars as a series: bar numbers are gapless, so no new numbering is needed."""
    named = bars.withColumns({"rn": C("bar_id") + 1, "seq": C("bar_id")})
    return Timeline(materialize(named, "bars"), tuple(by), ("ts", "seq"), chunk_rows, True)


def reversal_steps(volume_threshold: float, tau: float = 0.35, features: Sequence[str] = ()) -> Steps:
    """Volume bars, technical features and next-bar reversal labels with balanced weights."""

    def bars(raw: Timeline) -> Timeline:
        b = B.extended_volume_bars(raw, volume_threshold).withColumnsRenamed(
            {"open_price": "Open", "close_price": "Close", "total_volume": "Volume", "close_time": "ts"}
        )
        return bar_series(b, raw.by, raw.chunk_rows)

    def feats(series: Timeline) -> Timeline:
        made = X.create_features(series, fill="older")
        return made.apply(I.bar_lag_features())

    def labels(series: Timeline) -> DataFrame:
        found = L.reversal_labels(series, tau)
        return W.class_weights(found, "label", "weight")

    return Steps(bars, feats, labels, features)


def barrier_steps(dollar_threshold: float, profit: float, loss: float, days: int, min_ret: float, features: Sequence[str] = ()) -> Steps:
    """Dollar bars, features and event labels weighted by uniqueness and return."""

    def bars(raw: Timeline) -> Timeline:
        return bar_series(B.dollar_bars(raw, dollar_threshold), raw.by, raw.chunk_rows)

    def labels(series: Timeline) -> DataFrame:
        vol = L.daily_volatility(series)
        vol = vol.settle()
        t1 = L.vertical_barrier(series, days)
        events = L.barrier_events(vol, "daily_vol", min_ret, t1, profit, loss)
        found = materialize(L.event_bins(series, events), "events")
        weighted = W.sample_weights(series, found)
        lab = F.when(C("bin") > 0, 1).otherwise(0)
        return weighted.select(*series.by, C("start_rn").alias("rn"), lab.alias("label"), C("sample_weight").alias("weight"), "t1")

    return Steps(bars, lambda s: X.create_features(s), labels, features)


def run_cv(steps: Steps, raw: Timeline, make, n_splits: int = 3, embargo: float = 0.01):
    """Steps, purged folds, a model per fold; returns (folds, predictions, scores)."""
    series, table = steps.table(raw)
    ready = Timeline.build(materialize(table.drop("rn"), "table"), series.by, series.order, raw.chunk_rows)
    folds = splits.fold_set(ready, n_splits, "t1", embargo)
    pred, scores = ml.cross_validate(folds, make, [*series.by, "rn"])
    return folds, pred, scores


def run_combinatorial(steps: Steps, raw: Timeline, make, n_groups: int = 10, k: int = 2, embargo: float = 0.01):
    """Steps, time groups, every purged combinatorial split, F1 per path."""
    series, table = steps.table(raw)
    spark = raw.df.sparkSession
    folds = splits.combinatorial_set(materialize(table, "table"), n_groups, k, series.by, embargo=embargo)
    paths = splits.backtest_paths(spark, n_groups, k)
    return ml.combinatorial_cv(folds, paths, make, [*series.by, "rn"])


def sweep(tl: Timeline, grid: DataFrame, metric: str, threshold: Column, min_bars: int = 10) -> DataFrame:
    """Threshold bars for every grid row (``param_id`` first) with a guard on the bar count; rows are read once for all."""
    keys = [*tl.by, "param_id"]
    # the grid is a parameter, the keys are as many as series
    plan = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r.asDict().items())) for r in grid.collect()))
    each = tl.rows_per_key().select(*tl.by, F.inline(plan)).withColumn("threshold", threshold)
    bars = materialize(sweep_bars(tl, metric, each, "param_id"), "bars")
    enough = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars")).where(C("n_bars") >= min_bars)
    return attach(bars, enough, keys)
