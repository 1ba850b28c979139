"""Queries: splits, overfitting, models, importance and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewheel.catalog import (
    CHUNK_ROWS, DAILY, ONE, PART, SQL, TICKS, C, daily, final, lag, lead, one, query, roll, shape, six_places, ticks,
)
from tidewheel.catalog_bars import SIGNS, bar_sql, dyn_sql
from tidewheel.catalog_indicators import DAY, MACD, crossing, pct
from tidewheel.catalog_labels import _FIX, CUSUM, fixed
from tidewheel.operators import features as X
from tidewheel.operators import indicators as I
from tidewheel.operators import labels as L
from tidewheel.operators import signals as G
from tidewheel.operators import stats as S
from tidewheel.plans import ml, overfit, pipeline, splits
from tidewheel.sources import views
from tidewheel.storage import materialize, shared_dir
from tidewheel.streaming import live
from tidewheel.timeline import Timeline

SPLIT_KEYS = ("symbol", "seq", "role")
LAB = f"lb AS MATERIALIZED (SELECT *, event_end_time AS t1, count(*) OVER (PARTITION BY symbol) AS n_rows FROM ({_FIX}) AS f)"


def labelled(spark, sf) -> Timeline:
    """Fixed-horizon labels; their row numbers start at 1 and have no gap."""
    df = fixed(spark, sf).withColumnRenamed("event_end_time", "t1")
    return Timeline(materialize(df, "labels"), ("symbol",), ("ts", "seq"), CHUNK_ROWS, True)


FOLD = "CASE WHEN rn - 1 < (n_rows % 4) * (n_rows // 4 + 1) THEN (rn - 1) // (n_rows // 4 + 1) ELSE n_rows % 4 + (rn - 1 - (n_rows % 4) * (n_rows // 4 + 1)) // (n_rows // 4) END"
PURGED = f"""SELECT a.symbol, a.seq, a.rn, a.label, f.fold, CASE WHEN a.fold = f.fold THEN 'test' ELSE 'train' END AS role FROM (SELECT *, {FOLD} AS fold FROM lb) AS a JOIN
  (SELECT g.*, (SELECT count(*) FROM lb x WHERE x.symbol = g.symbol AND x.ts < g.latest) + 1 + floor(g.n * 0.01) AS resume FROM (SELECT symbol, fold, min(ts) AS start, max(t1) AS latest, any_value(n_rows) AS n FROM (SELECT *, {FOLD} AS fold FROM lb) AS q GROUP BY 1, 2) AS g) AS f USING (symbol)
  WHERE a.fold = f.fold OR a.t1 < f.start OR a.rn >= f.resume"""


@query("purged_folds", final(PURGED, (TICKS, LAB), SPLIT_KEYS, i=["fold"]))
def _pk(spark, sf):
    return shape(splits.purged_folds(labelled(spark, sf), 4, "t1", 0.01), SPLIT_KEYS, i=["fold"])


GRP = "gr AS MATERIALIZED (SELECT *, least((epoch_us(ts) - min(epoch_us(ts)) OVER p) * 6 // greatest(max(epoch_us(ts)) OVER p - min(epoch_us(ts)) OVER p, 1), 5) AS grp FROM lb WINDOW p AS (PARTITION BY symbol))"


@query("time_groups", final("SELECT * FROM gr", (TICKS, LAB, GRP), i=["grp"]))
def _tg(spark, sf):
    return shape(splits.time_groups(labelled(spark, sf).df, 6), i=["grp"])


COMB = "cb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM (SELECT x.k AS a, y.k AS b FROM (SELECT unnest(range(0, 6)) AS k) AS x JOIN (SELECT unnest(range(0, 6)) AS k) AS y ON x.k < y.k) AS q)"


@query("combinatorial_splits", final("SELECT s.symbol, cb.split, cb.a, cb.b FROM cb CROSS JOIN (SELECT DISTINCT symbol FROM ticks) AS s", (TICKS, COMB), ("symbol",), i=["split", "a", "b"]))
def _cs(spark, sf):
    plan = splits.combinatorial_splits(spark, 6, 2).select("split", C("test")[0].alias("a"), C("test")[1].alias("b"))
    keys = views.ticks(spark, sf).select("symbol").distinct()
    return shape(keys.join(F.broadcast(plan)), ("symbol",), i=["split", "a", "b"])


_rng = "rg AS MATERIALIZED (SELECT symbol, grp, min(ts) AS lo, max(ts) AS hi FROM gr GROUP BY 1, 2)"
_span = "sp AS MATERIALIZED (SELECT symbol, date_diff('microsecond', min(ts), max(ts)) * 0.01 AS pause FROM gr GROUP BY 1)"


def _hit(strict):
    enclose = " OR (g.ts < r.lo AND g.t1 > r.hi)" if strict else ""
    return f"EXISTS (SELECT 1 FROM rg r WHERE r.symbol = g.symbol AND (r.grp = c.a OR r.grp = c.b) AND (g.ts BETWEEN r.lo AND r.hi OR g.t1 BETWEEN r.lo AND r.hi{enclose} OR (g.ts > r.hi AND date_diff('microsecond', r.hi, g.ts) <= s.pause)))"


CPCV = "SELECT symbol, seq, split, role FROM (SELECT g.symbol, g.seq, c.split, CASE WHEN g.grp = c.a OR g.grp = c.b THEN 'test' WHEN NOT {hit} THEN 'train' END AS role FROM gr g CROSS JOIN cb c JOIN sp s ON s.symbol = g.symbol) AS q WHERE role IS NOT NULL"


def grouped(spark, sf):
    return splits.time_groups(labelled(spark, sf).df, 6), splits.combinatorial_splits(spark, 6, 2)


@query("purged_splits", final(CPCV.format(hit=_hit(True)), (TICKS, LAB, GRP, COMB, _rng, _span), SPLIT_KEYS, i=["split"]))
def _ps(spark, sf):
    g, plan = grouped(spark, sf)
    return shape(splits.purged_splits(g, plan, embargo=0.01), SPLIT_KEYS, i=["split"])


@query("purged_splits_end_points", final(CPCV.format(hit=_hit(False)), (TICKS, LAB, GRP, COMB, _rng, _span), SPLIT_KEYS, i=["split"]))
def _ps2(spark, sf):
    g, plan = grouped(spark, sf)
    return shape(splits.purged_splits(g, plan, embargo=0.01, strict=False), SPLIT_KEYS, i=["split"])


@query("backtest_paths", final(
    "SELECT g.symbol, g.seq, p.path, p.split FROM gr g JOIN (SELECT split, grp, row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path FROM (SELECT split, a AS grp FROM cb UNION ALL SELECT split, b FROM cb) AS u) AS p USING (grp)",
    (TICKS, LAB, GRP, COMB), i=["path", "split"]))
def _paths(spark, sf):
    g, _plan = grouped(spark, sf)
    return shape(g.join(F.broadcast(splits.backtest_paths(spark, 6, 2)), "grp"), i=["path", "split"])


@query("partition_paths")
def _paths2(spark, sf):
    g, _plan = grouped(spark, sf)
    return shape(g.join(F.broadcast(splits.backtest_paths(spark, 6, 2, "partition")), "grp"), i=["path", "split"])


WF = "SELECT symbol, seq, rn, floor((rn - cut - 1) / 100) AS block, greatest(1, cut + floor((rn - cut - 1) / 100) * 100 - 500 + 1) AS train_from, cut + floor((rn - cut - 1) / 100) * 100 AS train_to FROM (SELECT *, floor(count(*) OVER (PARTITION BY symbol) * 0.7) AS cut FROM ticks) AS q WHERE rn > cut"


@query("walk_forward_blocks", final(WF, i=["block", "train_from", "train_to"]))
def _wf(spark, sf):
    return shape(splits.walk_forward_blocks(ticks(spark, sf), 0.3, 100, 500), i=["block", "train_from", "train_to"])


SEG = "SELECT symbol, seq, dense_rank() OVER (PARTITION BY symbol ORDER BY isle) - 1 AS segment, TIMESTAMP '2000-01-01' + to_minutes(CAST(rn - min(rn) OVER (PARTITION BY symbol, isle) AS BIGINT)) AS clock FROM (SELECT *, rn - row_number() OVER (PARTITION BY symbol ORDER BY rn) AS isle FROM ticks WHERE volume > 30) AS q"


@query("training_segments", final(SEG, (TICKS,), ("symbol", "seq", "clock"), i=["segment"]))
def _seg(spark, sf):
    df = ticks(spark, sf).df.where(C("Volume") > 30)
    return shape(splits.training_segments(df, ["symbol"], chunk_rows=CHUNK_ROWS), ("symbol", "seq", "clock"), i=["segment"])


# ------------------------------------------------------------- parameter grid, PBO
GRID = [(i, s, l, p) for i, (s, l, p) in enumerate((s, l, p) for s in (10, 20) for l in (50, 100) for p in (0.01, 0.02))]


def grid_returns(spark, sf):
    grid = spark.createDataFrame(GRID, "config int, short int, long int, stop double")
    return G.cross_grid(daily(spark, sf), grid)


_gv = ", ".join(f"({i}, {s}, {l}, {p})" for i, s, l, p in GRID)
GRIDQ = f"""cg(config, short, long, stop) AS (VALUES {_gv}),
ma AS MATERIALIZED (SELECT *, {pct} AS r, {roll('avg', 'close', 10)} AS m10, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 50)} AS m50, {roll('avg', 'close', 100)} AS m100 FROM bars),
mx AS MATERIALIZED (SELECT ma.*, config, stop, CASE WHEN short = 10 THEN m10 ELSE m20 END AS a, CASE WHEN long = 50 THEN m50 ELSE m100 END AS b FROM ma CROSS JOIN cg),
sd AS MATERIALIZED (SELECT *, CASE WHEN a > b AND lag(a) OVER p < lag(b) OVER p THEN 1 WHEN a < b AND lag(a) OVER p > lag(b) OVER p THEN -1 END AS x FROM mx WINDOW p AS (PARTITION BY symbol, config ORDER BY rn)),
hd AS MATERIALIZED (SELECT *, last_value(x IGNORE NULLS) OVER p AS side, last_value(CASE WHEN x IS NOT NULL THEN close END IGNORE NULLS) OVER p AS entry, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS frm FROM sd WINDOW p AS (PARTITION BY symbol, config ORDER BY rn)),
so AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN side * (close / entry - 1) <= -stop THEN rn END IGNORE NULLS) OVER p >= frm, false) AS out FROM hd WINDOW p AS (PARTITION BY symbol, config ORDER BY rn)),
pm AS MATERIALIZED (SELECT symbol, config, ts, rn, coalesce(lag(CASE WHEN out THEN 0 ELSE coalesce(side, 0) END) OVER p * r, 0) AS ret FROM so WINDOW p AS (PARTITION BY symbol, config ORDER BY rn))"""


@query("performance_matrix", final("SELECT * FROM pm", (DAILY, GRIDQ), DAY, ["ret"], ["config"]))
def _pm(spark, sf):
    return shape(grid_returns(spark, sf), DAY, ["ret"], ["config"])


@query("grid_sharpe", final("SELECT symbol, config, avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe FROM pm GROUP BY 1, 2", (DAILY, GRIDQ), ("symbol",), ["sharpe"], ["config"]))
def _gs(spark, sf):
    return shape(S.path_sharpe(grid_returns(spark, sf), ["symbol", "config"], periods=365), ("symbol",), ["sharpe"], ["config"])


@query("best_config", final("SELECT symbol, arg_max(config, (s, -config)) AS best FROM (SELECT symbol, config, round(avg(ret) / stddev_samp(ret), 12) AS s FROM pm GROUP BY 1, 2) AS q GROUP BY 1", (DAILY, GRIDQ), ("symbol",), i=["best"]))
def _bc(spark, sf):
    score = S.path_sharpe(grid_returns(spark, sf), ["symbol", "config"], periods=1)
    return shape(overfit.best_config(score.withColumn("sharpe", F.round("sharpe", 12)), "sharpe", by=["symbol"]), ("symbol",), i=["best"])


def perf(spark, sf) -> Timeline:
    df = materialize(grid_returns(spark, sf).select("symbol", "config", "ts", "ret", "rn"), "performance")
    return Timeline(df, ("symbol", "config"), ("ts",), CHUNK_ROWS, True)


PBO = """bk AS MATERIALIZED (SELECT symbol, config, (rn - 1) // (n // 16) AS blk, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM (SELECT *, count(*) OVER (PARTITION BY symbol, config) AS n FROM pm) AS z WHERE (rn - 1) // (n // 16) < 16 GROUP BY 1, 2, 3),
ch AS MATERIALIZED (SELECT m AS choice, (m >> b) & 1 AS ins, b AS blk FROM range(65536) AS r(m), range(16) AS t(b) WHERE bit_count(CAST(m AS INT)) = 8),
sc AS MATERIALIZED (SELECT symbol, choice, config, ins, round((sum(s) / sum(n)) / sqrt((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1)), 12) AS sharpe FROM ch JOIN bk USING (blk) GROUP BY 1, 2, 3, 4),
om AS MATERIALIZED (SELECT symbol, choice, best, (9 - rk) / 9.0 AS omega FROM (SELECT symbol, choice, config AS best, row_number() OVER (PARTITION BY symbol, choice ORDER BY o DESC, config) AS rk, row_number() OVER (PARTITION BY symbol, choice ORDER BY i DESC, config) AS ri FROM (SELECT symbol, choice, config, coalesce(max(sharpe) FILTER (ins = 1), 0) AS i, coalesce(max(sharpe) FILTER (ins = 0), 0) AS o FROM sc GROUP BY 1, 2, 3) AS q) AS w WHERE ri = 1)"""


@query("symmetric_cv", final("SELECT * FROM om", (DAILY, GRIDQ, PBO), ("symbol",), ["omega"], ["choice", "best"]))
def _cscv(spark, sf):
    """All 12 870 choices of 8 among 16 blocks, for every flag."""
    return shape(overfit.symmetric_cv(perf(spark, sf), 16), ("symbol",), ["omega"], ["choice", "best"])


@query("overfitting_probability", final("SELECT symbol, avg(CASE WHEN omega < 0.5 THEN 1.0 ELSE 0.0 END) AS pbo, count(*) AS choices FROM om GROUP BY 1", (DAILY, GRIDQ, PBO), ("symbol",), ["pbo"], ["choices"]))
def _pbo(spark, sf):
    return shape(overfit.overfitting_probability(overfit.symmetric_cv(perf(spark, sf), 16), ["symbol"]), ("symbol",), ["pbo"], ["choices"])


@query("forecast_direction", final(f"SELECT symbol, ts, CASE WHEN close > p THEN 1 ELSE 0 END AS true_dir, CASE WHEN f > p THEN 1 ELSE 0 END AS pred_dir FROM (SELECT *, {lag('close')} AS p, open AS f FROM bars) AS q WHERE p IS NOT NULL", (DAILY,), DAY, i=["true_dir", "pred_dir"]))
def _fd(spark, sf):
    return shape(ml.forecast_direction(daily(spark, sf), "Close", "Open"), DAY, i=["true_dir", "pred_dir"])


@query("meta_decision", final("SELECT symbol, seq, CASE WHEN close > 140 AND volume > 40 THEN 1 ELSE 0 END AS final FROM ticks", i=["final"]))
def _md(spark, sf):
    df = views.ticks(spark, sf).withColumns({"pred": (C("Close") > 140).cast("int"), "meta_pred": (C("Volume") > 40).cast("int")})
    return shape(ml.meta_decision(df), i=["final"])


# ---------------------------------------------------------------------- models
FEATS = ["ret", "gap", "vol", "z"]


def model_table(spark, sf) -> Timeline:
    """Daily candles with four features, the direction of the next close and its end."""

    def s1(w):
        return {"ret": C("Close") / F.lag("Close").over(w) - 1, "gap": C("Open") / F.lag("Close").over(w) - 1,
                "nxt": F.lead("Close").over(w), "t1": F.lead("ts").over(w)}

    tl = daily(spark, sf).compute(s1, back=1, fwd=1)
    tl = tl.apply(I.rolling_std("Close", 10, "vol"), I.rolling_z_score("Close", 20, "z"))
    df = tl.df.where(C("nxt").isNotNull()).na.drop(subset=FEATS)
    df = df.withColumn("label", (C("nxt") > C("Close")).cast("int")).select("symbol", "ts", "seq", "label", "t1", *FEATS)
    done = Timeline.build(df, chunk_rows=CHUNK_ROWS)
    return done.settle()


def forest():
    return ml.scaled_pipeline(FEATS, ml.random_forest(trees=5, depth=3))


@query("cross_validation")
def _cv(spark, sf):
    folds = splits.fold_set(model_table(spark, sf), 3, "t1", 0.01)
    pred, scores = ml.cross_validate(folds, forest, ["symbol", "ts"])
    return shape(scores, (), ["f1_weighted"], ["fold"])


@query("out_of_fold_predictions")
def _oof(spark, sf):
    folds = splits.fold_set(model_table(spark, sf), 3, "t1", 0.01)
    pred = ml.out_of_fold(folds, lambda: ml.scaled_pipeline(FEATS, ml.boosted_trees(rounds=3)), ["symbol", "ts", "label"])
    return shape(pred.withColumn("p1", C("prob")[1]), DAY, ["p1"], ["fold", "label", "pred"])


_G10 = GRP.replace("* 6 //", "* 10 //").replace(", 5) AS grp", ", 9) AS grp")
_C10 = COMB.replace("range(0, 6)", "range(0, 10)")


@query("combinatorial_sizes", final(
    f"SELECT split, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM ({CPCV.format(hit=_hit(True))}) AS z GROUP BY 1",
    (TICKS, LAB, _G10, _C10, _rng, _span), (), i=["split", "n_train", "n_test"]))
def _csz(spark, sf):
    """Ten time groups, two of them tested: 45 splits over rows that are written once."""
    return shape(splits.combinatorial_set(labelled(spark, sf).df, 10, 2, embargo=0.01).sizes(), (), i=["split", "n_train", "n_test"])


@query("fold_sizes", final(f"SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM ({PURGED}) AS z GROUP BY 1", (TICKS, LAB), (), i=["fold", "n_train", "n_test"]))
def _fsz(spark, sf):
    return shape(splits.fold_set(labelled(spark, sf), 4, "t1", 0.01).sizes(), (), i=["fold", "n_train", "n_test"])


@query("combinatorial_cv")
def _ccv(spark, sf):
    folds = splits.combinatorial_set(model_table(spark, sf).df, 10, 2, embargo=0.01)
    _j, scores, _s = ml.combinatorial_cv(folds, splits.backtest_paths(spark, 10, 2), forest, ["symbol", "ts"])
    return shape(scores, (), ["f1_weighted"], ["path"])


@query("walk_forward")
def _wfm(spark, sf):
    tl = model_table(spark, sf)
    blocks = splits.walk_forward_blocks(tl, 0.3, 400)
    n = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    pred = ml.walk_forward(tl, blocks, int(n), lambda: ml.scaled_pipeline(FEATS, ml.random_forest(weight="weight", trees=5, depth=3)), ["symbol", "ts"])
    return shape(pred, DAY, i=["block", "label", "pred"])


@query("meta_labelling")
def _meta(spark, sf):
    folds = splits.fold_set(model_table(spark, sf), 3, "t1", 0.01)
    second = lambda: ml.scaled_pipeline(FEATS, ml.random_forest("meta_label", trees=5, depth=3))
    _d, rep = ml.meta_label_run(folds, forest, second, ["symbol", "ts"], FEATS)
    return shape(rep, ("model", "row"), ["precision", "recall", "f1"], ["support"])


@query("impurity_importance")
def _mdi(spark, sf):
    return shape(ml.impurity_importance(model_table(spark, sf).df, FEATS, trees=5), ("feature",), ["importance"])


@query("permutation_importance")
def _mda(spark, sf):
    folds = splits.fold_set(model_table(spark, sf), 3, "t1", 0.01)
    return shape(ml.permutation_importance(folds, FEATS, ml.random_forest(trees=5, depth=3), ["symbol", "ts"]), ("feature",), ["importance"])


@query("single_feature_importance")
def _sfi(spark, sf):
    folds = splits.fold_set(model_table(spark, sf), 3, "t1", 0.01)
    return shape(ml.single_feature_importance(folds, FEATS, ml.random_forest(trees=3, depth=3), ["symbol", "ts"]), ("feature",), ["importance"])


@query("orthogonal_importance")
def _ortho(spark, sf):
    return shape(ml.orthogonal_importance(model_table(spark, sf).df, FEATS, trees=5), ("component",), ["importance", "explained_variance"])


@query("population_scaling", final(f"SELECT symbol, seq, (close - avg(close) OVER ()) / stddev_pop(close) OVER () AS close FROM ticks", d=["close"]))
def _scale(spark, sf):
    df = views.ticks(spark, sf)
    return shape(ml.population_scale(df, df, ["Close"]), d=["Close"])


@query("label_indexer", "SELECT event_id AS seq, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM events")
def _ix(spark, sf):
    df = views.table(spark, sf, "events").select(C("event_id").alias("seq"), "event_type")
    return ml.label_indexer("event_type", "code").fit(df).transform(df).select("seq", C("code").cast("bigint").alias("code"))


@query("reversal_workflow")
def _flow(spark, sf):
    """Volume bars, features, reversal labels, purged folds, a model per fold."""
    steps = pipeline.reversal_steps(1000, features=("RSI", "MACD", "run", "lag_return"))
    make = lambda: ml.scaled_pipeline(steps.feature_names, ml.random_forest(weight="weight", trees=5, depth=3))
    _rows, _pred, scores = pipeline.run_cv(steps, one(spark, sf), make)
    return shape(scores, (), ["f1_weighted"], ["fold"])


@query("barrier_workflow")
def _flow2(spark, sf):
    """Dollar bars, features, event labels with uniqueness weights, combinatorial splits."""
    steps = pipeline.barrier_steps(200_000, 0.05, 0.05, 1, 0.0, features=("RSI", "MACD", "run"))
    make = lambda: ml.scaled_pipeline(steps.feature_names, ml.random_forest(weight="weight", trees=3, depth=3))
    _j, scores, _s = pipeline.run_combinatorial(steps, one(spark, sf), make, 4, 2)
    return shape(scores, (), ["f1_weighted"], ["path"])


# --------------------------------------------------------------------- streams
_SLOTS = 5


def tick_stream(spark, sf):
    """The tick table as a stream of files in which a quarter of all ticks comes one file late; (stream, bucket width).

    The files overlap by less than the watermark's delay; the last one is a heartbeat that closes the stream.
    """
    ticks = views.ticks(spark, sf)
    first, last = ticks.agg(F.min(F.unix_seconds(C("ts").cast("timestamp"))), F.max(F.unix_seconds(C("ts").cast("timestamp")))).head()
    width = (last - first) // _SLOTS + 1
    slot = F.floor((F.unix_seconds(C("ts").cast("timestamp")) - first) / width)
    dealt = materialize(ticks.withColumn("slot", slot + F.when(F.pmod(F.xxhash64("seq"), F.lit(4)) == 0, 1).otherwise(0)), "ticks")
    folder = f"{shared_dir(spark)}/tick-files-{uuid.uuid4().hex}"
    for k in range(_SLOTS + 1):  # a file source reads in order of writing
        dealt.where(C("slot") == k).drop("slot").orderBy(F.xxhash64("seq")).coalesce(2).write.mode("append").parquet(folder)
    ends = F.timestamp_seconds(F.lit(last + 3 * width)).cast("timestamp_ntz")
    dealt.select(*(F.lit(None).cast(t).alias(n) for n, t in ticks.dtypes)).withColumn("ts", ends).limit(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    return live.candle_stream(raw, f"{width} seconds"), f"{width // 16 + 1} seconds"


def drain(spark, stream, mode="append"):
    """Run a stream over the available files into a table and read it back."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_vb = bar_sql((TICKS,), "ticks", "b.volume", 500)
_SB = ["open", "high", "low", "close", "volume"]


@query("stream_volume_bars", final(_vb[1], _vb[0], ("symbol", "bar_id", "ts"), _SB, ["trade_count"]))
def _svb(spark, sf):
    stream, bucket = tick_stream(spark, sf)
    got = drain(spark, live.threshold_bars(stream, "Volume", 500, bucket)).where(C("kind") == "bar")
    got = got.withColumn("ts", C("ts").cast("timestamp_ntz"))
    return shape(got, ("symbol", "bar_id", "ts"), ["Open", "High", "Low", "Close", "Volume"], ["trade_count"])


@query("stream_dollar_bars", final(bar_sql((TICKS,), "ticks", "b.volume_usdt", 100_000)[1], bar_sql((TICKS,), "ticks", "b.volume_usdt", 100_000)[0], ("symbol", "bar_id", "ts"), _SB, ["trade_count"]))
def _sdb(spark, sf):
    stream, bucket = tick_stream(spark, sf)
    got = drain(spark, live.threshold_bars(stream, "volume_usdt", 100_000, bucket)).withColumn("ts", C("ts").cast("timestamp_ntz"))
    return shape(got, ("symbol", "bar_id", "ts"), ["Open", "High", "Low", "Close", "Volume"], ["trade_count"])


@query("stream_cusum_events", final("SELECT b.symbol, b.seq, 1 AS one FROM dv b JOIN e USING (symbol, rn) WHERE e.c = 1", (TICKS, *CUSUM), i=["one"]))
def _sce(spark, sf):
    stream, bucket = tick_stream(spark, sf)
    got = drain(spark, live.cusum_events(stream, 60, bucket)).where(C("kind") == "event")
    return shape(got.withColumn("one", F.lit(1)), i=["one"])


@query("stream_macd_signals", final(
    f"SELECT symbol, seq, l AS macd, g AS macd_signal, {crossing('l', 'g', False)} AS action FROM (SELECT t.*, e.f - e.s AS l, e.g FROM ticks t JOIN e USING (symbol, rn)) AS q QUALIFY rn >= 35",
    (TICKS, MACD.replace("{0}", "ticks")), d=["macd", "macd_signal"], i=["action"]))
def _sms(spark, sf):
    stream, bucket = tick_stream(spark, sf)
    got = drain(spark, live.macd_signals(stream, bucket=bucket)).where(C("kind") == "signal")
    code = F.when(C("action") == "BUY", 1).when(C("action") == "SELL", -1).otherwise(0)
    return shape(got.withColumn("action", code), d=["macd", "macd_signal"], i=["action"])


@query("stream_imbalance_bars", dyn_sql((TICKS, SIGNS), "b.sg", "5", "1", closed_only=True))
def _sib(spark, sf):
    stream, bucket = tick_stream(spark, sf)
    got = drain(spark, live.imbalance_bars(stream, 5, bucket=bucket)).where(C("kind") == "bar")
    return shape(got, d=["threshold", "cum_imbalance"], i=["size"])


_TB = """SELECT symbol, date_trunc('day', ts) AS bucket, arg_min(open, (ts, seq)) AS open, max(high) AS high, min(low) AS low, arg_max(close, (ts, seq)) AS close,
  sum(volume) AS volume, sum(trade_count) AS trade_count FROM ticks GROUP BY 1, 2"""


@query("stream_time_bars", final(_TB, keys=("symbol", "bucket"), d=_SB, i=["trade_count"]))
def _stb(spark, sf):
    got = drain(spark, live.time_bars(tick_stream(spark, sf)[0]))
    got = got.withColumn("bucket", C("bucket").cast("timestamp_ntz"))
    return shape(got, ("symbol", "bucket"), ["Open", "High", "Low", "Close", "Volume"], ["trade_count"])
