"""Models on split tables with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.lookup import attach
from tidewheel.operators import stats, weights
from tidewheel.plans.splits import SplitRows
from tidewheel.storage import materialize
from tidewheel.timeline import Timeline

C = F.col
POOL = 4


def random_forest(label: str = "label", weight: str | None = None, trees: int = 50, depth: int = 5, subset: str = "auto", seed: int = 42):
    kw = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
        featureSubsetStrategy=subset, seed=seed, **kw,
    )


def boosted_trees(label: str = "label", weight: str | None = None, rounds: int = 20, seed: int = 42, classes: int = 2):
    kw = {"weightCol": weight} if weight else {}
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed, **kw)
    if classes == 2:
        return gbt
    return OneVsRest(classifier=gbt, featuresCol="features", labelCol=label, **kw)


def linear_svm(label: str = "label", weight: str | None = None):
    kw = {"weightCol": weight} if weight else {}
    return LinearSVC(featuresCol="features", labelCol=label, **kw)


def label_indexer(label: str, out: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def standardize(features: str = "features", out: str = "scaled") -> StandardScaler:
    """Sample-deviation scaling; :func:`population_factor` converts to the population form."""
    return StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=True)


def population_scale(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale columns by the train rows' mean and population deviation (one aggregate row, broadcast)."""
    agg = train.agg(
        *(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_d_{c}") for c in features)
    )
    got = df.join(F.broadcast(agg))
    return got.withColumns(
        {c: (C(c) - C(f"_m_{c}")) / F.when(C(f"_d_{c}") == 0, F.lit(1.0)).otherwise(C(f"_d_{c}")) for c in features}
    ).drop(*(f"_{p}_{c}" for p in "md" for c in features))


def principal_components(df: DataFrame, n_features: int, components: int | float, features: str = "features"):
    """Component model with a fixed number or the least number reaching a variance share.

    Returns (transformed frame with ``pcs``, explained variance list).
    """
    k = n_features if isinstance(components, float) else components
    model = PCA(k=k, inputCol=features, outputCol="_pcs").fit(df)
    shares = [float(v) for v in model.explainedVariance]
    if isinstance(components, float):
        total, k = 0.0, 0
        while k < len(shares) and total < components:
            total += shares[k]
            k += 1
    out = pick_components(model.transform(df), list(range(k)), "_pcs", "pcs").drop("_pcs")
    return out, shares[:k]


def pick_components(df: DataFrame, indices: Sequence[int], features: str = "pcs", out: str = "picked") -> DataFrame:
    return VectorSlicer(inputCol=features, outputCol=out, indices=list(indices)).transform(df)


def scaled_pipeline(features: Sequence[str], estimator, components: int | None = None) -> Pipeline:
    """Assemble, scale, optionally reduce, fit: fitted on train rows only."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="features" if components is None else "_std", withMean=True),
    ]
    if components is not None:
        stages.append(PCA(k=components, inputCol="_std", outputCol="features"))
    return Pipeline(stages=[*stages, estimator])


def _score(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(rows)
    prob = vector_to_array("probability") if "probability" in out.columns else F.array().cast("array<double>")
    return out.select(*keep, C("prediction").cast("int").alias("pred"), prob.alias("prob"))


def out_of_fold(folds: SplitRows, make: Callable[[], Pipeline], keep: Sequence[str]) -> DataFrame:
    """Predictions of every split's test rows by a model of its train rows.

    The rows are written once; a split is a pair of filters on them.  Each fit is a
    Spark job, a bounded pool submits a few at a time, and the predictions form one
    long table.  A split that lacks a side is left out.
    """

    def one(s: int) -> DataFrame | None:
        train, test = folds.train(s), folds.test(s)
        if train.isEmpty() or test.isEmpty():
            return None
        return _score(make().fit(train), test, [*keep, folds.split])

    with ThreadPoolExecutor(POOL) as pool:
        parts = [p for p in pool.map(one, range(len(folds.plan))) if p is not None]
    if not parts:
        raise ValueError("no split has both train and test rows")
    return reduce(DataFrame.unionByName, parts)


def cross_validate(folds: SplitRows, make: Callable[[], Pipeline], keep: Sequence[str], label: str = "label"):
    """Out-of-fold predictions and the weighted F1 of every split."""
    pred = materialize(out_of_fold(folds, make, [*dict.fromkeys([*keep, label])]), "oof")
    return pred, stats.weighted_f1(pred, [folds.split], label, "pred")


def pooled_report(pred: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """Class report over all rows that were predicted, whatever split predicted them."""
    return stats.classification_report(pred.withColumn("_all", F.lit(0)), ["_all"], label, guess).drop("_all")


def combinatorial_cv(folds: SplitRows, paths: DataFrame, make, keep: Sequence[str], label: str = "label"):
    """Predictions of every combinatorial split, stitched to paths; F1 per path, mean and deviation."""
    pred = materialize(out_of_fold(folds, make, [*dict.fromkeys([*keep, label, "grp"])]), "oof")
    joined = attach(pred, paths, [folds.split, "grp"])
    scores = stats.weighted_f1(joined, ["path"], label, "pred")
    summary = scores.agg(F.avg("f1_weighted").alias("mean_f1"), F.stddev_samp("f1_weighted").alias("std_f1"))
    return joined, scores, summary


def walk_forward(tl: Timeline, blocks: DataFrame, n_blocks: int, make, keep: Sequence[str], label: str = "label", balanced: bool = True) -> DataFrame:
    """One fit per refit block on its train range, one batch prediction of its rows."""
    rows, test = materialize(tl.df, "rows"), materialize(blocks, "blocks")
    by = list(tl.by)

    def one(b: int) -> DataFrame:
        mine = test.where(C("block") == b)
        span = mine.groupBy(*by).agg(F.first("train_from").alias("_a"), F.first("train_to").alias("_b"))
        train = attach(rows, span, by).where(C("rn").between(C("_a"), C("_b"))).drop("_a", "_b")
        if balanced:
            train = weights.class_weights(train, label, "weight")
        return _score(make().fit(train), mine, [*keep, label, "block"])

    with ThreadPoolExecutor(POOL) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(n_blocks)))


# ------------------------------------------------------------------ meta labels
def meta_decision(df: DataFrame, primary: str = "pred", meta: str = "meta_pred", out: str = "final") -> DataFrame:
    """Act only where the primary model signals and the second model trusts it."""
    return df.withColumn(out, F.when((C(primary) == 1) & (C(meta) == 1), 1).otherwise(0))


def meta_label_run(folds: SplitRows, make_primary, make_meta, keep: Sequence[str], features: Sequence[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Two-stage model: out-of-fold primary, then a second model of its being right.

    Returns the decisions and weighted F1 / precision of primary and final.
    """
    first = out_of_fold(folds, make_primary, [*keep, label])
    rows = folds.rows.select(*keep, *features, "grp", "purged_by")
    meta = first.drop("prob", folds.split).join(rows, list(keep)).withColumn("meta_label", F.when(C("pred") == C(label), 1).otherwise(0))
    meta = materialize(meta, "meta", ("grp",))
    second = out_of_fold(folds.with_rows(meta), make_meta, [*keep])
    second = second.select(*keep, C("pred").alias("meta_pred"))
    decided = materialize(meta_decision(meta.drop("grp", "purged_by").join(second, list(keep))), "meta")
    both = decided.select(label, F.inline(F.array(
        F.struct(F.lit("primary").alias("model"), C("pred").alias("p")),
        F.struct(F.lit("final").alias("model"), C("final").alias("p")),
    )))
    rep = stats.classification_report(both, ["model"], label, "p")
    return decided, rep.where(C("row").isin("1", "weighted avg"))


# -------------------------------------------------------------- importance
def impurity_importance(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, trees: int = 50, seed: int = 42) -> DataFrame:
    """Mean decrease of impurity with one candidate feature per node."""
    model = random_forest(label, weight, trees, subset="1", seed=seed).fit(assemble(df, features))
    rows = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def permutation_importance(folds: SplitRows, features: Sequence[str], estimator, keys: Sequence[str], label: str = "label", weight: str | None = None, scoring: str = "log_loss", seed: int = 0) -> DataFrame:
    """Mean loss of score when one feature of the test rows is shuffled.

    The shuffle is a join of two balanced numberings (row order and random
    order).  All features are scored in one pass: each test row is expanded to
    one row per feature with that feature replaced.  Positive means useful for
    both scorings.  ``full_model`` is the mean score of the untouched rows.
    """
    w = C(weight) if weight else F.lit(1.0)

    def one(s: int) -> DataFrame:
        model = estimator.fit(assemble(folds.train(s), features))
        test = folds.test(s).select(*keys, *features, label, w.alias("_w"), F.lit(0).alias("_g"))
        plain = Timeline.build(test, ("_g",), tuple(keys))
        mixed = Timeline.build(
            test.select("_g", *keys, *(C(f).alias(f"_o_{f}") for f in features), F.xxhash64(F.lit(seed), *keys).alias("_h")),
            ("_g",), ("_h", *keys),
        ).df.drop("_h", *keys)
        both = plain.df.join(mixed, ["_g", "rn"])
        variants = F.array(
            F.struct(F.lit("full_model").alias("feature"), *(C(f) for f in features)),
            *(
                F.struct(F.lit(f).alias("feature"), *((C(f"_o_{g}") if g == f else C(g)).alias(g) for g in features))
                for f in features
            ),
        )
        wide = both.select(label, "_w", F.inline(variants))
        out = model.transform(assemble(wide, features))
        if scoring == "log_loss":
            p = F.element_at(vector_to_array("probability"), C(label).cast("int") + 1)
            loss = -F.log(F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)))
            scored = out.groupBy("feature").agg((-F.sum(loss * C("_w")) / F.sum("_w")).alias("score"))
        else:
            pred = out.withColumn("pred", C("prediction").cast("int"))
            scored = stats.weighted_f1(pred, ["feature"], label, "pred").withColumnRenamed("f1_weighted", "score")
        return scored.withColumn("fold", F.lit(s))

    with ThreadPoolExecutor(POOL) as pool:
        scores = materialize(reduce(DataFrame.unionByName, pool.map(one, range(len(folds.plan)))), "scores")
    base = scores.where(C("feature") == "full_model").select("fold", C("score").alias("_base"))
    diff = scores.join(base, "fold").groupBy("feature").agg(
        F.avg(F.when(C("feature") == "full_model", C("score")).otherwise(C("_base") - C("score"))).alias("importance")
    )
    return diff.orderBy(F.desc("importance"))


def single_feature_importance(folds: SplitRows, features: Sequence[str], estimator, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Mean weighted F1 over folds of a model with one feature at a time."""

    def one(f: str) -> DataFrame:
        make = lambda: Pipeline(stages=[VectorAssembler(inputCols=[f], outputCol="features"), estimator.copy()])
        pred = out_of_fold(folds.with_rows(folds.rows.select(*keys, label, f, "grp", "purged_by")), make, [*keys, label])
        return stats.weighted_f1(pred, [folds.split], label, "pred").withColumn("feature", F.lit(f))

    scored = reduce(DataFrame.unionByName, [one(f) for f in features])
    return scored.groupBy("feature").agg(F.avg("f1_weighted").alias("importance")).orderBy(F.desc("importance"))


def orthogonal_importance(df: DataFrame, features: Sequence[str], label: str = "label", variance: float = 0.95, trees: int = 50, seed: int = 42) -> DataFrame:
    """Forest importance of principal components next to their variance share."""
    scaled = standardize("_raw", "_std").fit(x := assemble(df, features, "_raw")).transform(x)
    comps, shares = principal_components(scaled, len(features), variance, "_std")
    forest = random_forest(label, None, trees, seed=seed).setFeaturesCol("pcs").fit(comps)
    rows = [(f"PC{i + 1}", float(forest.featureImportances[i]), s) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(
        rows, "component string, importance double, explained_variance double"
    ).orderBy(F.desc("importance"))


def forecast_direction(tl: Timeline, actual: str, forecast: str) -> Timeline:
    """True and forecast direction against the last actual value; the first row has none."""
    from tidewheel.operators.indicators import lag

    got = tl.apply(lag(actual, 1, "_prev"))
    df = got.df.where(C("_prev").isNotNull()).withColumns(
        {"true_dir": (C(actual) > C("_prev")).cast("int"), "pred_dir": (C(forecast) > C("_prev")).cast("int")}
    )
    return got.with_df(df.drop("_prev"))
