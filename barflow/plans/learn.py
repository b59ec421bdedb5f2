"""Walk-forward training with Spark ML: rows, folds, weights, learners, calibration, experts, metrics, persistence."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions.numeric import cut
from barflow.operators.scans import drawdown, running

C = F.col
FITS_AT_ONCE = 16
FIT_BYTES = 32 << 20
#: What the correctness predictor sees beside the probability.
META_FEATURES = ("proba", "regime", "session_pct", "iv_proxy", "atr_14_pct", "adx_14", "dmi_diff", "tick_imbalance", "vwap_dev_vel", "pressure_ratio",
                 "bb_squeeze", "bb_width", "adx_rsi_trend", "vol_ratio")
META_NEUTRAL = 0.55
#: Regimes that have models of their own.
EXPERT_REGIMES = (k.TRENDING, k.RANGING)


# --- rows -----------------------------------------------------------------------------------------------------------
def training_rows(df: DataFrame, horizon: int, features: Sequence[str], session: int = 375) -> DataFrame:
    """Rows with a decided barrier, all features, inside the session window of the horizon."""
    first = 5 if horizon == 1 else 30
    decided = C(f"barrier_{horizon}m").isNotNull() & (C(f"barrier_{horizon}m") != 0)
    known = [C(f).isNotNull() for f in features]
    out = df.where(decided & C("minute_of_day").between(first, session - horizon - 5))
    for c in known:
        out = out.where(c)
    return out


def recent_rows(df: DataFrame, date: str = "trade_date", years: int = 2) -> DataFrame:
    """Rows of the last years, however many they are."""
    last = df.agg(F.max(date).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(C(date) >= F.add_months("_last", -12 * years)).drop("_last")  # one row


def noise_filter(df: DataFrame, horizon: int, min_move: float = 0.0005, min_adx: float = 10.0) -> DataFrame:
    return df.where((F.abs(C(f"fut_ret_{horizon}m")) > min_move) & (C("adx_14") > min_adx))


# --- folds and weights ----------------------------------------------------------------------------------------------
def ordinals(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("dt", "symbol"), bucket: str = "hour") -> DataFrame:
    """Zero-based position ``i`` of each row in time and the number of rows ``n``."""
    pos = running(df, {"_p": F.lit(1)}, keys=list(keys), order=list(order), bucket=bucket)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = pos.join(total, list(keys)) if keys else pos.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("i", C("_p") - 1).drop("_p")


def fold_start(n: Column, fold: int, splits: int = 5) -> Column:
    return n - (splits - fold) * F.floor(n / (splits + 1))


def walk_forward(df: DataFrame, splits: int = 5, embargo: int = 5) -> DataFrame:
    """Test fold of each row (NULL when in none or embargoed) and the first fold that may train on it.

    Folds expand: fold f trains on rows at least ``embargo`` before its test part, so a row trains every fold from
    ``train_from`` on.  Needs ``i`` and ``n``.
    """
    size = F.floor(C("n") / (splits + 1))
    test, train = None, None
    for f in range(splits):
        start = fold_start(C("n"), f, splits)
        inside = (C("i") > start + embargo) & (C("i") < start + size)
        test = F.when(inside, f) if test is None else test.when(inside, f)
        usable = C("i") < start - embargo
        train = F.when(usable, f) if train is None else train.when(usable, f)
    return df.withColumns({"test_fold": test, "train_from": train})


def sample_weights(df: DataFrame, ev: str, decay: float = k.TRAIN_DECAY) -> DataFrame:
    """Expected-value weight times time decay, scaled to mean one."""
    base = F.when(C(ev).isNull() | (C(ev) <= 0), 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.1), C(ev))))
    out = df.withColumn("_w", base * F.exp(decay * (C("i") - C("n")) / C("n")))
    mean = out.agg(F.avg("_w").alias("_mean"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weight", C("_w") / C("_mean")).drop("_w", "_mean")  # one row


def drawdown_weights(oof: DataFrame, order=("dt", "symbol"), bucket: str = "hour") -> DataFrame:
    """Down-weight rows inside drawdowns of the held-out equity curve."""
    right = F.when(C("proba") > 0.5, 1).otherwise(0) == C("y")
    pnl = F.when(C("proba").isNull(), 0.0).when(right, C("ret")).otherwise(-F.abs("ret"))
    out = drawdown(oof, F.coalesce(pnl, F.lit(0.0)), keys=[], order=list(order), bucket=bucket)
    return out.withColumn("dd_weight", F.when(C("drawdown") < k.DD_CLUSTER, k.DD_WEIGHT).otherwise(1.0)).drop("peak")


# --- learners -------------------------------------------------------------------------------------------------------
def in_parallel(spark, jobs: Sequence[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent fits, a bounded number of them at a time: a small fit leaves most of the cluster idle, so fits fill it together."""
    if not jobs:
        return []
    pool = ThreadPool(min(at_once, len(jobs)))
    try:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)
    finally:
        pool.close()


def fitting_frame(df: DataFrame, features: Sequence[str], name: str = "raw") -> DataFrame:
    """Rows with the assembled vector, in partitions of about ``FIT_BYTES``. Every tree level is a job over them, so empty ones would cost most."""
    rows = VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep").transform(df)
    size = df.count() * (len(features) + 4) * 8
    return rows.coalesce(max(1, -(-size // FIT_BYTES)))


def base_learners(trees: int = 300, seed: int = 42, weight: str = "weight", total_weight: float = 1.0, C_: float = 0.1) -> list:
    """Boosted trees, forest and logistic regression. ``total_weight`` is the sum of the weights: the penalty 1/C stands against the summed loss, while
    Spark's stands against its mean."""
    common = dict(labelCol="y", weightCol=weight)
    return [GBTClassifier(featuresCol="raw", maxIter=trees, maxDepth=4, stepSize=0.03, subsamplingRate=0.8, minInstancesPerNode=50, seed=seed,
                          predictionCol="p0", **common).setProbabilityCol("q0").setRawPredictionCol("r0"),
            RandomForestClassifier(featuresCol="raw", numTrees=trees, maxDepth=8, minInstancesPerNode=50, seed=seed, predictionCol="p1",
                                   probabilityCol="q1", rawPredictionCol="r1", **common),
            LogisticRegression(featuresCol="scaled", regParam=1.0 / (C_ * max(total_weight, 1e-9)), standardization=False, maxIter=500, predictionCol="p2",
                               probabilityCol="q2", rawPredictionCol="r2", **common)]


def fit_base(spark, parts: dict, features: Sequence[str], trees: int = 300, weight: str = "weight") -> dict:
    """A fitted soft-vote model for each part (name -> rows of :func:`fitting_frame`); all learners of all parts are fitted concurrently.

    Scaling is fitted on the part itself, so on a fold's training rows only.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    scaled, totals = {}, {}

    def prepare(name):
        rows = parts[name]
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows)
        frame = scaler.transform(rows).select("raw", "scaled", "y", weight).persist()
        totals[name] = frame.agg(F.sum(weight)).first()[0]
        scaled[name] = scaler, frame
    try:
        in_parallel(spark, [lambda n=n: prepare(n) for n in parts])
        jobs = [(name, i) for i in range(3) for name in parts]  # the boosted trees, which take longest, go first
        fits = in_parallel(spark, [lambda n=n, i=i: base_learners(trees, weight=weight, total_weight=totals[n])[i].fit(scaled[n][1]) for n, i in jobs])
    finally:
        for _, frame in scaled.values():
            frame.unpersist()
    found = dict(zip(jobs, fits))
    return {name: PipelineModel(stages=[assembler, scaled[name][0], *(found[name, i] for i in range(3))]) for name in parts}


TEMP = ("raw", "scaled", "p0", "q0", "r0", "p1", "q1", "r1", "p2", "q2", "r2")


def soft_vote(model: PipelineModel, df: DataFrame, name: str = "proba") -> DataFrame:
    scored = model.transform(df)
    mean = sum((vector_to_array(f"q{i}")[1] for i in range(3)), F.lit(0.0)) / 3
    return scored.withColumn(name, mean).drop(*TEMP)


def out_of_fold(df: DataFrame, features: Sequence[str], trees: int = 300, splits: int = 5, by: Column | None = None, name: str = "proba") -> DataFrame:
    """Held-out probability per row, and the number of rows its model was fitted on (``n_train``).

    With ``by`` each fold has one model for each value of that column, fitted on that value's rows. Every row stays. Rows that are in no test fold, or
    whose model would see one class only, have no probability. Rows are assembled once; all models are fitted concurrently.
    """
    spark, group = df.sparkSession, F.lit(0) if by is None else by
    rows = fitting_frame(df.withColumn("_group", group), features).persist()
    sizes = {}
    try:
        for f in range(splits):
            for g, n, classes in rows.where(C("train_from") <= f).groupBy("_group").agg(F.count(F.lit(1)), F.count_distinct("y")).collect():  # a few groups
                if classes == 2 and g is not None:
                    sizes[f, g] = n
        fitted = fit_base(spark, {(f, g): rows.where((C("train_from") <= f) & C("_group").eqNullSafe(F.lit(g))) for f, g in sizes}, features, trees)
    finally:
        rows.unpersist()
    tagged = df.withColumn("_group", group)
    mine = F.lit(False)
    out = []
    for (f, g), model in fitted.items():
        here = F.coalesce(C("test_fold") == f, F.lit(False)) & C("_group").eqNullSafe(F.lit(g))
        mine = mine | here
        out.append(soft_vote(model, tagged.where(here).withColumn("n_train", F.lit(sizes[f, g]).cast("long")), name))
    rest = tagged.where(~mine).withColumns({"n_train": F.lit(0).cast("long"), name: F.lit(None).cast("double")})
    return reduce(DataFrame.unionByName, out, rest).drop("_group")


def platt(oof: DataFrame) -> PipelineModel | None:
    """Sigmoid from raw held-out probability to calibrated probability; none where no row has a probability."""
    if oof.where(C("proba").isNotNull()).isEmpty():
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=["proba"], outputCol="_x", handleInvalid="keep"),
                            LogisticRegression(featuresCol="_x", labelCol="y", regParam=0.0, predictionCol="_p", probabilityCol="_q",
                                               rawPredictionCol="_r")]).fit(oof.where(C("proba").isNotNull()))


def calibrate(model: PipelineModel | None, df: DataFrame, name: str = "calibrated") -> DataFrame:
    if model is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    p = F.least(F.lit(k.PROBA_CLIP[1]), F.greatest(F.lit(k.PROBA_CLIP[0]), vector_to_array("_q")[1]))
    return model.transform(df).withColumn(name, F.when(C("proba").isNotNull(), p)).drop("_x", "_p", "_q", "_r")


def context_learner(label: str, trees: int = 100, weight: str | None = None) -> GBTClassifier:
    """Small boosted model on probability plus context: the stacker and the correctness predictor."""
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=20, seed=42,
                        predictionCol="_p").setProbabilityCol("_q").setRawPredictionCol("_r")
    return gbt.setWeightCol(weight) if weight else gbt


def fit_context_model(df: DataFrame, columns: Sequence[str], label: str, trees: int = 100, weight: str | None = None) -> PipelineModel:
    return PipelineModel(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep"),
                                 context_learner(label, trees, weight).fit(fitting_frame(df, columns, "_x"))])


def score_context(model: PipelineModel | None, df: DataFrame, name: str, neutral: float | None = None) -> DataFrame:
    """Probability of the context model; ``neutral`` where there is no model."""
    if model is None:
        return df.withColumn(name, F.lit(neutral))
    return model.transform(df).withColumn(name, vector_to_array("_q")[1]).drop("_x", "_p", "_q", "_r")


def context_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame with all context columns: one that is absent, or a value that is missing, counts as 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(C(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns})


def cross_fit_context(df: DataFrame, columns: Sequence[str], label: str, name: str, trees: int = 100, weight: str | None = None,
                      neutral: float | None = None) -> DataFrame:
    """Probability per row of a context model fitted on the other test folds; all folds are fitted concurrently.

    Every row stays. Rows without ``proba``, or whose other folds have rows of fewer than two classes, get ``neutral``.
    """
    known = df.where(C("proba").isNotNull() & C(label).isNotNull() & C("test_fold").isNotNull())
    folds = {r["test_fold"]: (r["zeros"], r["ones"]) for r in known.groupBy("test_fold").agg(
        F.count(F.when(C(label) == 0, 1)).alias("zeros"), F.count(F.when(C(label) == 1, 1)).alias("ones")).collect()}  # a few folds
    fitted = sorted(f for f in folds if all(sum(n[i] for g, n in folds.items() if g != f) for i in (0, 1)))
    models = in_parallel(df.sparkSession, [lambda f=f: fit_context_model(known.where(C("test_fold") != f), columns, label, trees, weight) for f in fitted])
    has = C("proba").isNotNull() & C("test_fold").isin(fitted)
    out = df.where(~F.coalesce(has, F.lit(False))).withColumn(name, F.lit(neutral).cast("double"))
    for f, model in zip(fitted, models):
        out = out.unionByName(score_context(model, df.where(has & (C("test_fold") == f)), name))
    return out


def feature_importance(df: DataFrame, features: Sequence[str], trees: int = 300, top: int | None = None) -> DataFrame:
    """Importances of the boosted trees fitted on all rows of ``df``, a row per feature."""
    spark, rows = df.sparkSession, fitting_frame(df, features).persist()
    try:
        weights = base_learners(trees)[0].fit(rows).featureImportances.toArray()
    finally:
        rows.unpersist()
    out = spark.createDataFrame([(f, float(x)) for f, x in zip(features, weights)], "feature string, importance double")
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def save_model(model: PipelineModel, meta: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/meta")


# --- metrics --------------------------------------------------------------------------------------------------------
def confident_trades(preds: DataFrame, min_conf: float = k.CONF_MODERATE) -> DataFrame:
    """Predictions above the confidence bar with a finite return: side, confidence, pnl, win."""
    up = C("proba") > 0.5
    out = preds.withColumns({"pred": F.when(up, 1).otherwise(0), "conf": F.when(up, C("proba")).otherwise(1 - C("proba"))})
    out = out.where((C("conf") >= min_conf) & C("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") != float("inf")))
    return out.withColumns({"pnl": F.when(C("pred") == 1, C("ret")).otherwise(-C("ret")),
                            "win": F.when((C("ret") > 0) == (C("pred") == 1), 1.0).otherwise(0.0)})


def backtest_metrics(trades: DataFrame, keys: Sequence[str] = ("h",), order=("dt", "symbol"), bucket: str = "hour") -> DataFrame:
    """Counts, win rate, profit factor, daily Sharpe, drawdown and Calmar per key, for any number of trades."""
    keys = list(keys)
    dd = drawdown(trades, "pnl", keys=keys, order=list(order), bucket=bucket)
    per_day = dd.groupBy(*keys, "trade_date").agg(
        F.sum("pnl").alias("_day"), F.count(F.lit(1)).alias("_n"), F.count(F.when(C("pnl") > 0, 1)).alias("_w"), F.sum(F.when(C("pnl") > 0, C("pnl"))).alias("_ws"),
        F.sum(F.when(C("pnl") < 0, -C("pnl"))).alias("_ls"), F.min("drawdown").alias("_dd"))
    out = per_day.groupBy(*keys).agg(
        F.sum("_n").alias("trades"), F.sum("_w").alias("_w"), F.coalesce(F.sum("_ws"), F.lit(0.0)).alias("_ws"), F.coalesce(F.sum("_ls"), F.lit(0.0)).alias("_ls"),
        F.min("_dd").alias("max_dd"), F.sum("_day").alias("total"), F.avg("_day").alias("_m"), F.stddev_pop("_day").alias("_s"))
    return out.select(*keys, "trades", (C("_w") / C("trades")).alias("win_rate"), (C("total") / C("trades")).alias("avg_ret"),
                      F.when(C("_ls") > 0, C("_ws") / C("_ls")).otherwise(99.0).alias("profit_factor"),
                      (C("_m") / (C("_s") + 1e-9) * F.sqrt(F.lit(252.0))).alias("sharpe"),
                      F.when(C("max_dd") < 0, C("total") / F.abs(C("max_dd") + 1e-9)).otherwise(99.0).alias("calmar"), "max_dd", "total")


def winrate_breakdown(trades: DataFrame) -> DataFrame:
    """Win rate and number of trades by regime, by regime and ADX bucket and by confidence bin, in one pass of grouping sets."""
    name = F.when(C("regime") == 0, "TRENDING").when(C("regime") == 1, "RANGING").when(C("regime") == 2, "CRISIS").when(C("regime") == -1, "UNCERT").otherwise("?")
    t = trades.select("win", name.alias("regime_name"), cut(C("adx"), [0, 15, 25, 100], ["ADX<15", "ADX15-25", "ADX>25"], right=False).alias("adx_bucket"),
                      cut(C("conf"), [0.50, 0.55, 0.60, 0.65, 0.70, 1.01], ["0.50-0.55", "0.55-0.60", "0.60-0.65", "0.65-0.70", "0.70+"], right=False).alias("conf_bin"))
    r, a, b = C("regime_name"), C("adx_bucket"), C("conf_bin")
    agg = t.groupingSets([[r], [r, a], [b]], r, a, b).agg(F.count(F.lit(1)).alias("n"), F.avg("win").alias("wr"), F.grouping_id().alias("_g"))
    # grouping_id has one bit per column left out: regime only is 3, regime with ADX 1, confidence bin 6.
    keep = (C("_g") == 3) | ((C("_g") == 1) & a.isNotNull()) | ((C("_g") == 6) & b.isNotNull())
    return agg.where(keep).select("regime_name", "adx_bucket", "conf_bin", "n", "wr", (C("wr") - 0.5).alias("edge"))


def oof_quality(preds: DataFrame, calibrated: str = "calibrated", by: Sequence[str] = ("test_fold",)) -> DataFrame:
    """Accuracy, Brier scores and reliability (Brier over accuracy's own variance) per fold."""
    hit = F.when(F.when(C("proba") > 0.5, 1).otherwise(0) == C("y"), 1.0).otherwise(0.0)
    agg = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg((C("proba") - C("y")) * (C("proba") - C("y"))).alias("brier_raw"),
                                 F.avg((C(calibrated) - C("y")) * (C(calibrated) - C("y"))).alias("brier"))
    return agg.withColumn("reliability", C("brier") / (C("accuracy") * (1 - C("accuracy")) + 1e-9))


def class_balance(df: DataFrame, by: Sequence[str] = ("h",)) -> DataFrame:
    share = {n: F.avg(F.when(C("regime") == r, 1.0).otherwise(0.0)) for r, n in ((0, "trending"), (1, "ranging"), (2, "crisis"))}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(C("y").cast("double")).alias("up_share"), *[v.alias(n) for n, v in share.items()])


def seasonality(df: DataFrame, label: str = "y", by: Sequence[str] = ("regime",)) -> DataFrame:
    """Mean label less one half per five-minute bucket, smoothed over three buckets and clipped."""
    bucket = (F.bround(C("minute_of_day") / 5) * 5).cast("int")
    agg = df.groupBy(*by, bucket.alias("bucket")).agg((F.avg(C(label).cast("double")) - 0.5).alias("_ev"))
    smooth = F.avg("_ev").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(-1, 1))
    return agg.withColumn("bias", F.least(F.lit(k.SEASON_CLIP), F.greatest(F.lit(-k.SEASON_CLIP), smooth))).drop("_ev")


def training_summary(metrics: DataFrame, quality: DataFrame) -> DataFrame:
    """Accuracy, baseline and edge in points beside the backtest metrics of each horizon."""
    return metrics.join(quality, "h").withColumn("edge_pp", (C("accuracy") - C("baseline")) * 100)
