"""Market regimes: rules, mixture states, causal filtering, overrides, hysteresis and transitions."""
from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from barflow import constants as k
from barflow.operators.chunks import chunked
from barflow.operators.rolling import Roller, flag
from barflow.operators.scans import forward_fill, running, streaks
from barflow.plans import features as ft

C = F.col
INPUTS = ("vol", "atr", "trend", "rsi", "adx")


def regime_inputs(daily: DataFrame, bucket: str = "year", rows_per_chunk: int | None = None) -> DataFrame:
    """Annualised volatility, ATR %, distance from the 50-day mean, RSI and ADX, carried forward over gaps."""
    w = Roller()

    def run(df):
        out = ft.rsi_columns(df, w, {"rsi": 14})
        out = ft.dmi_columns(out, w, 14, "adx")
        out = out.withColumns({"_tr": ft.true_range(w), "_r": w.change("close"), "_ma": w.roll(F.avg, "close", 50)})
        return out.withColumns({"vol": w.roll(F.stddev_samp, "_r", 20) * math.sqrt(252) * 100,
                                "atr": w.roll(F.avg, "_tr", 14) / (C("close") + 1e-9) * 100,
                                "trend": (C("close") - C("_ma")) / (C("_ma") + 1e-9) * 100}).drop("_tr", "_r", "_ma")
    out = chunked(daily, run, 60, bucket=bucket, rows_per_chunk=rows_per_chunk)
    return forward_fill(out, list(INPUTS), bucket=bucket)


def standardize(df: DataFrame, columns=INPUTS, causal: bool = True, bucket: str = "year") -> DataFrame:
    """z-scores against the rows so far (causal) or against the whole sample of the symbol."""
    full = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    if causal:
        sums = {**{f"_n_{c}": F.lit(1.0) for c in columns[:1]}, **{f"_s_{c}": C(c) for c in columns}, **{f"_q_{c}": C(c) * C(c) for c in columns}}
        out, n = running(full, sums, bucket=bucket), C(f"_n_{columns[0]}")
        mean = {c: C(f"_s_{c}") / n for c in columns}
        var = {c: F.when(n > 1, F.greatest((C(f"_q_{c}") - C(f"_s_{c}") * mean[c]) / (n - 1), F.lit(0.0))) for c in columns}
        return out.withColumns({f"z_{c}": (C(c) - mean[c]) / (F.sqrt(var[c]) + 1e-9) for c in columns}).drop(*sums)
    stats = full.groupBy("symbol").agg(*[f(c).alias(f"{p}{c}") for c in columns for f, p in ((F.avg, "_m_"), (F.stddev_samp, "_s_"))])
    out = full.join(stats, "symbol")
    return out.withColumns({f"z_{c}": (C(c) - C(f"_m_{c}")) / (C(f"_s_{c}") + 1e-9) for c in columns}).drop(*[c for c in stats.columns if c != "symbol"])


def rule_regime(inputs: DataFrame) -> DataFrame:
    """Batch rule: thresholds are quantiles of each symbol's daily volatility (one value a day, so exact is cheap)."""
    q = inputs.groupBy("symbol").agg(F.percentile("vol", F.array(F.lit(0.75), F.lit(0.9))).alias("_q"))
    out = inputs.join(q, "symbol")
    reg = (F.when(C("vol").isNull(), k.RANGING).when(C("vol") > C("_q")[1], k.CRISIS)
           .when((C("vol") > C("_q")[0]) | (C("adx") < 20), k.RANGING).otherwise(k.TRENDING))
    return out.withColumn("regime", reg).drop("_q")


def rule_regime_single(vol: Column, adx: Column, rows: Column) -> Column:
    return (F.when((rows < 20) | vol.isNull(), k.RANGING).when(vol > 30, k.CRISIS)
            .when((vol > 20) | (adx < 20), k.RANGING).otherwise(k.TRENDING))


# --- mixture states -------------------------------------------------------------------------------------------------
def fit_states(z: DataFrame, columns=tuple(f"z_{c}" for c in INPUTS), seed: int = 42) -> dict:
    """Three Gaussian states, their transition probabilities and the regime each stands for.

    ``z`` is the training span: score only rows after it. Emissions come from a Gaussian mixture fitted by Spark; transitions are counted on its hard assignments.  States are
    ordered by the mean diagonal of their covariance: lowest RANGING, middle TRENDING, highest CRISIS.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    # The fit passes over the rows many times; kept rows are recomputed if an executor is lost.
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(z.select("symbol", "dt", *columns).na.drop()).persist()
    model = GaussianMixture(k=3, seed=seed, maxIter=200).fit(data)
    params = [(np.array(r["mean"].toArray()), np.array(r["cov"].toArray())) for r in model.gaussiansDF.collect()]  # three rows
    order = np.argsort([np.diag(c).mean() for _, c in params])
    names = {int(order[0]): k.RANGING, int(order[1]): k.TRENDING, int(order[2]): k.CRISIS}
    hard = model.transform(data).select("symbol", "dt", "prediction")
    year = Window.partitionBy("symbol", F.year("dt")).orderBy("dt")
    pairs = (hard.withColumn("_next", F.lead("prediction").over(year)).where("_next is not null")
             .groupBy("prediction", "_next").count().collect())  # nine rows at most
    data.unpersist()
    trans = np.ones((3, 3))
    for r in pairs:
        trans[r["prediction"], r["_next"]] += r["count"]
    return {"means": [m.tolist() for m, _ in params], "covs": [c.tolist() for _, c in params], "weights": [float(x) for x in model.weights],
            "trans": (trans / trans.sum(axis=1, keepdims=True)).tolist(), "names": names, "columns": list(columns)}


def first_share(df: DataFrame, share: float, order: str = "dt") -> Column:
    """Whether a row lies in the first ``share`` of the distinct days of all symbols, which are bounded by the calendar."""
    days = df.select(F.unix_date(F.to_date(order)).alias("d")).distinct()
    cut = days.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY d)")).first()[0]  # one date
    return F.unix_date(F.to_date(order)) <= F.lit(cut)


def filter_states(z: DataFrame, states: dict, scored: Column | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """Regime and confidence from the forward recursion: only rows up to t are used at t.

    A step is a product with a 3 x 3 matrix (transitions times the likelihoods of the row), so a chunk of rows is one matrix. Chunks report theirs,
    scaled to a sum of one; those of a symbol are folded, and every chunk runs once from its true entry. The recursion begins with the first row
    that is ``scored``; rows that are not, or that miss an input, stay with nulls.
    """
    from barflow.operators.chunks import CHUNK, HALO, with_chunks
    means, covs = [np.array(m) for m in states["means"]], [np.array(c) for c in states["covs"]]
    inv = [np.linalg.inv(c) for c in covs]
    norm = [-0.5 * np.linalg.slogdet(c)[1] for c in covs]
    trans, start, names, cols = np.array(states["trans"]), np.array(states["weights"]), states["names"], states["columns"]
    known = reduce(and_, [C(c).isNotNull() & ~F.isnan(c) for c in cols])
    wanted = F.coalesce(known & (F.lit(True) if scored is None else scored), F.lit(False))
    sym, dt = z.schema["symbol"], z.schema["dt"]

    def likelihoods(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[cols].to_numpy(float)
        like = np.stack([n - 0.5 * np.einsum("ij,jk,ik->i", x - m, i, x - m) for m, i, n in zip(means, inv, norm)], axis=1)
        return np.exp(like - like.max(axis=1, keepdims=True))

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        """Product of the chunk's steps, without the transition into its first row."""
        like = likelihoods(pdf.sort_values("dt", kind="stable"))
        m = np.diag(like[0])
        for row in like[1:]:
            m = (m @ trans) * row
            m = m / m.sum()
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], CHUNK: [pdf[CHUNK].iloc[0]], "m": [m.ravel().tolist()]})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, entries = pdf.sort_values(CHUNK), start, []
        for i, m in enumerate(pdf["m"]):
            p = p if i == 0 else p @ trans
            entries.append((p / p.sum()).tolist())
            p = p @ np.array(m).reshape(3, 3)
            p = p / p.sum()
        return pd.DataFrame({"symbol": pdf["symbol"].values, CHUNK: pdf[CHUNK].values, "_entry": entries})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", kind="stable")
        like, p = likelihoods(pdf), np.array(pdf["_entry"].iloc[0])
        post = np.empty_like(like)
        for t, row in enumerate(like):
            p = (p if t == 0 else p @ trans) * row
            p = p / p.sum()
            post[t] = p
        best = post.argmax(axis=1)
        return pd.DataFrame({"symbol": pdf["symbol"].values, "dt": pdf["dt"].values, "regime": [names[int(b)] for b in best], "confidence": post.max(axis=1)})
    rows = with_chunks(z.where(wanted).select("symbol", "dt", *cols), 0, bucket="year", rows_per_chunk=rows_per_chunk).where(~C(HALO)).drop(HALO)
    part, vector = StructField(CHUNK, LongType()), ArrayType(DoubleType())
    entries = (rows.groupBy("symbol", CHUNK).applyInPandas(summarize, StructType([sym, part, StructField("m", vector)]))
               .groupBy("symbol").applyInPandas(fold, StructType([sym, part, StructField("_entry", vector)])))
    out = rows.join(entries, ["symbol", CHUNK]).groupBy("symbol", CHUNK).applyInPandas(
        run, StructType([sym, dt, StructField("regime", IntegerType()), StructField("confidence", DoubleType())]))
    rest = z.where(~wanted).select("symbol", "dt", F.lit(None).cast("int").alias("regime"), F.lit(None).cast("double").alias("confidence"))
    return out.unionByName(rest)


# --- per-row rules --------------------------------------------------------------------------------------------------
def intraday_override(regime: Column, minute: Column, iv_change: Column, atr_ratio: Column, adx: Column, adx5: Column) -> Column:
    """Correct a daily regime with bar-level signals; the first rule that applies wins."""
    strong_min = F.when(adx >= 40, 18).otherwise(22)
    return (F.when((minute < 30) | (minute >= 345), k.RANGING).when(iv_change > 25, k.CRISIS)
            .when((atr_ratio > 1.8) & (adx < 15), k.RANGING)
            .when((regime == k.CRISIS) & (iv_change < 15) & ((adx5 >= 20) | (adx >= 25)) & (atr_ratio < 1.8), k.TRENDING)
            .when((regime == k.UNCERTAIN) & ((adx + adx5) / 2 >= 28) & (F.least(adx, adx5) >= strong_min) & (iv_change < 15), k.TRENDING)
            .otherwise(regime))


def session_regime(minute: Column, iv_change: Column, adx5: Column, atr_ratio: Column, squeeze: Column, ret1: Column, ret3: Column) -> Column:
    """STRUCT(label, score): share of four trend criteria, or NO_TRADE at the session edges and in volatility shocks."""
    way = ((ret1 > 0) & (ret3 > 0)) | ((ret1 < 0) & (ret3 < 0))
    score = flag(adx5 >= 25) + flag(atr_ratio >= 0.88) + flag(squeeze == 0) + flag(way)
    closed = (minute < 30) | (minute >= 330) | (iv_change > 20)
    label = F.when(closed, "NO_TRADE").when((score >= 3) & way, "TRENDING_CONFIRMED").when((score >= 2) & way, "TRENDING_WEAK").otherwise("RANGING")
    return F.struct(label.alias("label"), F.when(closed, 0.0).otherwise(score / 4.0).alias("score"))


def swing_direction(hh: Column, hl: Column, lh: Column, ll: Column) -> Column:
    return F.when((hh == 1) & (hl == 1), "UP").when((lh == 1) & (ll == 1), "DOWN").otherwise("NEUTRAL")


def row_regime(minute: Column, adx: Column, direction: Column) -> Column:
    trending = (minute >= 15) & (minute < 345) & (adx >= k.ADX_TREND) & (direction != "NEUTRAL")
    return F.when(trending, k.TRENDING).otherwise(k.RANGING)


def row_direction(direction: Column, vwap_slope: Column) -> Column:
    return (F.when(direction != "NEUTRAL", direction).when(vwap_slope > 0.02, "UP").when(vwap_slope < -0.02, "DOWN").otherwise("NEUTRAL"))


def swing_regime(bars: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """ADX(20) >= 22 and the last three swing highs and lows of the lookback all rising or all falling."""
    w, half, back = Roller(), k.SWING_HALF, k.SWING_LOOKBACK

    def run(df):
        out = ft.dmi_columns(df, w, k.ADX_PERIOD, "adx_20", eps=1e-9)
        n = 2 * half + 1
        out = out.withColumns({"_h": w.lag("high", half), "_l": w.lag("low", half), "_deep": w.lag("close", back).isNotNull()})
        out = out.withColumns({"_sh": F.when(C("_h") == w.roll(F.max, "high", n), C("_h")), "_sl": F.when(C("_l") == w.roll(F.min, "low", n), C("_l"))})
        past = w.frame(-(back - 2 * half), -(half + 1))
        out = out.withColumns({"_hs": F.slice(F.reverse(F.collect_list("_sh").over(past)), 1, k.SWINGS),
                               "_ls": F.slice(F.reverse(F.collect_list("_sl").over(past)), 1, k.SWINGS)})

        def steps(a, up):
            one = (lambda i: F.get(a, F.lit(i)) > F.get(a, F.lit(i + 1))) if up else (lambda i: F.get(a, F.lit(i)) < F.get(a, F.lit(i + 1)))
            return (F.size(a) >= k.SWINGS) & one(0) & one(1)
        known = C("_deep") & (C("adx_20") >= k.ADX_TREND) & (F.size("_hs") >= k.SWINGS) & (F.size("_ls") >= k.SWINGS)
        way = F.when(known & steps("_hs", True) & steps("_ls", True), "UP").when(known & steps("_hs", False) & steps("_ls", False), "DOWN")
        out = out.withColumn("trend_direction", F.coalesce(way, F.lit("NEUTRAL")))
        return (out.withColumn("trend_regime", F.when(C("trend_direction") != "NEUTRAL", k.TRENDING).otherwise(k.RANGING))
                .drop("_h", "_l", "_deep", "_sh", "_sl", "_hs", "_ls"))
    return chunked(bars, run, back + 2 * half, bucket=bucket, rows_per_chunk=rows_per_chunk)


def micro_regime(bars: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Five-way label from ATR now against its 60-bar mean, the 20-bar net move and the ATR of the ten bars before."""
    w = Roller()

    def run(df):
        fr = w.frame(-59, 0)
        out = df.withColumns({"_n": F.count(F.lit(1)).over(fr), "_na": F.count("atr_14").over(fr), "_mean": F.avg("atr_14").over(fr),
                              "_now": F.last("atr_14", True).over(fr), "_then": F.first("close").over(w.frame(-19, 0)),
                              "_prior": F.avg("atr_14").over(w.frame(-10, -1))})
        ratio = C("_now") / (C("_mean") + 1e-9)
        net = (C("close") - C("_then")) / (C("_mean") + 1e-9)
        prior = F.when(C("_na") > 11, C("_prior") / (C("_mean") + 1e-9)).otherwise(1.0)
        label = (F.when((C("_n") < 30) | (C("_na") < 10), "UNKNOWN").when((prior < 0.70) & (ratio > 1.10), "BREAKOUT")
                 .when(ratio > 1.30, F.when(net > 0.3, "TRENDING_UP").otherwise("TRENDING_DN")).when(ratio < 0.70, "RANGING")
                 .when(F.abs(net) < 0.5, "RANGING").when(net > 0, "TRENDING_UP").otherwise("TRENDING_DN"))
        return out.withColumn("micro_regime", label).drop("_n", "_na", "_mean", "_now", "_then", "_prior")
    return chunked(bars, run, 59, bucket=bucket, rows_per_chunk=rows_per_chunk)


def transitions(df: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Time of the last regime change, minutes since it, and the two shock zones."""
    w = Roller()
    prev = w.lag("regime")
    out = chunked(df, lambda d: d.withColumn("flip_ts", F.when(prev.isNotNull() & (C("regime") != prev), C("dt"))), 1, bucket=bucket,
                  rows_per_chunk=rows_per_chunk)
    out = out.withColumn("flipped", flag(C("flip_ts").isNotNull()))
    out = forward_fill(out, ["flip_ts"], bucket=bucket)
    since = (F.unix_seconds(C("dt").cast("timestamp")) - F.unix_seconds(C("flip_ts").cast("timestamp"))) / 60
    out = out.withColumn("mins_since_flip", since)
    return out.withColumns({"in_transition": flag(C("mins_since_flip") < k.TRANSITION_MIN), "flip_cooldown": flag(C("mins_since_flip") < k.FLIP_MIN)})


def crisis_cooldowns(df: DataFrame, bucket: str = "day", bars: int = 3) -> DataFrame:
    """Bars left before entries are allowed again after a crisis begins, and the block on the bar it is judged over."""
    out = streaks(df, {"crisis_run": C("regime") == k.CRISIS, "calm_run": C("regime") != k.CRISIS}, bucket=bucket)
    out = running(out, {"_pos": F.lit(1)}, bucket=bucket)
    out = running(out, maxes={"_start": F.when(C("crisis_run") == 1, C("_pos"))}, bucket=bucket)
    left = F.greatest(F.lit(0), bars - (C("_pos") - C("_start") + 1))
    return out.withColumns({"entry_cooldown": F.coalesce(left, F.lit(0)).cast("int"),
                            "post_crisis_block": flag((C("calm_run") == bars) & C("_start").isNotNull())}).drop("_pos", "_start")


def regime_mix(df: DataFrame, n: int = 10, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Share of RANGING among the last n readings and the confidence boost it asks for."""
    w = Roller()
    share = F.avg(F.when(C("regime") == k.RANGING, 1.0).otherwise(0.0)).over(w.frame(-(n - 1), 0))
    seen = F.count(F.lit(1)).over(w.frame(-(n - 1), 0))
    out = chunked(df, lambda d: d.withColumns({"ranging_share": share, "_n": seen}), n - 1, bucket=bucket, rows_per_chunk=rows_per_chunk)
    return out.withColumn("conf_boost", F.when((C("_n") >= 5) & (C("ranging_share") >= 0.70), 0.05).otherwise(0.0)).drop("_n")


def deciding_bars(bars: DataFrame, n: int) -> DataFrame:
    """The ``n``-th bar of every session, or its last one where it has fewer (``too_few``), with the number of its bars."""
    by = Window.partitionBy("symbol", "trade_date")
    out = bars.withColumns({"_n": F.row_number().over(by.orderBy("dt")), "n_bars": F.count(F.lit(1)).over(by)})
    return out.where(C("_n") == F.least(F.lit(n), C("n_bars"))).withColumn("too_few", C("n_bars") < n).drop("_n")


def day_quality(conf: Column, adx: Column, adx5: Column, rsi: Column, rsi5: Column, bb_width: Column) -> Column:
    tired = ((rsi > 80) | (rsi < 20)) & ((rsi5 > 75) | (rsi5 < 25))
    issues = flag(conf < 0.60) + flag((adx + adx5) / 2 < 30) + flag(tired) + flag(bb_width < 0.15)
    return F.when(issues >= 2, "BAD").otherwise("GOOD")


def divergence(bars: DataFrame, index: str, other: str) -> DataFrame:
    """Return of ``other`` minus return of ``index`` per bar; diverging when signs differ and the gap exceeds 0.1."""
    ret = bars.select("dt", "symbol", ((F.try_divide("close", "open") - 1) * 100).alias("ret"))
    a = ret.where(C("symbol") == index).select("dt", C("ret").alias("_a"))
    b = ret.where(C("symbol") == other).select("dt", C("ret").alias("_b"))
    out = a.join(b, "dt").withColumn("spread", C("_b") - C("_a"))
    return out.select("dt", "spread", ((F.signum("_a") * F.signum("_b") < 0) & (F.abs("spread") > 0.1)).alias("diverges"))


# --- hysteresis -----------------------------------------------------------------------------------------------------
class Hysteresis:
    """A regime changes after ``CONFIRM_BARS`` equal readings and the current one's minimum duration."""

    def __init__(self, current: int = k.RANGING, held: int = 0):
        self.current, self.held, self.pending, self.count = current, held, None, 0

    def step(self, reading: int) -> bool:
        if reading == self.current:
            self.pending, self.count = None, 0
        elif reading == self.pending:
            self.count += 1
        else:
            self.pending, self.count = reading, 1
        if self.count >= k.CONFIRM_BARS and self.held >= k.MIN_DURATION.get(self.current, 4):
            self.current, self.held, self.pending, self.count = self.pending, 0, None, 0
            return True
        self.held += 1
        return False


STATES = (k.TRENDING, k.RANGING, k.CRISIS, k.UNCERTAIN)


def _run(readings, current, first):
    h, out, last = Hysteresis(current, k.MIN_DURATION[k.RANGING] if first else 0), [], -1
    for i, r in enumerate(readings):
        if h.step(int(r)):
            last = i
        out.append(h.current)
    return out, last


def hysteresis(df: DataFrame) -> DataFrame:
    """Confirmed regime and confidence ramp per bar, for any number of sessions.

    Counters restart with each session and only the regime survives, so a session is a map from the regime it is entered
    with to the one it leaves.  Sessions are summarised for every possible entry, the (tiny) session table is folded per
    symbol, and each session is then run once with its true entry.
    """
    key = ["symbol", "trade_date"]
    ints = ArrayType(IntegerType())
    shape = StructType([df.schema["symbol"], df.schema["trade_date"], StructField("n", IntegerType()), StructField("ends", ints), StructField("lasts", ints),
                        StructField("end0", IntegerType()), StructField("last0", IntegerType())])

    def summarize(pdf):
        r = pdf.sort_values("dt", kind="stable")["regime"].tolist()
        runs = [_run(r, s, False) for s in STATES]
        o, last = _run(r, k.RANGING, True)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "trade_date": [pdf["trade_date"].iloc[0]], "n": [len(r)], "ends": [[x[0][-1] for x in runs]],
                             "lasts": [[x[1] for x in runs]], "end0": [o[-1]], "last0": [last]})
    entry = StructType(shape.fields[:2] + [StructField("_entry", IntegerType()), StructField("_first", IntegerType()), StructField("_since", LongType())])

    def fold(pdf):
        pdf = pdf.sort_values("trade_date")
        cur, since, rows = k.RANGING, 0, []
        for i, (n, ends, lasts, e0, l0) in enumerate(zip(pdf["n"], pdf["ends"], pdf["lasts"], pdf["end0"], pdf["last0"])):
            rows.append((cur, int(i == 0), since))
            j = STATES.index(cur)
            end, last = (e0, l0) if i == 0 else (ends[j], lasts[j])
            cur, since = int(end), (since + n if last < 0 else n - 1 - last)
        out = pdf[key].copy()
        out["_entry"], out["_first"], out["_since"] = zip(*rows)
        return out
    slim = df.select(*key, "dt", "regime")
    entries = slim.groupBy(*key).applyInPandas(summarize, shape).groupBy("symbol").applyInPandas(fold, entry)
    final = StructType(list(df.schema.fields) + [StructField("confirmed_regime", IntegerType()), StructField("bars_since_flip", LongType())])

    def run(pdf):
        pdf = pdf.sort_values("dt", kind="stable")
        h = Hysteresis(int(pdf["_entry"].iloc[0]), k.MIN_DURATION[k.RANGING] if pdf["_first"].iloc[0] else 0)
        since, reg, age = int(pdf["_since"].iloc[0]), [], []
        for r in pdf["regime"]:
            since = 0 if h.step(int(r)) else since + 1
            reg.append(h.current)
            age.append(since)
        pdf["confirmed_regime"], pdf["bars_since_flip"] = reg, age
        return pdf.drop(columns=["_entry", "_first", "_since"])
    out = df.join(entries, key, "left").groupBy(*key).applyInPandas(run, final)
    return out.withColumn("conf_ramp", 1 - F.exp(-C("bars_since_flip") / (k.CONF_RAMP + 1e-9)))
