"""Horizon votes and probability blends: conditional sums per row key, one aggregate each."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.operators.chunks import CHUNK, chunked

C = F.col


def lookup(key: Column, table: dict, default: float) -> Column:
    out = None
    for x, v in table.items():
        out = F.when(key == x, float(v)) if out is None else out.when(key == x, float(v))
    return out.otherwise(float(default))


def blend_expert(p_regime: Column, p_global: Column, regime_conf: Column) -> Column:
    """Regime expert weighted by regime confidence; the global model alone where no expert exists."""
    return F.when(p_regime.isNotNull() & ~F.isnan(p_regime), regime_conf * p_regime + (1 - regime_conf) * p_global).otherwise(p_global)


def _sides(scored):
    up = C("proba") > 0.5
    return scored.withColumns({"_up": up, "_conf": F.when(up, C("proba")).otherwise(1 - C("proba"))})


def _result(agg, up, dn, total):
    return agg.withColumns({"direction": F.when(up, "UP").otherwise("DOWN"), "agreement": F.when(up, C("vote_up")).otherwise(C("vote_dn")) / total})


def horizon_vote(scored: DataFrame, keys=("symbol", "dt"), bypass: bool = False) -> DataFrame:
    """Direction, agreement and mean confidence from horizons above their floor; votes weigh confidence squared."""
    s = _sides(scored)
    floor = F.lit(k.CONF_MIN) if bypass else lookup(C("h"), k.CONF_BY_HORIZON, k.CONF_MIN)
    counted = (C("_conf") >= floor) & (F.lit(True) if bypass else C("h").isin(15, 30))
    w = lookup(C("h"), k.HORIZON_WEIGHTS, 0.25)
    vote = F.when(counted, w * C("_conf") * C("_conf")).otherwise(0.0)
    agg = s.groupBy(*keys).agg(F.sum(F.when(C("_up"), vote).otherwise(0.0)).alias("vote_up"), F.sum(F.when(C("_up"), 0.0).otherwise(vote)).alias("vote_dn"),
                               F.sum(F.when(counted, w * C("_conf")).otherwise(0.0)).alias("_wc"), F.sum(F.when(counted, w).otherwise(0.0)).alias("_w"),
                               F.count(F.when(counted, 1)).alias("n_votes"))
    total = C("vote_up") + C("vote_dn")
    out = _result(agg, C("vote_up") > C("vote_dn"), None, F.when(total > 0, total))
    none = C("n_votes") == 0
    return out.withColumns({"direction": F.when(~none, C("direction")), "mean_conf": F.when(~none, C("_wc") / F.when(C("_w") > 0, C("_w")))}).drop("_wc", "_w")


def horizon_vote_v5(scored: DataFrame, keys=("symbol", "dt")) -> DataFrame:
    """Two long horizons, clipped probabilities; confidence is averaged over the agreeing horizons only."""
    clipped = F.least(F.lit(k.PROBA_CLIP[1]), F.greatest(F.lit(k.PROBA_CLIP[0]), C("proba")))
    s = _sides(scored.where(C("h").isin(*k.V5_WEIGHTS)).withColumn("proba", clipped))
    w = lookup(C("h"), k.V5_WEIGHTS, 0.5)
    wc = w * C("_conf")
    up = C("_up")
    agg = s.groupBy(*keys).agg(F.sum(F.when(up, wc).otherwise(0.0)).alias("vote_up"), F.sum(F.when(up, 0.0).otherwise(wc)).alias("vote_dn"),
                               F.sum(F.when(up, w).otherwise(0.0)).alias("_wu"), F.sum(F.when(up, 0.0).otherwise(w)).alias("_wd"))
    out = _result(agg, C("vote_up") >= C("vote_dn"), None, C("vote_up") + C("vote_dn"))
    conf = F.when(C("direction") == "UP", C("vote_up") / F.when(C("_wu") > 0, C("_wu"))).otherwise(C("vote_dn") / F.when(C("_wd") > 0, C("_wd")))
    return out.withColumns({"mean_conf": conf, "passes": C("agreement") >= k.V5_CONF_ENTRY}).drop("_wu", "_wd")


def quick_agreement(scored: DataFrame, keys=("symbol", "dt")) -> DataFrame:
    """Largest side's share of weighted confidence over all horizons."""
    s = _sides(scored)
    wc = lookup(C("h"), k.HORIZON_WEIGHTS, 0.25) * C("_conf")
    agg = s.groupBy(*keys).agg(F.sum(F.when(C("_up"), wc).otherwise(0.0)).alias("vote_up"), F.sum(F.when(C("_up"), 0.0).otherwise(wc)).alias("vote_dn"))
    return agg.withColumns({"direction": F.when(C("vote_up") >= C("vote_dn"), "UP").otherwise("DOWN"),
                            "agreement": F.greatest("vote_up", "vote_dn") / (C("vote_up") + C("vote_dn"))})


def by_horizon(scored: DataFrame, keys=("symbol", "dt")) -> DataFrame:
    """Probabilities of a row side by side, p1 p5 p15 p30."""
    return scored.groupBy(*keys).agg(*[F.max(F.when(C("h") == h, C("proba"))).alias(f"p{h}") for h in k.HORIZONS])


def horizon_agreement(p5: Column, p15: Column, p30: Column) -> Column:
    """STRUCT(agree, reason): the 15 and 30 minute horizons must point the same way, five minutes only informs."""
    a, b, c = p15 > 0.5, p30 > 0.5, p5 > 0.5
    reason = (F.when(p15.isNull() | p30.isNull(), "insufficient_data").when(a != b, "15m_30m_conflict")
              .when(p5.isNotNull() & (c != a), "5m_disagree_ignored").otherwise("directional_agreement_ok"))
    return F.struct((reason != "15m_30m_conflict").alias("agree"), reason.alias("reason"))


def conf_percentile(df: DataFrame, conf: str = "conf", n: int = 500, min_rows: int = 20, keys=("symbol", "regime"), bucket: str = "day",
                    rows_per_chunk: int | None = None) -> DataFrame:
    """Share of the last n confidences of the regime that are not above the current one; NULL while history is short."""
    past = Window.partitionBy(*keys, CHUNK).orderBy("dt").rowsBetween(-n, -1)

    def run(d):
        now = C("_now")
        out = d.withColumn("_now", C(conf)).withColumn("_seen", F.collect_list(conf).over(past))
        below = F.size(F.filter("_seen", lambda x: x <= now))
        return out.withColumn("conf_pctile", F.when(F.size("_seen") >= min_rows, below / F.size("_seen") * 100)).drop("_now", "_seen")
    return chunked(df, run, n, keys=keys, bucket=bucket, rows_per_chunk=rows_per_chunk)


def flip_count(df: DataFrame, side: str, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Direction changes among the last three predictions of a session."""
    w = Window.partitionBy("symbol", CHUNK, "trade_date").orderBy("dt")

    def run(d):
        out = d.withColumn("_f", F.when(F.lag(side).over(w) != C(side), 1).otherwise(0))
        return out.withColumn("flips", F.sum("_f").over(w.rowsBetween(-1, 0)).cast("int")).drop("_f")
    return chunked(df, run, 3, bucket=bucket, rows_per_chunk=rows_per_chunk)
