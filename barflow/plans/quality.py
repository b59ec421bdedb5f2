"""Row validation: mandatory features, bad-value counts, bar sanity with memory of the last good bar, drift, warm-up."""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from barflow import constants as k
from barflow.functions.numeric import INF

C = F.col


def is_bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INF))


def count_if(conditions: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.when(c, 1).otherwise(0)
    return total


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add optional columns that are absent."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def validate_rows(df: DataFrame, features: Sequence[str], mandatory: Sequence[str] = k.MANDATORY) -> DataFrame:
    """Status columns, not a filter: missing mandatory features, bad and outlying features, validity and why not."""
    missing = F.array_compact(F.array(*[F.when(C(c).isNull() | F.isnan(C(c).cast("double")), F.lit(c)) for c in mandatory]))
    bad = count_if([is_bad(C(c).cast("double")) for c in features])
    wild = count_if([~is_bad(C(c).cast("double")) & (F.abs(C(c)) > 1e6) for c in features])
    out = df.withColumns({"missing_mandatory": missing, "bad_features": bad, "outliers": wild})
    too_many = C("bad_features") > len(features) * 0.2
    reason = (F.when(F.size("missing_mandatory") > 0, F.concat(F.lit("Missing mandatory: "), F.array_join("missing_mandatory", ",")))
              .when(too_many, F.concat(F.lit("Too many NaN features: "), C("bad_features").cast("string"), F.lit(f"/{len(features)}"))))
    return out.withColumns({"row_valid": (F.size("missing_mandatory") == 0) & ~too_many, "reject_reason": F.coalesce(reason, F.lit(""))})


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that are not entirely NULL: one aggregate over all of them, one row to the driver."""
    row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


def feature_usability(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A row per feature: its known values, all rows, and whether any value is known."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in features])
    long = counts.unpivot("n_rows", list(features), "feature", "n_known")
    return long.select("feature", "n_known", "n_rows", (C("n_known") > 0).alias("usable"))


def live_features(features: Sequence[str], unavailable: Sequence[str]) -> list[str]:
    return [c for c in features if c not in set(unavailable)]


def regime_features(regime: int, unavailable: Sequence[str] = ()) -> list[str]:
    """Core features, plus the ones a regime adds."""
    return live_features([*k.TIER1, *k.TIER2.get(regime, ())], unavailable)


def mask_by_regime(df: DataFrame) -> DataFrame:
    """NULL out the features that the row's regime does not use."""
    return df.withColumns({c: F.when(C("regime") == r, C(c)) for r, cols in k.TIER2.items() for c in cols})


def _parts(session):
    return ("symbol", session)


BAR_STATUS = [StructField("bar_valid", BooleanType()), StructField("errors", ArrayType(StringType())),
              StructField("bad_in_row", IntegerType()), StructField("halt", BooleanType())]


class BarChecker:
    """Memory of one symbol's last good bar.  Shared by the batch kernel and the streaming processor."""

    def __init__(self, close: float = 0.0, ts=None, bad: int = 0, max_gap_seconds: float = k.MAX_TS_GAP, max_gap_pct: float = k.MAX_GAP_PCT):
        self.close, self.ts, self.bad = close, ts, bad
        self.max_gap_seconds, self.max_gap_pct = max_gap_seconds, max_gap_pct

    def check(self, o, h, low, c, ts, now=None):
        errors = []
        known = all(v is not None and v == v for v in (o, h, low, c))
        if not known or c <= 0:
            errors.append("INVALID_CLOSE")
        if not known or not (h >= max(o, c) and min(o, c) >= low and low >= 0):
            errors.append("OHLC_VIOLATION")
        if known and self.close > 0 and c > 0 and abs(c - self.close) / self.close * 100 > self.max_gap_pct:
            errors.append("PRICE_GAP")
        if self.ts is not None and (ts - self.ts).total_seconds() > self.max_gap_seconds:
            errors.append("TIMESTAMP_GAP")
        if now is not None and (now - ts).total_seconds() > k.STALE_SECONDS:
            errors.append("STALE_BAR")
        if errors:
            self.bad += 1
        else:
            self.bad, self.close, self.ts = 0, c, ts
        return not errors, errors, self.bad, self.bad >= k.HALT_AFTER


def validate_bars(bars: DataFrame, max_gap_seconds: float = k.MAX_TS_GAP, max_gap_pct: float = k.MAX_GAP_PCT) -> DataFrame:
    """Judge each bar against the session's last good one; ``errors`` lists what is wrong, ``halt`` marks the third in a row.

    Whether a bar is good decides what the next one is compared with, so rows are taken in order inside a session, which
    holds at most one bar per grid step.
    """
    schema = StructType(list(bars.schema.fields) + BAR_STATUS)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", kind="stable")
        memory, rows = BarChecker(max_gap_seconds=max_gap_seconds, max_gap_pct=max_gap_pct), []
        for o, h, low, c, ts in zip(pdf["open"], pdf["high"], pdf["low"], pdf["close"], pdf["dt"]):
            rows.append(memory.check(o, h, low, c, ts))
        for i, f in enumerate(BAR_STATUS):
            pdf[f.name] = [r[i] for r in rows]
        return pdf
    return bars.groupBy("symbol", "trade_date").applyInPandas(kernel, schema)


def bar_sanity(bars: DataFrame, step_seconds: int = 60) -> DataFrame:
    """Stateless twin of :func:`validate_bars`: compares with the previous bar, good or not, entirely in the JVM."""
    w = Window.partitionBy("symbol", "trade_date").orderBy("dt")
    prev, prev_ts = F.lag("close").over(w), F.lag("dt").over(w)
    gap = (F.unix_micros(C("dt").cast("timestamp")) - F.unix_micros(prev_ts.cast("timestamp"))) / 1e6
    broken = ~((C("high") >= F.greatest("open", "close")) & (F.least("open", "close") >= C("low")) & (C("low") >= 0))
    errors = F.array_compact(F.array(
        F.when(F.coalesce(C("close") <= 0, F.lit(True)), "INVALID_CLOSE"), F.when(F.coalesce(broken, F.lit(True)), "OHLC_VIOLATION"),
        F.when((prev > 0) & (C("close") > 0) & (F.abs(C("close") - prev) / prev * 100 > k.MAX_GAP_PCT), "PRICE_GAP"),
        F.when(gap > 2.5 * step_seconds, "TIMESTAMP_GAP")))
    return bars.withColumn("errors", errors)


def warmup(bars: DataFrame, minutes: int = k.WARMUP_MINUTES, rows: int = k.WARMUP_BARS) -> DataFrame:
    """Ready once the opening minutes are over and enough bars of the session exist."""
    n = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("dt"))
    reason = (F.when(C("minute_of_day") < minutes, "OPEN_WINDOW").when(n < rows, "FEW_BARS").otherwise(""))
    return bars.withColumns({"bars_in_session": n, "warmup_reason": reason}).withColumn("ready", C("warmup_reason") == "")


# --- distributions and drift ----------------------------------------------------------------------------------------
def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[C(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), "feature", "value")


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, sample deviation and number of values per feature: one aggregate, then a stack."""
    agg = df.agg(*[f(C(c).cast("double")).alias(f"{c}{s}") for c in columns
                   for f, s in ((F.avg, "__m"), (F.stddev_samp, "__s"), (F.count, "__n"))])
    parts = ", ".join(f"'{c}', `{c}__m`, `{c}__s`, `{c}__n`" for c in columns)
    return agg.select(F.expr(f"stack({len(columns)}, {parts}) AS (feature, mean, std, n)"))


def feature_stability(df: DataFrame, columns: Sequence[str], baseline_rows: int, window_rows: int, order: Sequence[str] = ("dt", "symbol"),
                      bucket: str = "hour") -> DataFrame:
    """Shift of the recent mean in baseline deviations, by row position (two-level row number, no global sort)."""
    from barflow.operators.scans import running
    pos = running(df, {"_pos": F.lit(1)}, keys=[], order=list(order), bucket=bucket)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    both = pos.crossJoin(F.broadcast(total))  # one row on the right
    old, new = C("_pos") <= baseline_rows, C("_pos") > C("_total") - window_rows
    agg = both.groupBy("_total").agg(*[f(F.when(m, C(c).cast("double"))).alias(f"{c}{s}") for c in columns
                                       for f, m, s in ((F.avg, old, "__b"), (F.stddev_samp, old, "__s"), (F.avg, new, "__r"))])
    parts = ", ".join(f"'{c}', `{c}__b`, `{c}__s`, `{c}__r`" for c in columns)
    out = agg.select("_total", F.expr(f"stack({len(columns)}, {parts}) AS (feature, base, std, recent)"))
    fsi = F.abs(C("recent") - C("base")) / F.when(C("std") != 0, C("std"))
    return out.select("feature", F.coalesce(fsi, F.lit(0.0)).alias("fsi"))


def drift_zscores(df: DataFrame, stats: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Largest deviation from the training distribution per row, killed features and the confidence multiplier.

    ``stats`` has one row per feature; it is turned into one row of structs, so nothing is unpivoted per input row.
    """
    wide = stats.groupBy().pivot("feature", list(columns)).agg(F.first(F.struct("mean", "std")))
    both = df.crossJoin(F.broadcast(wide.select(*[C(c).alias(f"_st_{c}") for c in columns])))  # a single row
    zs = []
    for c in columns:
        if c in k.DRIFT_EXEMPT:
            continue
        s = C(f"_st_{c}")
        z = F.when((s["std"] >= 1e-9) & ~is_bad(C(c).cast("double")), F.abs((C(c) - s["mean"]) / s["std"]))
        zs.append(F.struct(F.lit(c).alias("feature"), z.alias("z")))
    out = both.withColumn("_z", F.array(*zs))
    out = out.withColumn("max_z", F.coalesce(F.array_max(F.transform("_z", lambda x: x["z"])), F.lit(0.0)))
    out = out.withColumn("killed", F.size(F.filter("_z", lambda x: x["z"] > k.DRIFT_KILL)))
    out = out.withColumn("warned", F.size(F.filter("_z", lambda x: (x["z"] > k.DRIFT_WARN) & (x["z"] <= k.DRIFT_KILL))))
    return out.withColumn("conf_mult", drift_multiplier(C("max_z"))).select(*ids, "max_z", "killed", "warned", "conf_mult")


def drift_multiplier(z: Column) -> Column:
    return (F.when(z >= k.DRIFT_KILL, 0.60).when(z >= k.DRIFT_BLOCK, 0.5).when(z >= k.DRIFT_WARN, 0.75).otherwise(1.0))
