"""Numeric kernels on one chunk of rows (numpy / pandas inside a task; Spark does the partitioning)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barflow.constants import FRACDIFF_CUT, FRACDIFF_D
from barflow.operators.chunks import CHUNK, HALO, chunked, drop_halo, with_chunks
from barflow.operators.rolling import Roller
from barflow.operators.scans import running
from barflow.operators.stage import materialize

SMALL_WINDOW = 512


def add_doubles(schema: StructType, names) -> StructType:
    return StructType(list(schema.fields) + [StructField(n, DoubleType()) for n in names])


# --- rolling percent rank -------------------------------------------------------------------------------------------
def rolling_rank(df: DataFrame, source: str, name: str, n: int, min_rows: int, w: Roller) -> DataFrame:
    """Percent rank (ties averaged) of the last value among the last n rows, in a chunked frame."""
    if n <= SMALL_WINDOW:
        frame = w.frame(-(n - 1), 0)
        now = F.col("_now")
        out = df.withColumn("_now", F.col(source)).withColumn("_seen", F.collect_list(source).over(frame))
        below = F.aggregate("_seen", F.lit(0.0), lambda a, x: a + F.when(x < now, 1.0).when(x == now, 0.5).otherwise(0.0))
        rank = (below + 0.5) / F.size("_seen") * 100
        keep = (F.size("_seen") >= min_rows) & now.isNotNull()
        return out.withColumn(name, F.when(keep, rank)).drop("_now", "_seen")
    schema = add_doubles(df.schema, [name])
    order = list(w.order)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[name] = pdf[source].rolling(n, min_periods=min_rows).rank(pct=True) * 100
        return pdf
    return df.groupBy(*w.keys).applyInPandas(kernel, schema)


def add_rolling_rank(bars: DataFrame, source: str, name: str, n: int, min_rows: int, **options) -> DataFrame:
    w = Roller()
    return chunked(bars, lambda d: rolling_rank(d, source, name, n, min_rows, w), n, **options)


# --- fractional difference ------------------------------------------------------------------------------------------
def fracdiff_weights(d: float = FRACDIFF_D, cutoff: float = FRACDIFF_CUT) -> np.ndarray:
    """Binomial weights of (1 - lag)**d, newest first, cut where they fall below ``cutoff``."""
    k = np.arange(1, 100_000)
    w = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
    small = np.abs(w) < cutoff
    return w[:int(np.argmax(small))] if small.any() else w


def add_fracdiff(bars: DataFrame, columns: dict[str, str], d: float = FRACDIFF_D, **options) -> DataFrame:
    """Add name -> fractional difference of a column: only past rows, NULL until the weights are filled."""
    w = fracdiff_weights(d)
    width = len(w)

    def run(df: DataFrame) -> DataFrame:
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("dt", kind="stable")
            for name, source in columns.items():
                x = pdf[source].to_numpy(dtype=float)
                out = np.full(len(x), np.nan)
                if len(x) >= width:
                    out[width - 1:] = np.convolve(x, w, mode="valid")
                pdf[name] = out
            return pdf
        out = df.groupBy("symbol", CHUNK).applyInPandas(kernel, add_doubles(df.schema, columns))
        return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in columns})
    return chunked(bars, run, width - 1, **options)


# --- supertrend -----------------------------------------------------------------------------------------------------
def _advance(pieces, prev_close, basic):
    """One step of a carried band seen as a function of its unknown start: intervals [lo, hi] -> value or identity."""
    out = []

    def put(lo, hi, v):
        if lo > hi:
            return
        if out and v is not None and out[-1][2] == v:
            out[-1] = (out[-1][0], hi, v)
        else:
            out.append((lo, hi, v))
    for lo, hi, v in pieces:
        if v is None:
            keep_lo, keep_hi = max(lo, prev_close), min(hi, basic)
            if keep_lo > keep_hi:
                put(lo, hi, basic)
                continue
            if lo < prev_close:
                put(lo, np.nextafter(prev_close, -np.inf), basic)
            put(keep_lo, keep_hi, None)
            if hi > basic:
                put(np.nextafter(basic, np.inf), hi, basic)
        else:
            put(lo, hi, basic if (basic < v or prev_close > v) else v)
    return out


def _transfer(prev, basic, seed):
    pieces = [(-np.inf, np.inf, None)]
    for c, b, s in zip(prev, basic, seed):
        if np.isnan(b):
            continue
        pieces = [(-np.inf, np.inf, b)] if s else _advance(pieces, c, b)
    return [p[1] for p in pieces], [np.nan if p[2] is None else p[2] for p in pieces]


def _apply(ends, values, x):
    i = int(np.searchsorted(ends, x))
    v = values[min(i, len(values) - 1)]
    return x if np.isnan(v) else v


def _walk(prev, basic, seed, start):
    out, x = np.full(len(basic), np.nan), start
    for i in range(len(basic)):
        b = basic[i]
        if np.isnan(b):
            continue
        if seed[i] or b < x or prev[i] > x:
            x = b
        out[i] = x
    return out


def add_supertrend(bars: DataFrame, n: int = 10, mult: float = 3.0, bucket: str = "day",
                   rows_per_chunk: int | None = None) -> DataFrame:
    """Supertrend bands and direction, exact for any length of history.

    A band is carried from row to row, so chunks cannot start on their own.  Each chunk first reports how it maps the
    band it is entered with to the band it leaves (a few intervals); folding those small tables gives every chunk its
    true entry value.  The direction is then the last crossing, found with a running maximum.
    """
    w = Roller()
    narrow = bars.select("symbol", "dt", "high", "low", "close")

    def basics(df):
        prev = w.lag("close")
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
        out = df.withColumns({"_tr": tr, "_pc": prev})
        out = out.withColumn("_a", w.roll(F.avg, "_tr", n))
        mid = (F.col("high") + F.col("low")) / 2
        out = out.withColumns({"_ub": mid + mult * F.col("_a"), "_lb": mid - mult * F.col("_a")})
        return out.withColumn("_seed", F.col("_a").isNotNull() & w.lag("_a").isNull()).drop("_tr", "_a")
    # The first valid ATR starts the bands; inside later chunks the halo makes _a valid before the real rows begin.
    rows = (basics(with_chunks(narrow, n + 1, bucket=bucket, rows_per_chunk=rows_per_chunk))
            .where(~F.col(HALO)).drop(HALO))
    arr = ArrayType(DoubleType())
    key = [rows.schema["symbol"], StructField(CHUNK, LongType())]
    shape = StructType(key + [StructField(x, arr) for x in ("ue", "uv", "le", "lv")])

    def summarize(pdf):
        pdf = pdf.sort_values("dt", kind="stable")
        pc, seed = pdf["_pc"].to_numpy(float), pdf["_seed"].to_numpy(bool)
        ue, uv = _transfer(pc, pdf["_ub"].to_numpy(float), seed)
        le, lv = _transfer(-pc, -pdf["_lb"].to_numpy(float), seed)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], CHUNK: [pdf[CHUNK].iloc[0]], "ue": [ue], "uv": [uv],
                             "le": [le], "lv": [lv]})

    def fold(pdf):
        pdf = pdf.sort_values(CHUNK)
        u = low = np.nan
        us, ls = [], []
        for ue, uv, le, lv in zip(pdf["ue"], pdf["uv"], pdf["le"], pdf["lv"]):
            us.append(u)
            ls.append(low)
            u, low = _apply(ue, uv, u), _apply(le, lv, low)
        return pd.DataFrame({"symbol": pdf["symbol"], CHUNK: pdf[CHUNK], "_u0": us, "_l0": ls})
    slim = rows.select("symbol", CHUNK, "dt", "_pc", "_ub", "_lb", "_seed")
    starts = (slim.groupBy("symbol", CHUNK).applyInPandas(summarize, shape)
              .groupBy("symbol").applyInPandas(fold, add_doubles(StructType(key), ["_u0", "_l0"])))
    entered = rows.join(starts, ["symbol", CHUNK], "left")
    final = add_doubles(rows.schema, ["st_upper", "st_lower"])

    def bands(pdf):
        pdf = pdf.sort_values("dt", kind="stable")
        pc, seed = pdf["_pc"].to_numpy(float), pdf["_seed"].to_numpy(bool)
        pdf["st_upper"] = _walk(pc, pdf["_ub"].to_numpy(float), seed, pdf["_u0"].iloc[0])
        pdf["st_lower"] = -_walk(-pc, -pdf["_lb"].to_numpy(float), seed, pdf["_l0"].iloc[0])  # already negated
        return pdf.drop(columns=["_u0", "_l0"])
    out = materialize(entered.groupBy("symbol", CHUNK).applyInPandas(bands, final).drop(CHUNK, "_pc", "_ub", "_lb"))
    up = F.col("close") > F.when(~F.isnan("st_upper"), F.col("st_upper"))
    down = F.col("close") < F.when(~F.isnan("st_lower"), F.col("st_lower"))
    up, down = F.coalesce(up, F.lit(False)) & ~F.col("_seed"), F.coalesce(down, F.lit(False)) & ~F.col("_seed")
    out = out.withColumns({"_up": up, "_dn": down})
    # A bar beyond both (crossed) bands turns the direction round; count those turns since the last plain crossing.
    both = F.col("_up") & F.col("_dn")
    out = running(out, {"_k": F.lit(1), "_turns": F.when(both, 1).otherwise(0)}, bucket=bucket)
    plain = (F.col("_up") != F.col("_dn"))
    code = F.when(plain, F.col("_k") * 4 + F.when(F.col("_up"), 2).otherwise(0) + F.col("_turns") % 2)
    out = running(out, maxes={"_last": code}, bucket=bucket)
    base = F.when(F.col("_last").isNull() | (F.col("_last") % 4 >= 2), 1).otherwise(-1)
    odd = (F.col("_turns") - F.coalesce(F.col("_last") % 2, F.lit(0))) % 2 != 0
    done = (out.withColumn("supertrend", F.when(odd, -base).otherwise(base).cast("double"))
            .withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("st_upper", "st_lower")}))
    return bars.join(done.select("symbol", "dt", "st_upper", "st_lower", "supertrend"), ["symbol", "dt"], "left")


# --- dominant cycle -------------------------------------------------------------------------------------------------
def add_cycle(bars: DataFrame, n: int = 250, **options) -> DataFrame:
    """Dominant period of the last n closes (0 until n rows), its slow average and the CHOP / TREND / MIXED label."""
    def run(df: DataFrame) -> DataFrame:
        def kernel(pdf):
            pdf = pdf.sort_values("dt", kind="stable")
            x = pdf["close"].to_numpy(dtype=float)
            out = np.zeros(len(x))
            if len(x) >= n:
                view = np.lib.stride_tricks.sliding_window_view(x, n)
                for s in range(0, len(view), 4096):
                    part = view[s:s + 4096]
                    power = np.abs(np.fft.rfft(part - part.mean(axis=1, keepdims=True), axis=1))[:, 1:]
                    out[n - 1 + s:n - 1 + s + len(part)] = n / (np.argmax(power, axis=1) + 1.0)
            pdf["cycle_period"] = out
            return pdf
        return df.groupBy("symbol", CHUNK).applyInPandas(kernel, add_doubles(df.schema, ["cycle_period"]))
    return chunked(bars, run, n - 1, **options)


__all__ = ["add_cycle", "add_fracdiff", "add_rolling_rank", "add_supertrend", "drop_halo", "fracdiff_weights", "rolling_rank",
           "Window"]
