"""State machines that restart every session, run per (symbol, trade_date): a session holds a bounded number of bars."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from barflow import constants as k

KEY = ("symbol", "trade_date")


def _scan(df: DataFrame, fields: list[StructField], make, columns: list[str], key=KEY, order="dt") -> DataFrame:
    """Feed each session's rows in order to a fresh state object and append what it returns."""
    schema = StructType(list(df.schema.fields) + fields)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = make()
        rows = [state.step(*r) for r in pdf[columns].itertuples(index=False, name=None)]
        for i, f in enumerate(fields):
            pdf[f.name] = [r[i] for r in rows]
        return pdf
    return df.groupBy(*key).applyInPandas(kernel, schema)


class Staleness:
    """Penalty grows by 0.05 while the micro regime opposes the direction and shrinks by 0.01 otherwise."""

    def __init__(self):
        self.value = 0.0

    def step(self, micro, direction):
        if (direction, micro) in (("UP", "TRENDING_DN"), ("DOWN", "TRENDING_UP")):
            self.value = min(0.15, self.value + 0.05)
        else:
            self.value = max(0.0, self.value - 0.01)
        return (self.value,)


def stale_penalty(df: DataFrame) -> DataFrame:
    return _scan(df, [StructField("stale_penalty", DoubleType())], Staleness, ["micro_regime", "direction"])


class FlipLock:
    """Two flips in three predictions lock three bars; after the lock, ten bars pass before the next one."""

    def __init__(self, lock: int = 3, rest: int = 10):
        self.lock, self.rest, self.sides, self.left, self.cool = lock, rest, [], 0, 0

    def step(self, side):
        penalty = 0.0
        if self.left > 0:
            self.left -= 1
            if self.left == 0:
                self.sides, self.cool = [], self.rest
            else:
                penalty = 0.08
        self.sides = (self.sides + [side])[-3:]
        if self.cool > 0:
            self.cool -= 1
        if self.left == 0 and self.cool == 0 and len(self.sides) == 3 and self.sides[0] != self.sides[1] != self.sides[2]:
            self.left = self.lock
        return self.left, penalty


def temporal_lock(df: DataFrame, side: str) -> DataFrame:
    return _scan(df, [StructField("lock_bars", IntegerType()), StructField("lock_penalty", DoubleType())], FlipLock, [side])


class Pullback:
    """Wait for price to come back to VWAP after a trend is seen, then enter when momentum resumes."""

    def __init__(self, wait: int = 12, strict: bool = True):
        self.wait, self.strict = wait, strict
        self.clear()

    def clear(self):
        self.side, self.age, self.touched = None, 0, False

    def zone(self, close, vwap, atr):
        if not vwap > 0:
            return False
        band = max(vwap * 0.003, atr * 0.5) if self.strict else atr
        return abs(close - vwap) <= band

    def step(self, side, close, vwap, atr, velocity, imbalance):
        if side is None or side != side:
            return False, ""
        atr = atr if atr == atr and atr else 1.0
        vwap, velocity, imbalance = (x if x == x and x is not None else 0.0 for x in (vwap, velocity, imbalance))
        near, sign = self.zone(close, vwap, atr), 1 if side == "UP" else -1
        resuming = velocity * sign > 0.08 and imbalance * sign > 0.15
        if self.side is not None:
            self.age += 1
            if self.age > self.wait:
                self.clear()
        if self.side is not None and self.side != side:
            self.clear()
            if not self.strict and near:
                # The looser form enters at once when the direction flips inside the zone, keeping the new setup open.
                self.side, self.touched = side, True
                return True, "ENTRY"
        if self.side is None:
            self.side, self.age, self.touched = side, 0, near
            if not near:
                return False, "WAIT_PULLBACK"
        self.touched = self.touched or near
        if not self.touched:
            return False, "WAIT_VWAP"
        if not resuming:
            if self.age < self.wait - 2:
                return False, "WAIT_RESUME"
            if not ((close - vwap) * sign > 0):
                if self.strict:
                    self.clear()
                return False, "EXPIRED"
        self.clear()
        return True, "ENTRY"


def pullback_entry(df: DataFrame, strict: bool = True) -> DataFrame:
    """Entry decisions over rows that carry ``direction`` (NULL where earlier gates blocked)."""
    fields = [StructField("entry", BooleanType()), StructField("entry_state", StringType())]
    return _scan(df, fields, lambda: Pullback(strict=strict), ["direction", "close", "vwap", "atr_14", "vwap_dev_vel", "tick_imbalance"])


class HorizonWeights:
    """Weights move 5% toward win or loss of the horizon traded, then are normalised."""

    def __init__(self):
        self.w = dict(k.HORIZON_WEIGHTS)

    def step(self, h, won):
        self.w[h] = 0.95 * self.w.get(h, 0.25) + 0.05 * float(won)
        total = sum(self.w.values()) + 1e-9
        self.w = {x: v / total for x, v in self.w.items()}
        return tuple(self.w[x] for x in k.HORIZONS)


def horizon_weights(df: DataFrame, key=KEY, order="dt") -> DataFrame:
    fields = [StructField(f"w{h}", DoubleType()) for h in k.HORIZONS]
    return _scan(df, fields, HorizonWeights, ["h", "won"], key, order)
