"""The scalar functions as SQL functions: plain SQL bodies, so no Python runs per row."""
from __future__ import annotations

from pyspark.sql import SparkSession

from barflow import constants as k

FUNCTIONS = {
    "bf_lot_size(d DATE) RETURNS INT": f"CASE WHEN d >= DATE'{k.LOT_CUTOVER}' THEN {k.LOT_NEW} ELSE {k.LOT_OLD} END",
    "bf_theta(minutes DOUBLE) RETURNS DOUBLE": f"{k.THETA_PER_BAR}D * sqrt(750 / greatest(minutes, 30D))",
    "bf_atm_strike(spot DOUBLE) RETURNS INT": f"CAST(bround(spot / {k.STRIKE_STEP}) * {k.STRIKE_STEP} AS INT)",
    "bf_charges(entry DOUBLE, exit DOUBLE, qty INT, is_expiry BOOLEAN) RETURNS DOUBLE":
        f"{2 * k.BROKERAGE_PER_ORDER * (1 + k.GST)}D + exit * qty * CASE WHEN is_expiry THEN {k.STT_EXPIRY}D ELSE {k.STT_SELL}D END "
        f"+ (entry + exit) * qty * {k.TXN_PCT}D + entry * qty * {k.STAMP_PCT:.5f}D",
    "bf_effective_cost(edge BOOLEAN, iv DOUBLE, transition BOOLEAN, is_expiry BOOLEAN) RETURNS DOUBLE":
        f"{k.TOTAL_COST}D * least(3D, CASE WHEN edge THEN 1.4D ELSE 1D END * CASE WHEN iv > 1.5 THEN 1.3D ELSE 1D END "
        "* CASE WHEN transition THEN 1.5D ELSE 1D END * CASE WHEN is_expiry THEN 1.6D ELSE 1D END)",
    "bf_ev_net(ev DOUBLE, cost DOUBLE, minute INT, iv DOUBLE) RETURNS DOUBLE":
        f"ev - cost * CASE WHEN minute <= 30 OR minute >= 345 THEN {k.EV_SAFETY}D ELSE 1D END "
        "* CASE WHEN iv > 2.0 THEN 1.8D WHEN iv > 1.5 THEN 1.5D WHEN iv > 1.2 THEN 1.2D ELSE 1D END",
    "bf_effective_delta(bars INT, move DOUBLE, atr DOUBLE, direction STRING) RETURNS DOUBLE":
        f"least(0.8D, greatest(0.1D, {k.DELTA_BASE}D + move / (atr + 1e-9D) * 0.1D)) * exp(-0.002D * greatest(bars, 0)) "
        "* CASE WHEN direction = 'UP' THEN 0.90D ELSE 1.05D END",
    "bf_bucket_score(x DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS INT":
        "CASE WHEN x <= a THEN -2 WHEN x <= b THEN -1 WHEN x <= c THEN 0 WHEN x <= d THEN 1 WHEN x IS NOT NULL THEN 2 END",
    "bf_late_day(minute INT) RETURNS DOUBLE": "CASE WHEN minute >= 315 THEN 1.10D WHEN minute >= 270 THEN 1.05D ELSE 1D END",
    "bf_clean(x DOUBLE, fallback DOUBLE) RETURNS DOUBLE":
        "CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('infinity') THEN fallback ELSE x END",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
