"""Fixed values that results depend on.  Kept together so that a rule table can be swapped in one place."""

EPS = 1e-9              # denominators of feature ratios
EPS_IND = 1e-10         # denominators of indicator ratios

# Regime codes.
UNCERTAIN, TRENDING, RANGING, CRISIS = -1, 0, 1, 2
REGIME_NAMES = {-1: "UNCERTAIN", 0: "TRENDING", 1: "RANGING", 2: "CRISIS"}

# Horizons in minutes and their vote weights.
HORIZONS = (1, 5, 15, 30)
HORIZON_WEIGHTS = {1: 0.05, 5: 0.20, 15: 0.45, 30: 0.30}
CONF_MIN = 0.52
CONF_BY_HORIZON = {1: 0.52, 5: 0.52, 15: 0.57, 30: 0.57}
CONF_FLOOR_TRENDING = 0.57
CONF_STRONG, CONF_MODERATE = 0.75, 0.65
V5_WEIGHTS = {15: 0.60, 30: 0.40}
V5_CONF_ENTRY, V5_CONF_STRONG = 0.60, 0.70
PROBA_CLIP = (0.45, 0.82)

# Barrier labels: width multiplier of ATR and number of bars by horizon.
TB_MULT_TRENDING = {1: 1.2, 5: 1.8, 15: 2.2, 30: 2.8}
TB_MULT_RANGING = {1: 0.9, 5: 1.2, 15: 1.5, 30: 2.0}
TB_MULT_CRISIS = {h: 2.0 * k for h, k in TB_MULT_RANGING.items()}
TB_BARS = {1: 10, 5: 6, 15: 3, 30: 2}
TB_MIN_MOVE_PCT = 0.20
TB_VELOCITY_LAMBDA = 0.5
TB_STOP_TIME_DECAY = 0.20
TB_TRENDING_UPPER = 1.07
FIXED_BARRIER = dict(horizon=6, upper_pct=0.005, lower_pct=0.003)

# Contract and cost constants.
LOT_OLD, LOT_NEW, LOT_CUTOVER = 75, 65, "2025-04-26"
BROKERAGE_PER_ORDER, GST = 20.0, 0.18
STT_SELL, STT_EXPIRY = 0.001, 0.00125
TXN_PCT, STAMP_PCT = 0.00053, 0.00003
COST_RT, SLIPPAGE, THETA_DRAG = 0.004, 0.008, 0.003
TOTAL_COST = 0.015
DELTA_BASE, THETA_PER_BAR = 0.45, 0.15
RISK_FREE = 0.065
SESSION_MINUTES, TRADING_DAYS = 375, 252
STRIKE_STEP = 50
OPTION_SLIPPAGE, PROJECTION_THETA = 0.03, 0.0004
LIMIT_BUFFER_PCT, LIMIT_BUFFER_PTS = 0.003, 1.5
SPREAD_NORMAL, SPREAD_HIGH_IV = 0.002, 0.006
FILL_ATM, FILL_EXPIRY, FILL_HIGH_IV = 0.97, 0.88, 0.90

# Expiry-day zones: name, first minute, last minute, entries allowed, stop tightening.
EXPIRY_ZONES = (
    ("EXPIRY_ZONE1_HALF_SIZE", 0, 134, True, 0.875),
    ("EXPIRY_ZONE2_PINNING_BLOCK", 135, 224, False, 0.625),
    ("EXPIRY_ZONE3_PINBREAK_QTR", 225, 334, True, 0.5),
    ("EXPIRY_ZONE4_GAMMA_BLOCK", 335, 999, False, 0.5),
)
EXPIRY_FORCE_EXIT, EXPIRY_MAX_HOLD = 310, 10
EXPIRY_CONF_FLOOR, EXPIRY_IV_BLOCK = 0.65, 20.0

# Sizing and exits.
CAPITAL = 100_000.0
DEPLOY_PCT, MAX_RISK_PCT, MAX_CONTRACTS = 0.75, 0.01, 2
STOP_PCT, TARGET_PCT = 0.10, 0.22
CONF_SIZE_BANDS = ((0.65, 1.00), (0.60, 0.80), (0.55, 0.65), (0.00, 0.50))
MFE_BARS, MFE_PTS = 2, 3.0
V5_LOT, V5_MAX_LOTS, V5_VIX_HALVE = 65, 2, 22.0

# Risk limits.
DAILY_DD_LIVE, DAILY_DD_PAPER, DD_WARN = 0.10, 0.12, 0.70
CONSEC_LIVE, CONSEC_PAPER, COOLDOWN_MIN = 2, 3, 30
VOL_SHOCK, FLIP_MIN, VRECOVERY_AGREE = 3.0, 30, 0.85
WEEK_HALVE, MONTH_HALT = 0.05, 0.10
TRANSITION_MIN, TRANSITION_BOOST = 15, 0.07
V5_MAX_TRADES, V5_GAP_PCT, V5_GAP_TRADES, V5_DAY_LOSS = 3, 1.5, 1, 1500.0
V5_LOSSES, V5_COOLDOWN, V5_WR_WINDOW, V5_WR_MIN = 2, 15, 5, 0.35
SESSION_CAP = 10
MAX_POSITIONS, MAX_EXPOSURE = 2, 0.05
DEDUP_SECONDS = 30

# Expected value.
EV_WIN, EV_LOSS, EV_SAFETY = 1.2, 1.0, 1.8

# Bar validation and drift.
MAX_GAP_PCT, MAX_TS_GAP, HALT_AFTER = 3.0, 150, 3
STALE_SECONDS, LATENCY_WARN_MS, LATENCY_HALT_MS, LATENCY_WINDOW = 300, 500, 2000, 10
DRIFT_WARN, DRIFT_BLOCK, DRIFT_KILL = 2.5, 5.0, 8.0
DRIFT_EXEMPT = ("pressure_ratio", "tick_imbalance", "bb_squeeze", "or_break_up", "or_break_dn", "is_expiry")
WARMUP_MINUTES, WARMUP_BARS = 15, 20

# Regime hysteresis.
CONFIRM_BARS, CONF_RAMP = 3, 5
MIN_DURATION = {TRENDING: 6, RANGING: 4, CRISIS: 1}
ADX_TREND, ADX_PERIOD, SWING_HALF, SWINGS, SWING_LOOKBACK = 22.0, 20, 5, 3, 100

# Feature lists.
MANDATORY = ("close", "atr_14", "atr_14_pct", "rsi_14", "adx_14", "macd_h", "vwap_dist", "above_vwap")
TIER1 = ("ret_5m", "ret_15m", "atr_14_pct", "atr_ratio", "rsi_14", "rsi_slope", "adx_14", "adx_slope", "vwap_dist",
         "vwap_dev_vel", "bb_width", "bb_squeeze", "ema9_21", "ema21_50", "or_break_up", "or_break_dn",
         "iv_rank_approx", "session_pct", "is_expiry")
TIER2 = {TRENDING: ("macd_h", "adx_macd", "ema9_slope"), RANGING: ("range_rsi_extr", "stoch_k", "willr"), CRISIS: ()}
META_CONTEXT = ("session_pct", "iv_proxy", "atr_14_pct", "adx_14", "dmi_diff", "tick_imbalance", "vwap_dev_vel",
                "pressure_ratio", "bb_squeeze", "bb_width", "adx_rsi_trend", "vol_ratio")
META_NEUTRAL, META_LOW, META_PASS = 0.55, 0.45, 0.62
FRACDIFF_D, FRACDIFF_CUT = 0.35, 1e-4
TRAIN_DECAY, DD_CLUSTER, DD_WEIGHT = 1.5, -2.0, 0.3
SEASON_CLIP = 0.03
