"""Thresholds and window sizes.

Fixed values: every number below must stay as it is for the results to agree
with the published behaviour of the analytics this package provides.
"""

from __future__ import annotations

# Sentiment
BULLISH_SCORE = 0.05
BEARISH_SCORE = -0.05
RISK_OFF_BULL_PCT = 30.0
MIN_HEADLINE_LENGTH = 3

# Rolling windows and movers
SHORT_WINDOW = 7
LONG_WINDOW = 30
MIN_APPEARANCE_SHARE = 0.50
TOP_MOVERS = 15
TOP_MOVERS_PER_DAY = 10
EXTREME_SESSIONS = 5
VOL_ELEVATED = 1.5
VOL_SLIGHTLY_HIGH = 1.1
VOL_NORMAL_LOW = 0.9
VAR_QUANTILE = 0.05

# Breadth
BREADTH_BULL = 60.0
BREADTH_BEAR = 40.0
BREADTH_LADDER = (70.0, 55.0, 45.0, 30.0)
REGIME_LOOKBACK = 63
REGIME_MIN_ROWS = 10
REGIME_BULL_RANK = 0.65
REGIME_BEAR_RANK = 0.35

# Price tiers: right-closed intervals
TIER_EDGES = (0, 10, 25, 50, 100, 200, 9999)
TIER_LABELS = ("<$10", "$10-25", "$25-50", "$50-100", "$100-200", ">$200")

# Ingestion
MIN_CHANGE_FOR_RECOMPUTE = 0.01
MIN_BARS = 60
OUTLIER_WINDOW = 30
OUTLIER_MIN_ROWS = 5
OUTLIER_SIGMA = 3.0
SPLIT_LOW = 0.60
SPLIT_HIGH = 1.67
GAP_FILL_MAX = 3
OVERNIGHT_GAP = 0.15
MAX_SOURCE_FAILURES = 3

# Validation
MIN_PRICE = 0.01
MAX_PRICE = 100_000.0
MIN_ROWS_PER_DAY = 50
MAX_DUPLICATE_RATE = 0.01
MIN_HISTORY_DAYS = 3
MAX_NULL_RATE = 0.5

# Technical
TREND_GAP = 0.005
MIN_SYMBOL_ROWS = 3
RSI_WINDOW = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_WINDOW, BB_SIGMA = 20, 2.0
ATR_WINDOW = 14
MOMENTUM_WINDOW = 10
DRAWDOWN_WINDOW = 252
SMA_FAST, SMA_SLOW = 20, 50
ADAPTIVE_LOOKBACK = 63
ADAPTIVE_RECENT = 21
ADAPTIVE_HIGH, ADAPTIVE_LOW = 0.80, 0.20
ADAPTIVE_FAST_MULT, ADAPTIVE_SLOW_MULT = 0.70, 1.35
# Window sizes per volatility regime: multiplier -> rsi, bb, atr, macd fast/slow/signal
REGIME_WINDOWS = {
    0.70: (10, 14, 10, 8, 18, 6),
    1.00: (14, 20, 14, 12, 26, 9),
    1.35: (19, 27, 19, 16, 35, 12),
}

# Forecasting
HORIZON = 5
FIT_WINDOW = 30
CONFIDENCE_Z = 1.96

# Signals
BREAKOUT_Z = 1.5
VOL_SPIKE_RATIO = 1.5
SENT_DIVERGE_MIN = 0.1
SENT_DIVERGE_PRICE = 0.5
UNUSUAL_Z = 2.0
OPPORTUNITY_TOP = 10
SENTIMENT_SCALE = 20.0
BASELINE_VOL_DEFAULT = 1.0

# Anomalies
PRICE_GAP_Z = 2.5
VOL_REGIME_Z = 2.0
BREADTH_Z = 2.0
CLUSTER_SHARE = 0.30
CLUSTER_MOVE = 2.0
SENT_VOL_CORR = -0.5
SEVERITY_CRITICAL = 3.5
SEVERITY_HIGH = 3.0
MIN_BASELINE = 20

# Statistics
ALPHA = 0.05
PCT_DISCREPANCY = 0.1

# Feature selection
CORR_CUTOFF = 0.92
MIN_VARIANCE = 1e-5
MI_BINS = 10

# Narrative
VOL_PHRASE_Z = (2.5, 1.5, 0.5, -0.5, -1.5)
MOMENTUM_PHRASE = (3.0, 1.0, 0.0, -1.0, -3.0)
