"""Registered queries against their SQL twins on the smallest tables.

The default run covers one query per operator family; TICKLOOM_FULL=1 runs them all.
"""

import os

import pytest

from tickloom.plans.catalogue import QUERIES, SQL
from tools.check import compare, connect

FAMILIES = """
daily_breadth rolling_intelligence_daily frequent_movers cumulative_performance streaks market_cycles ma_crossover
breadth_trend sma_ema symbol_indicators bollinger drawdown clean_bars outlier_flag gap_fill normalise_robust
feature_set cross_asset_wide session_breadth spearman_matrix mann_whitney tier_box top_movers all_signals risk_scores
all_anomalies forecast_linear forecast_ema quotes_from_json rows_from_html headline_sentiment enrich_sentiment_asof
extended_hist dq_prices dq_bars holidays last_trading_day daily_briefing stream_bars incremental_refresh
mutual_information variance_filter correlation_filter select_features pct_discrepancy indicators_refresh anomaly_log signal_log
stream_late_days stream_ema symbol_json_export source_failures any_to_date top_volume_no_trades
stream_daily_moments stream_dedup_exact stored_prices model_headline_scores news_listing pct_discrepancy_from_open historical_views
""".split()
NAMES = sorted(SQL) if os.environ.get("TICKLOOM_FULL") else FAMILIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 140


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, sf, con):
    msg, rows, _ = compare(QUERIES[name](spark, sf), con, SQL[name])
    assert msg == ""
