"""Queries of the library and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from residua.operators import backtest, evaluation, factors, grouped, neural, panel, portfolio, retrieval, signals, trading  # noqa: F401  each registers its steps
from residua.plans.relations import STEPS, relation, render

#: Steps that are queries in their own right; the others are what these are made of.
RELATIONAL = (
    "panel_build pit_membership prior_trading_day benchmark_weights panel_audit member_changes returns_close returns_open forward_returns pct_change limit_prices tradable_flags adjusted_index "
    "fill_limited dedupe_keep_last coerce_strings residuals_k0 ou_fit ou_positions ou_epsilon threshold_backtest threshold_summary rank_alpha buffered_alpha state_share alpha_change fourier_features cumulative_windows "
    "rank_ic_days rank_ic_by_horizon signal_coverage lag_autocorrelation reversal_ic reversal_periods predictability_gates predictability_audit mechanism_eval version_asof versions_per_window continuity_audit "
    "jaccard_refit ou_backtest ou_cost_ladder drawdown rolling_sharpe rolling_excess_share performance_metrics period_metrics admission_decision turnover_summary stability_summary "
    "run_correlations shrunk_covariance residual_array_audit training_origins fee_schedule round_trip_cost lot_rounding blocked_reason weight_execution trade_costs pair_series pair_signal "
    "pair_backtest pair_cost_ladder pair_period_stability tfidf_terms tfidf_norms tfidf_search evidence_collect rule_spec evidence_spec embedding_topk active_foundations invalid_methods hypothesis_ledger "
    "protocol_audit hypothesis_states diagnostic_verdict direction_tool tool_plan result_interpretation event_props"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, n=name: relation(spark, sf_dir, n)) for name in RELATIONAL} | grouped.QUERIES | factors.QUERIES | backtest.QUERIES | neural.QUERIES | portfolio.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: render(name) for name in RELATIONAL}


def unknown() -> list[str]:
    return [n for n in RELATIONAL if n not in STEPS]
