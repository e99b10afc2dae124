"""Information coefficients, audits, simulated mechanisms, period metrics, gates."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.plans.relations import MADE, STEPS, lean, step

step("ic_pairs", """SELECT h, t, symbol, a, f, rank() OVER (PARTITION BY h, t ORDER BY a) + (count(*) OVER (PARTITION BY h, t, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY h, t ORDER BY f) + (count(*) OVER (PARTITION BY h, t, f) - 1) / 2.0 AS rf FROM
  (SELECT w.h, w.t, w.symbol, round(k.alpha, 12) AS a, round(w.fwd, 12) AS f FROM forward w JOIN alpha k ON k.t = w.t AND k.symbol = w.symbol WHERE w.member AND w.fwd IS NOT NULL) x""")
step("ic_days", "SELECT h, t, corr(ra, rf) AS ic, count(*) AS n FROM (SELECT *, max(a) OVER (PARTITION BY h, t) - min(a) OVER (PARTITION BY h, t) AS spread_a, max(f) OVER (PARTITION BY h, t) - min(f) OVER (PARTITION BY h, t) AS spread_f FROM ic_pairs) x WHERE spread_a > 2.220446049250313e-16 AND spread_f > 2.220446049250313e-16 GROUP BY h, t HAVING count(*) >= 20")
step("rank_ic_days", "SELECT h, t, round(ic, 6) AS ic, n FROM ic_days")
step("rank_ic_by_horizon", """SELECT h, count(*) AS days, round(avg(ic), 6) AS mean_ic, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ic), 6) AS median_ic, round(stddev_pop(ic), 6) AS std_ic,
  round(coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0) * sqrt(PER_YEAR), 5) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS positive_share, round(avg(n), 6) AS mean_n FROM ic_days GROUP BY h""")
step("signal_coverage", """SELECT count(*) AS days, round(avg(m), 6) AS member_rate, round(avg(f), 6) AS finite_rate, round(avg(nz), 6) AS nonzero_rate, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0 END), 6) AS days_with_signal, round(avg(ma), 6) AS mean_abs_alpha FROM
  (SELECT s.t, avg(CASE WHEN s.member THEN 1.0 ELSE 0 END) AS m, avg(CASE WHEN s.member THEN CASE WHEN a.alpha IS NOT NULL THEN 1.0 ELSE 0 END END) AS f, avg(CASE WHEN s.member THEN CASE WHEN abs(a.alpha) > 1e-9 THEN 1.0 ELSE 0 END END) AS nz, avg(abs(a.alpha)) AS ma
   FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol GROUP BY s.t) x""")

_LAGS = (1, 5, 10, 20)
_SIDES = ", ".join(f"lag(r, {h}) OVER w AS r{h}, lag(member, {h}) OVER w AS m{h}" for h in _LAGS)
step("lagged", f"SELECT symbol, r, member, {_SIDES} FROM resid WINDOW w AS (PARTITION BY symbol ORDER BY t)")
_PAIRS = ", ".join(f"corr(CASE WHEN member AND m{h} THEN r END, CASE WHEN member AND m{h} THEN r{h} END) AS ac{h}, count(CASE WHEN member AND m{h} AND r IS NOT NULL AND r{h} IS NOT NULL THEN 1 END) AS n{h}" for h in _LAGS)
_BY_LAG = ", ".join(f"CASE l.lagn {' '.join(f'WHEN {h} THEN {c}{h}' for h in _LAGS)} END AS {c}" for c in ("ac", "n"))
step("horizons", " UNION ALL ".join(f"SELECT {h} AS lagn" for h in _LAGS))
step("auto", f"SELECT symbol, lagn, ac, n FROM (SELECT symbol, l.lagn, {_BY_LAG} FROM (SELECT symbol, {_PAIRS} FROM lagged GROUP BY symbol) x CROSS JOIN horizons l) y WHERE n >= 30")
step("lag_autocorrelation", "SELECT lagn, count(*) AS assets, round(avg(ac), 6) AS mean_ac, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ac), 6) AS median_ac, round(avg(CASE WHEN ac < 0 THEN 1.0 ELSE 0 END), 6) AS negative_share FROM auto GROUP BY lagn")
_SUMS = ", ".join(f"sum(r) OVER p{h} AS past{h}, count(r) OVER p{h} AS np{h}, sum(r) OVER n{h} AS fut{h}, count(r) OVER n{h} AS nf{h}" for h in _LAGS)
_FRAMES = ", ".join(f"p{h} AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW), n{h} AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in _LAGS)
step("reversal_sums", f"SELECT t, symbol, member, {_SUMS} FROM resid WINDOW {_FRAMES}")
_BY_H = ", ".join(f"CASE l.lagn {' '.join(f'WHEN {h} THEN CASE WHEN np{h} = {h} AND nf{h} = {h} THEN {c}{h} END' for h in _LAGS)} END AS {c}" for c in ("past", "fut"))
step("reversal_pairs", f"""SELECT h, t, symbol, -past AS s, fut AS f, row_number() OVER (PARTITION BY h, t ORDER BY round(-past, 12), symbol) - 1 AS rs, row_number() OVER (PARTITION BY h, t ORDER BY round(fut, 12), symbol) - 1 AS rf
  FROM (SELECT l.lagn AS h, t, symbol, {_BY_H} FROM reversal_sums CROSS JOIN horizons l WHERE member) x WHERE past IS NOT NULL""")
step("reversal_days", "SELECT h, t, corr(rs, rf) AS ic, count(*) AS n FROM reversal_pairs GROUP BY h, t HAVING count(*) >= 20")
step("reversal_ic", "SELECT h, t, round(coalesce(ic, 0), 6) AS ic, n FROM reversal_days")
step("periods", "SELECT 'overall' AS period, DATE '1995-01-01' AS d0, DATE '2099-12-31' AS d1 UNION ALL SELECT 'development', DATE '1995-01-01', DATE '1999-03-31' UNION ALL SELECT 'validation', DATE '1999-04-01', DATE '2099-12-31'")
step("reversal_stats", "SELECT p.period, d.h, count(*) AS days, avg(coalesce(d.ic, 0)) AS mean_ic, percentile_cont(0.5) WITHIN GROUP (ORDER BY coalesce(d.ic, 0)) AS median_ic, avg(CASE WHEN d.ic > 0 THEN 1.0 ELSE 0 END) AS positive_share FROM reversal_days d JOIN calendar c ON c.t = d.t JOIN periods p ON c.d BETWEEN p.d0 AND p.d1 GROUP BY p.period, d.h")
step("reversal_pooled", "SELECT p.period, d.h, corr(d.s, d.f) AS pooled FROM reversal_pairs d JOIN calendar c ON c.t = d.t JOIN periods p ON c.d BETWEEN p.d0 AND p.d1 GROUP BY p.period, d.h")
step("reversal_periods", "SELECT s.period, s.h, s.days, round(s.mean_ic, 6) AS mean_ic, round(s.median_ic, 6) AS median_ic, round(s.positive_share, 6) AS positive_share, round(coalesce(p.pooled, 0), 6) AS pooled FROM reversal_stats s JOIN reversal_pooled p ON p.period = s.period AND p.h = s.h")
step("predictability_gates", """SELECT h, CAST(min(cross_sectional) AS INT) AS cross_sectional, CAST(min(CASE WHEN cross_sectional = 1 AND pooled > 0 THEN 1 ELSE 0 END) AS INT) AS stable FROM
  (SELECT s.period, s.h, p.pooled, CASE WHEN s.days >= 60 AND s.mean_ic >= 0.015 AND s.positive_share >= 0.5 THEN 1 ELSE 0 END AS cross_sectional
   FROM reversal_stats s JOIN reversal_pooled p ON p.period = s.period AND p.h = s.h WHERE s.period <> 'overall') x GROUP BY h HAVING count(*) = 2""")
step("predictability_audit", "SELECT count(*) AS horizons, CAST(sum(cross_sectional) AS BIGINT) AS cross_sectional_horizons, CAST(sum(stable) AS BIGINT) AS stable_horizons, sum(cross_sectional) >= 2 AS cross_sectional_evidence, sum(stable) >= 2 AS broad_evidence FROM predictability_gates")

step("mechanism", "SELECT t, symbol, dir, pos * dir / nullif(sum(abs(pos)) OVER (PARTITION BY t, dir), 0) AS w, nxt FROM (SELECT t, symbol, CASE WHEN t < (SELECT max(t) FROM calendar) THEN pos ELSE 0 END AS pos, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS nxt FROM ou_pos) x CROSS JOIN (SELECT 1 AS dir UNION ALL SELECT -1) ds")
step("mechanism_lag", "SELECT t, symbol, dir, coalesce(w, 0) AS w, coalesce(nxt, 0) AS nxt, lag(coalesce(w, 0), 1, 0) OVER (PARTITION BY symbol, dir ORDER BY t) AS pw FROM mechanism")
step("mechanism_days", "SELECT dir, t, sum(w * nxt) AS ret, sum(abs(w - pw)) AS turnover, max(CASE WHEN w <> 0 THEN 1.0 ELSE 0 END) AS active FROM mechanism_lag WHERE t >= 133 AND t < (SELECT max(t) FROM calendar) GROUP BY dir, t")
step("mechanism_eval", "SELECT dir, count(*) AS days, round(avg(ret) * PER_YEAR, 6) AS annual_mean, round(coalesce(avg(ret) / nullif(stddev_pop(ret), 0), 0) * sqrt(PER_YEAR), 5) AS sharpe, round(avg(turnover), 6) AS turnover, round(avg(active), 6) AS active_rate FROM mechanism_days GROUP BY dir")

step("refits", "SELECT t, row_number() OVER (ORDER BY t) - 1 AS version FROM (SELECT DISTINCT refit_t AS t FROM mapped) x")
step("versions", "SELECT c.t, count(r.t) OVER (ORDER BY c.t) - 1 AS version, CASE WHEN r.t IS NOT NULL THEN 1 ELSE 0 END AS is_refit FROM calendar c LEFT JOIN refits r ON r.t = c.t")
step("version_asof", "SELECT t, version, is_refit FROM versions")
step("versions_per_window", "SELECT t, v1 - greatest(v0, 0) + 1 AS versions FROM (SELECT t, max(version) OVER (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v1, min(version) OVER (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v0, t AS tt FROM versions) x WHERE tt >= 29 AND v1 >= 0")
# The continuity audit counts dates: each of its parts is one row
step("fitted_days", "SELECT t, count(*) AS active FROM residual GROUP BY t")
step("continuity_base", """SELECT CAST(min(c.d) AS STRING) AS start_date, CAST(max(c.d) AS STRING) AS end_date, count(*) AS calendar_days, count(m.t) AS model_days, count(*) - count(m.t) AS days_without_model,
  round(count(m.t) / (1.0 * count(*)), 6) AS model_day_rate, CAST(sum(v.is_refit) AS BIGINT) AS refits FROM calendar c JOIN versions v ON v.t = c.t LEFT JOIN fitted_days m ON m.t = c.t WHERE v.version >= 0""")
step("coverage_days", "SELECT g.t, m.active, sum(CASE WHEN g.member THEN 1.0 ELSE 0 END) AS members, sum(CASE WHEN g.member AND g.r IS NOT NULL THEN 1.0 ELSE 0 END) AS covered FROM resid g JOIN fitted_days m ON m.t = g.t GROUP BY g.t, m.active")
step("continuity_coverage", """SELECT round(sum(covered) / nullif(sum(members), 0), 6) AS member_coverage, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY covered / nullif(members, 0)), 6) AS median_coverage, round(min(covered / nullif(members, 0)), 6) AS minimum_coverage,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY active), 6) AS median_active, min(active) AS minimum_active FROM coverage_days""")
step("continuity_windows", """SELECT count(*) AS ou_windows, round(coalesce(avg(CASE WHEN v.versions = 1 THEN 1.0 ELSE 0 END), 0), 6) AS single_model_rate, round(coalesce(avg(CASE WHEN v.versions > 1 THEN 1.0 ELSE 0 END), 0), 6) AS cross_model_rate, round(coalesce(avg(v.versions), 0), 6) AS models_per_window, CAST(coalesce(max(v.versions), 0) AS BIGINT) AS most_models
  FROM versions_per_window v JOIN (SELECT DISTINCT t FROM ou WHERE nv = 30 AND member) o ON o.t = v.t""")
step("jaccard_days", """SELECT x.t, sum(CASE WHEN now AND before THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN now OR before THEN 1.0 ELSE 0 END), 0) AS jaccard FROM (SELECT t, member AND r IS NOT NULL AS now, coalesce(lag(member AND r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t), false) AS before FROM resid) x JOIN refits f ON f.t = x.t WHERE f.version > 0 GROUP BY x.t""")
step("continuity_jaccard", "SELECT round(coalesce(percentile_cont(0.5) WITHIN GROUP (ORDER BY jaccard), 0), 6) AS median_jaccard FROM jaccard_days")
step("alpha_moves", "SELECT t, avg(abs(alpha - prev)) AS moved, count(*) AS shared FROM (SELECT t, alpha, lag(alpha) OVER (PARTITION BY symbol ORDER BY t) AS prev, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS pt FROM alpha) x WHERE pt = t - 1 GROUP BY t")
step("scale_days", "SELECT m.t, v.is_refit, avg(CASE WHEN g.member THEN abs(g.r) END) AS scale, max(a.moved) AS moved FROM fitted_days m JOIN versions v ON v.t = m.t JOIN resid g ON g.t = m.t LEFT JOIN alpha_moves a ON a.t = m.t GROUP BY m.t, v.is_refit")
step("continuity_scale", "SELECT round(avg(CASE WHEN is_refit = 1 THEN scale END), 9) AS residual_refit, round(avg(CASE WHEN is_refit = 0 THEN scale END), 9) AS residual_other, round(avg(CASE WHEN is_refit = 1 THEN moved END), 6) AS alpha_refit, round(avg(CASE WHEN is_refit = 0 THEN moved END), 6) AS alpha_other FROM scale_days")
step("continuity_audit", "SELECT b.*, c.*, w.*, j.*, s.*, round(s.residual_refit / nullif(s.residual_other, 0), 6) AS residual_ratio, round(s.alpha_refit / nullif(s.alpha_other, 0), 6) AS alpha_ratio FROM continuity_base b CROSS JOIN continuity_coverage c CROSS JOIN continuity_windows w CROSS JOIN continuity_jaccard j CROSS JOIN continuity_scale s")
step("jaccard_refit", "SELECT t, round(jaccard, 6) AS jaccard FROM jaccard_days")

step("bt", """SELECT t, symbol, lagpos / nullif(sum(abs(lagpos)) OVER (PARTITION BY t), 0) AS w, r FROM (SELECT t, symbol, r, CASE WHEN r IS NULL THEN 0 ELSE lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY t) END AS lagpos FROM ou_pos) x""")
step("bt_lag", "SELECT t, symbol, coalesce(w, 0) AS w, coalesce(r, 0) AS r, lag(coalesce(w, 0), 1, 0) OVER (PARTITION BY symbol ORDER BY t) AS pw FROM bt")
step("bt_days", "SELECT t, sum(w * r) AS gross, sum(abs(w - pw)) AS turnover, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short_share FROM bt_lag WHERE t >= 134 GROUP BY t")
step("ou_backtest", "SELECT t, round(gross, 9) AS gross, round(turnover, 9) AS turnover, round(short_share, 9) AS short_share, round(gross - 0.0005 * turnover - 0.0001 * short_share, 9) AS net FROM bt_days")
step("ou_cost_ladder", "SELECT bp, count(*) AS days, round(avg(gross - bp / 10000.0 * turnover) * PER_YEAR, 6) AS annual_mean, round(coalesce(avg(gross - bp / 10000.0 * turnover) / nullif(stddev_pop(gross - bp / 10000.0 * turnover), 0), 0) * sqrt(PER_YEAR), 5) AS sharpe FROM bt_days CROSS JOIN (SELECT 0 AS bp UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20) c GROUP BY bp")

# A long-only book of the positive scores; a year is 52 rows of the weekly calendar. A period that loses all has no logarithm:
# its wealth stays where it was, and performance_metrics refuses the series
step("long_weights", "SELECT s.t, s.symbol, coalesce(greatest(a.alpha, 0) / nullif(sum(greatest(a.alpha, 0)) OVER (PARTITION BY s.t), 0), 0) AS w FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol")
step("long_lag", "SELECT *, lag(w, 1, 0) OVER (PARTITION BY symbol ORDER BY t) AS pw FROM long_weights")
step("pnl", """SELECT x.t, x.gross, x.turnover, b.bench FROM
  (SELECT w.t, sum(w.w * r.fwd) AS gross, sum(abs(w.w - w.pw)) AS turnover FROM long_lag w JOIN forward r ON r.t = w.t AND r.symbol = w.symbol AND r.h = 1 WHERE r.fwd IS NOT NULL GROUP BY w.t) x
  JOIN (SELECT p.t, sum(p.benchmark_weight * f.fwd) AS bench FROM panel p JOIN forward f ON f.t = p.t AND f.symbol = p.symbol AND f.h = 1 WHERE f.fwd IS NOT NULL GROUP BY p.t) b ON b.t = x.t WHERE x.t >= 108""")
step("scaled", "SELECT t, gross, gross - 0.00126 * turnover AS strategy, bench, 0.00126 * turnover AS cost FROM pnl")
step("wealth", "SELECT t, strategy, bench, exp(sum(CASE WHEN strategy > -1 THEN ln(1 + strategy) END) OVER (ORDER BY t)) AS wealth FROM scaled")
step("peaks", "SELECT *, max(wealth) OVER (ORDER BY t) AS peak FROM wealth")
step("drawdown", "SELECT t, round(wealth, 6) AS wealth, round(wealth / peak - 1, 6) AS drawdown_first, round(1 - wealth / greatest(1, peak), 6) AS drawdown_one FROM peaks")
step("rolling_sharpe", "SELECT t, CASE WHEN n = 52 THEN round(coalesce(m / nullif(s, 0), 0) * sqrt(PER_YEAR), 5) END AS sharpe FROM (SELECT t, avg(strategy) OVER w AS m, stddev_pop(strategy) OVER w AS s, count(*) OVER w AS n FROM scaled WINDOW w AS (ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) x")
step("rolling_excess_share", "SELECT count(*) AS windows, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END), 6) AS positive_share FROM (SELECT sum(CASE WHEN strategy > -1 THEN ln(1 + strategy) END - CASE WHEN bench > -1 THEN ln(1 + bench) END) OVER w AS e, count(*) OVER w AS n FROM scaled WINDOW w AS (ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) x WHERE n = 52")
step("performance_sums", """SELECT count(*) AS days, count(*) = count(CASE WHEN strategy > -1 AND strategy < 1e300 THEN 1 END) AS accepted, avg(strategy) AS m, stddev_pop(strategy) AS s, stddev_samp(strategy) AS sample, sum(CASE WHEN strategy > -1 THEN ln(1 + strategy) END) AS growth,
  min(wealth / peak - 1) AS max_drawdown, avg(CASE WHEN strategy > 0 THEN 1.0 ELSE 0 END) AS positive_days, sum(strategy) AS total FROM peaks""")
_FIGURES = {"annual_mean": "round(m * PER_YEAR, 6)", "annual_vol": "round(s * sqrt(PER_YEAR), 6)", "sharpe": "round(coalesce(m / nullif(s, 0), 0) * sqrt(PER_YEAR), 5)", "cumulative": "round(exp(growth) - 1, 6)", "max_drawdown": "round(max_drawdown, 6)", "positive_days": "round(positive_days, 6)", "total": "round(total, 6)", "geometric_annual": "round(power(exp(growth), 1.0 * PER_YEAR / days) - 1, 5)", "sample_vol": "round(sample * sqrt(PER_YEAR), 6)"}
step("performance_metrics", "SELECT days, accepted, " + ", ".join(f"CASE WHEN accepted THEN {v} END AS {k}" for k, v in _FIGURES.items()) + " FROM performance_sums")
step("period_days", "SELECT p.period, s.*, s.strategy - s.bench AS active FROM scaled s JOIN calendar c ON c.t = s.t JOIN periods p ON c.d BETWEEN p.d0 AND p.d1")
step("period_wealth", """SELECT *, exp(sum(CASE WHEN active > -1 THEN ln(1 + active) END) OVER w) AS wealth, CASE WHEN count(*) OVER y = 52 THEN sum(CASE WHEN strategy > -1 THEN ln(1 + strategy) END - CASE WHEN bench > -1 THEN ln(1 + bench) END) OVER y END AS roll FROM period_days
  WINDOW w AS (PARTITION BY period ORDER BY t), y AS (PARTITION BY period ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)""")
step("period_peaks", "SELECT *, max(wealth) OVER (PARTITION BY period ORDER BY t) AS peak FROM period_wealth")
step("period_table", """SELECT period, count(*) AS observations, avg(bench) * PER_YEAR AS benchmark, avg(gross) * PER_YEAR AS gross_strategy, avg(strategy) * PER_YEAR AS net_strategy, avg(gross - bench) * PER_YEAR AS gross_excess, avg(active) * PER_YEAR AS net_excess,
  coalesce(avg(gross - bench) / nullif(stddev_pop(gross - bench), 0), 0) * sqrt(PER_YEAR) AS gross_ir, coalesce(avg(active) / nullif(stddev_pop(active), 0), 0) * sqrt(PER_YEAR) AS net_ir, avg(cost) * PER_YEAR AS cost_drag,
  CASE WHEN avg(gross - bench) > 0 THEN avg(cost) / avg(gross - bench) END AS cost_share, min(wealth / peak - 1) AS drawdown, avg(CASE WHEN roll > 0 THEN 1.0 WHEN roll IS NOT NULL THEN 0 END) AS rolling_share FROM period_peaks GROUP BY period""")
step("period_metrics", "SELECT period, observations, round(benchmark, 5) AS benchmark, round(gross_strategy, 5) AS gross_strategy, round(net_strategy, 5) AS net_strategy, round(gross_excess, 5) AS gross_excess, round(net_excess, 5) AS net_excess, round(gross_ir, 5) AS gross_ir, round(net_ir, 5) AS net_ir, round(cost_drag, 5) AS cost_drag, round(cost_share, 5) AS cost_share, round(drawdown, 5) AS drawdown, round(rolling_share, 5) AS rolling_share FROM period_table")
step("gate_rows", """SELECT period, 'gross excess' AS gate, gross_excess > 0 AS passed FROM period_table WHERE period <> 'overall' UNION ALL SELECT period, 'net excess', net_excess > 0 FROM period_table WHERE period <> 'overall'
  UNION ALL SELECT period, 'net IR', net_ir >= 1 FROM period_table WHERE period <> 'overall' UNION ALL SELECT period, 'active drawdown', drawdown >= -0.12 FROM period_table WHERE period = 'overall'
  UNION ALL SELECT period, 'cost share', coalesce(cost_share <= 0.5, false) FROM period_table WHERE period = 'overall' UNION ALL SELECT period, 'rolling share', coalesce(rolling_share >= 0.6, false) FROM period_table WHERE period = 'overall'""")
step("admission_decision", "SELECT min(CASE WHEN passed THEN 1 ELSE 0 END) = 1 AS admitted, coalesce(<<join CASE WHEN NOT passed THEN period || ':' || gate END>>, '') AS failed_gates, CASE WHEN min(CASE WHEN passed THEN 1 ELSE 0 END) = 1 THEN 'run_holdout_once' ELSE 'keep_holdout_sealed' END AS holdout_action FROM gate_rows")
step("turnover_summary", "SELECT count(*) AS days, CAST(sum(CASE WHEN turnover > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS trade_days, round(avg(turnover), 6) AS mean_turnover, round(avg(turnover) * PER_YEAR, 5) AS annual_turnover, round(avg(CASE WHEN turnover > 1e-12 THEN turnover END), 6) AS mean_on_trade_days, round(max(turnover), 6) AS max_turnover FROM bt_days")

# Blocks of 25 rows stand for test windows; the score in training is the Sharpe ratio of the 100 rows before, from their moments
step("block_sums", "SELECT <<div t ;; 25>> AS origin, avg(gross) * PER_YEAR AS mean_ret, coalesce(avg(gross) / nullif(stddev_pop(gross), 0), 0) * sqrt(PER_YEAR) AS sharpe, sum(gross) AS contribution, sum(gross * gross) AS squares, count(*) AS days FROM bt_days GROUP BY <<div t ;; 25>>")
step("block_before", "SELECT *, sum(contribution) OVER w AS s1, sum(squares) OVER w AS s2, sum(days) OVER w AS nd, count(*) OVER w AS nb, row_number() OVER (ORDER BY origin) AS pos, count(*) OVER () AS n FROM block_sums WINDOW w AS (ORDER BY origin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
step("blocks", "SELECT *, CASE WHEN nb = 4 AND s2 / nd - (s1 / nd) * (s1 / nd) > 1e-18 THEN s1 / nd / sqrt(s2 / nd - (s1 / nd) * (s1 / nd)) END AS train_score FROM block_before")
step("block_ranks", "SELECT *, row_number() OVER (ORDER BY contribution DESC, origin) AS rk FROM blocks")
step("stability_summary", """SELECT count(*) AS windows, round(avg(sharpe), 5) AS mean_sharpe, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY sharpe), 5) AS q25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY sharpe), 5) AS q50, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY sharpe), 5) AS q75,
  round(avg(CASE WHEN pos <= floor((n + 1) / 2) THEN sharpe END), 5) AS early, round(avg(CASE WHEN pos > floor((n + 1) / 2) THEN sharpe END), 5) AS late, round(sum(CASE WHEN rk <= 3 THEN contribution ELSE 0 END) / nullif(sum(contribution), 0), 4) AS top3_share, round(sum(CASE WHEN rk <= 5 THEN contribution ELSE 0 END) / nullif(sum(contribution), 0), 4) AS top5_share,
  CAST(max_by(origin, sharpe) AS BIGINT) AS best_origin, CAST(min_by(origin, sharpe) AS BIGINT) AS worst_origin, round(corr(CASE WHEN train_score IS NOT NULL THEN sharpe END, train_score), 5) AS score_corr FROM block_ranks""")
step("model_days", "SELECT 'ou' AS model, t, gross AS r FROM bt_days UNION ALL SELECT 'rank', t, strategy FROM scaled UNION ALL SELECT 'mechanism', t, ret FROM mechanism_days WHERE dir = 1")
step("run_correlations", "SELECT a.model AS model_a, b.model AS model_b, count(*) AS days, round(corr(a.r, b.r), 6) AS correlation FROM model_days a JOIN model_days b ON a.t = b.t AND a.model < b.model GROUP BY a.model, b.model")
# Ranges of t meet by bins as long as the range, so each date meets two of them by an equality; the exact bounds come after
_BINS = "CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks"
step("covariance_dates", "SELECT mi, min(t) AS on_t FROM calendar WHERE t >= 104 GROUP BY mi")
step("covariance_bins", f"SELECT on_t, <<div on_t - 104 ;; 104>> + k AS bin FROM covariance_dates {_BINS}")
step("covariance_rows", """SELECT on_t, symbol, t, coalesce(ret, avg(ret) OVER (PARTITION BY on_t, symbol), 0) AS ret FROM
  (SELECT c.on_t, r.symbol, r.t, r.ret FROM covariance_bins c JOIN rets2 r ON <<div r.t ;; 104>> = c.bin WHERE r.t >= c.on_t - 104 AND r.t < c.on_t) x""")
# every pair of names there is: rows grow with the square of the names
step("shrunk_covariance", """SELECT a.on_t, a.symbol AS symbol_a, b.symbol AS symbol_b, round(CASE WHEN a.symbol = b.symbol THEN covar_pop(a.ret, b.ret) + 1e-8 ELSE 0.5 * covar_pop(a.ret, b.ret) END, 9) AS cov
  FROM covariance_rows a JOIN covariance_rows b ON a.on_t = b.on_t AND a.t = b.t AND a.symbol <= b.symbol GROUP BY a.on_t, a.symbol, b.symbol""")
step("residual_array_audit", "SELECT count(*) AS cells, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS finite_share, round(avg(CASE WHEN r IS NOT NULL THEN CASE WHEN r = 0 THEN 1.0 ELSE 0 END END), 6) AS zero_share, round(stddev_pop(CASE WHEN r <> 0 THEN r END), 9) AS std_nonzero FROM resid")
step("origins", "SELECT t AS origin FROM calendar WHERE t >= 140 AND (t - 140) % 25 = 0")
step("origin_bins", f"SELECT origin, <<div origin - 100 ;; 100>> + k AS bin FROM origins {_BINS}")
step("training_origins", "SELECT o.origin, r.symbol, count(*) AS usable FROM origin_bins o JOIN resid r ON <<div r.t ;; 100>> = o.bin WHERE r.t >= o.origin - 100 AND r.t < o.origin AND r.r <> 0 GROUP BY o.origin, r.symbol HAVING count(*) >= 30")

# The direction of the signal: books of the positive scores, of the negative ones, and of all members alike. a
# rank IC of 0.015, costs five times the neutral book's, ratios of 1.5 at refits, a Sharpe ratio of a half.
step("books", """SELECT t, symbol, who, coalesce(v / nullif(sum(v) OVER (PARTITION BY t, who), 0), 0) AS w FROM (SELECT s.t, s.symbol, b.who, CASE b.who WHEN 'original' THEN greatest(coalesce(a.alpha, 0), 0) WHEN 'reversed' THEN greatest(-coalesce(a.alpha, 0), 0) WHEN 'neutral' THEN CASE WHEN s.member THEN 1 ELSE 0 END END AS v
  FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol CROSS JOIN (SELECT 'original' AS who UNION ALL SELECT 'reversed' UNION ALL SELECT 'neutral') b) x""")
step("book_moves", "SELECT t, symbol, who, w, abs(w - lag(w, 1, 0) OVER (PARTITION BY symbol, who ORDER BY t)) AS moved FROM books")
step("book_days", "SELECT b.t, b.who, sum(b.w * r.fwd) AS gross, sum(b.moved) AS turnover FROM book_moves b JOIN forward r ON r.t = b.t AND r.symbol = b.symbol AND r.h = 1 WHERE r.fwd IS NOT NULL AND b.t >= 108 GROUP BY b.t, b.who")
step("book_facts", "SELECT b.who, avg(b.gross - p.bench) * PER_YEAR AS excess, avg(0.00126 * b.turnover) * PER_YEAR AS cost FROM book_days b JOIN pnl p ON p.t = b.t GROUP BY b.who")
step("direction_facts", "SELECT " + ", ".join(f"max(CASE WHEN who = '{w}' THEN {c} END) AS {w}_{n}" for c, n in (("excess", "gross_excess"), ("cost", "cost_drag")) for w in ("original", "reversed", "neutral")) + " FROM book_facts")
step("ic_means", "SELECT " + ", ".join(f"avg(CASE WHEN h = {h} THEN ic END) AS rank_ic_{h}" for h in _LAGS) + " FROM ic_days")
step("direction_tool", "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in [*(f"rank_ic_{h}" for h in _LAGS), "original_gross_excess", "reversed_gross_excess", "neutral_gross_excess", "original_cost_drag", "neutral_cost_drag", "nonzero_rate"]) + """,
  reversed_gross_excess > neutral_gross_excess AS simple_sign_flip_supported, greatest(rank_ic_1, rank_ic_5, rank_ic_10, rank_ic_20) >= 0.015 AS rank_ic_gate_passed, original_cost_drag > 5 * neutral_cost_drag AS cost_problem_is_signal_induced
  FROM direction_facts CROSS JOIN ic_means CROSS JOIN (SELECT nonzero_rate FROM signal_coverage) c""")

# With no factors a residual is the return under every map, so both definitions of a history agree; comparison_summary gives
# the same two figures where there are factors
step("comparison", "SELECT sharpe AS stitched_sharpe, sharpe AS current_sharpe FROM mechanism_eval WHERE dir = 1")
step("evidence", """SELECT d.simple_sign_flip_supported AS sign_flip, d.cost_problem_is_signal_induced AS costly, m.sharpe AS mechanism_sharpe, m.annual_mean AS mechanism_mean, r.annual_mean AS reversed_mean,
  coalesce(a.residual_ratio >= 1.5, false) OR coalesce(a.alpha_ratio >= 1.5, false) AS refit_spike, a.ou_windows > 0 AND a.cross_model_rate = 1 AS all_cross, c.current_sharpe >= 0.5 AS current_gate, c.current_sharpe >= 0.5 AND c.current_sharpe > c.stitched_sharpe AS rescued,
  coalesce(p.cross_sectional_evidence, false) AS cross_sectional, coalesce(p.broad_evidence, false) AS broad
  FROM direction_tool d CROSS JOIN (SELECT * FROM mechanism_eval WHERE dir = 1) m CROSS JOIN (SELECT * FROM mechanism_eval WHERE dir = -1) r CROSS JOIN continuity_audit a CROSS JOIN comparison c CROSS JOIN predictability_audit p""")
step("judged", "SELECT *, CASE WHEN mechanism_sharpe >= 0.5 OR rescued THEN 'supported' WHEN reversed_mean > mechanism_mean THEN 'rejected' WHEN NOT current_gate THEN 'not_supported_in_current_pilot' ELSE 'inconclusive' END AS h2 FROM evidence")
step("hypothesis_states", """SELECT i.id, CASE i.id WHEN 'H1' THEN CASE WHEN sign_flip THEN 'supported' ELSE 'rejected' END WHEN 'H3' THEN CASE WHEN costly THEN 'supported' ELSE 'unresolved' END ELSE 'unresolved' END AS status_before,
  CASE i.id WHEN 'H2' THEN h2 WHEN 'H4' THEN CASE WHEN refit_spike THEN 'supported' WHEN all_cross THEN 'structural_confounder_not_confirmed_causal' ELSE 'rejected' END WHEN 'H5' THEN CASE WHEN rescued THEN 'supported' ELSE 'rejected' END
   WHEN 'H6' THEN CASE WHEN cross_sectional THEN 'supported' ELSE 'rejected' END WHEN 'H7' THEN CASE WHEN broad THEN 'supported' ELSE 'rejected' END END AS status_after
  FROM judged CROSS JOIN (SELECT 'H1' AS id UNION ALL SELECT 'H2' UNION ALL SELECT 'H3' UNION ALL SELECT 'H4' UNION ALL SELECT 'H5' UNION ALL SELECT 'H6' UNION ALL SELECT 'H7') i""")
# what later evidence says comes first: broad or narrow predictability, then the mechanism
step("diagnostic_verdict", """SELECT CASE WHEN cross_sectional AND NOT broad THEN 'narrow_ranking_effect' WHEN broad THEN 'broad_reversal' WHEN h2 = 'not_supported_in_current_pilot' THEN 'no_stable_predictability' WHEN rescued THEN 'current_composition_rescues'
   WHEN h2 = 'supported' THEN 'mechanism_supported' WHEN h2 = 'rejected' THEN 'reversal_performs_better' ELSE 'inconclusive' END AS verdict,
  CASE WHEN cross_sectional AND NOT broad THEN 'preregister_rank_mapping' WHEN broad THEN 'preregister_learned_signal' WHEN h2 = 'not_supported_in_current_pilot' THEN 'stop_residual_branch' WHEN rescued THEN 'replicate_on_broader_universe'
   WHEN h2 = 'supported' THEN 'test_slower_mapping' WHEN h2 = 'rejected' THEN 'resolve_residual_definition' ELSE 'audit_coverage' END AS next_action,
  CASE WHEN h2 = 'inconclusive' THEN 'low' ELSE 'medium' END AS confidence, false AS parameter_search_authorized, broad AS learned_model_authorized FROM judged""")

# How Spark runs these: rows stay with their symbol, what a date says of all its symbols comes to them as one row a date, and
# where a date's rows must meet for their ranks they are dealt by date once, before they are made one per horizon
lean("ic_wide", "SELECT /*+ REPARTITION(t), SHUFFLE_HASH(k) */ w.t, round(k.alpha, 12) AS a, " + ", ".join(f"round(w.{o} / nullif(w.o1, 0) - 1, 12) AS f{h}" for h, o in zip(_LAGS, ("o2", "o6", "o11", "o21"))) + " FROM rets2 w JOIN alpha k ON k.t = w.t AND k.symbol = w.symbol WHERE w.member")


def _ranks(x: np.ndarray, halves: bool) -> np.ndarray:
    """Places from 1 on in the order of x: equal values at the mean of theirs (halves), or in the order of their rows."""
    order = np.argsort(x, kind="stable")
    places = np.arange(1.0, len(x) + 1)
    if halves and len(x):
        s = x[order]
        same = (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(x))
        places = np.repeat((first + last + 1) / 2, last - first)
    out = np.empty(len(x))
    out[order] = places
    return out


def rank_correlations(wide: DataFrame, halves: bool) -> DataFrame:
    """(h, t, ic, n): the correlation of ranks of a date, its rows in one group, over the rows that have f{h}.

    halves: of a with f{h}, where both differ and equal values share their mean rank; else of s{h} with f{h}, ties in the order of
    symbol. Dates of fewer than 20 rows are left out."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows if halves else rows.take(pc.sort_indices(rows["symbol"]))
        out = []
        for h in _LAGS:
            here = rows[f"f{h}"].is_valid().to_numpy(zero_copy_only=False)
            x, y = (rows[c].to_numpy()[here] for c in ("a" if halves else f"s{h}", f"f{h}"))
            if len(x) >= 20 and not (halves and min(np.ptp(x), np.ptp(y)) <= 2.220446049250313e-16):
                p, q = (_ranks(v, halves) - (len(v) + 1) / 2 for v in (x, y))
                out.append((h, rows["t"][0].as_py(), float(p @ q / np.sqrt((p @ p) * (q @ q))), len(x)))
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))], ["h", "t", "ic", "n"])

    return wide.groupBy("t").applyInArrow(run, "h int, t long, ic double, n long").withColumn("t", F.col("t").cast(wide.schema["t"].dataType))


MADE["ic_ranked"] = ("ic_wide", lambda wide: rank_correlations(wide, True))
lean("ic_days", "SELECT h, t, ic, n FROM ic_ranked")
_WHOLE = ", ".join(f"CASE WHEN np{h} = {h} AND nf{h} = {h} THEN {c}{h} END AS {c}{h}" for h in _LAGS for c in ("past", "fut"))
_ONE = ", ".join(f"CASE l.lagn {' '.join(f'WHEN {h} THEN {c}{h}' for h in _LAGS)} END AS {c}" for c in ("past", "fut"))
lean("reversal_whole", f"SELECT t, symbol, {_WHOLE} FROM reversal_sums WHERE member")
lean("reversal_wide", "SELECT /*+ REPARTITION(t) */ t, symbol, " + ", ".join(f"round(-past{h}, 12) AS s{h}, CASE WHEN past{h} IS NOT NULL THEN round(fut{h}, 12) END AS f{h}" for h in _LAGS) + " FROM reversal_whole")
MADE["reversal_ranked"] = ("reversal_wide", lambda wide: rank_correlations(wide, False))
lean("reversal_days", "SELECT h, t, ic, n FROM reversal_ranked")
lean("reversal_ends", f"SELECT h, t, -past AS s, fut AS f FROM (SELECT l.lagn AS h, t, {_ONE} FROM reversal_whole CROSS JOIN horizons l) x WHERE past IS NOT NULL")
lean("reversal_pooled", "SELECT /*+ BROADCAST(c) */ p.period, d.h, corr(d.s, d.f) AS pooled FROM reversal_ends d JOIN calendar c ON c.t = d.t JOIN periods p ON c.d BETWEEN p.d0 AND p.d1 GROUP BY p.period, d.h")

lean("mechanism_base", "SELECT t, symbol, CASE WHEN t < (SELECT max(t) FROM calendar) THEN pos ELSE 0 END AS pos, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS nxt FROM held")
lean("mechanism_sizes", "SELECT t, sum(abs(pos)) AS size FROM held GROUP BY t")
lean("mechanism", "SELECT /*+ BROADCAST(d) */ x.t, x.symbol, ds.dir, x.pos * ds.dir / nullif(d.size, 0) AS w, x.nxt FROM mechanism_base x JOIN mechanism_sizes d ON d.t = x.t CROSS JOIN (SELECT 1 AS dir UNION ALL SELECT -1) ds")
lean("bt_base", "SELECT t, symbol, r, CASE WHEN r IS NULL THEN 0 ELSE lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY t) END AS lagpos FROM held")
lean("bt_sizes", "SELECT t, sum(abs(lagpos)) AS size FROM bt_base GROUP BY t")
lean("bt", "SELECT /*+ BROADCAST(d) */ x.t, x.symbol, x.lagpos / nullif(d.size, 0) AS w, x.r FROM bt_base x JOIN bt_sizes d ON d.t = x.t")
# The mechanism and the backtest read the same positions: one pass for what a date's positions add up to, one for both days' sums.
# The reversed mechanism is the mechanism with its sign turned
lean("held_sides", "SELECT t, symbol, coalesce(r, 0) AS r, pos, CASE WHEN r IS NULL THEN 0 ELSE lag(pos, 1, 0) OVER w END AS lagpos, coalesce(lead(r) OVER w, 0) AS nxt FROM held WINDOW w AS (PARTITION BY symbol ORDER BY t)")
lean("held_sizes", "SELECT t, sum(abs(pos)) AS size, sum(abs(lagpos)) AS lag_size FROM held_sides GROUP BY t")
lean("held_weights", "SELECT /*+ BROADCAST(d) */ x.t, x.symbol, x.r, x.nxt, coalesce(x.pos / nullif(d.size, 0), 0) AS w, coalesce(x.lagpos / nullif(d.lag_size, 0), 0) AS v FROM held_sides x JOIN held_sizes d ON d.t = x.t")
lean("held_lag", "SELECT *, lag(w, 1, 0) OVER s AS pw, lag(v, 1, 0) OVER s AS pv FROM held_weights WINDOW s AS (PARTITION BY symbol ORDER BY t)")
lean("held_days", "SELECT t, sum(w * nxt) AS ret, sum(abs(w - pw)) AS moved, max(CASE WHEN w <> 0 THEN 1.0 ELSE 0 END) AS active, sum(v * r) AS gross, sum(abs(v - pv)) AS turnover, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS short_share FROM held_lag GROUP BY t")
lean("mechanism_days", "SELECT ds.dir, t, ret * ds.dir AS ret, moved AS turnover, active FROM held_days CROSS JOIN (SELECT 1 AS dir UNION ALL SELECT -1) ds WHERE t >= 133 AND t < (SELECT max(t) FROM calendar)")
lean("bt_days", "SELECT t, gross, turnover, short_share FROM held_days WHERE t >= 134")
lean("long_sizes", "SELECT t, sum(greatest(alpha, 0)) AS size FROM alpha GROUP BY t")
lean("long_weights", "SELECT /*+ BROADCAST(d), SHUFFLE_HASH(a) */ s.t, s.symbol, coalesce(greatest(a.alpha, 0) / nullif(d.size, 0), 0) AS w FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol LEFT JOIN long_sizes d ON d.t = s.t")
# every row of the panel has a weight and a forward return, so both sides of a date are one pass
lean("pnl", """SELECT /*+ SHUFFLE_HASH(w) */ f.t, sum(w.w * f.fwd) AS gross, sum(abs(w.w - w.pw)) AS turnover, sum(f.benchmark_weight * f.fwd) AS bench
  FROM (SELECT t, symbol, benchmark_weight, o2 / nullif(o1, 0) - 1 AS fwd FROM rets2) f JOIN long_lag w ON w.t = f.t AND w.symbol = f.symbol WHERE f.fwd IS NOT NULL AND f.t >= 108 GROUP BY f.t""")
lean("book_values", """SELECT /*+ SHUFFLE_HASH(a) */ s.t, s.symbol, b.who, CASE b.who WHEN 'original' THEN greatest(coalesce(a.alpha, 0), 0) WHEN 'reversed' THEN greatest(-coalesce(a.alpha, 0), 0) WHEN 'neutral' THEN CASE WHEN s.member THEN 1 ELSE 0 END END AS v
  FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol CROSS JOIN (SELECT 'original' AS who UNION ALL SELECT 'reversed' UNION ALL SELECT 'neutral') b""")
lean("book_sizes", "SELECT t, who, sum(v) AS size FROM book_values GROUP BY t, who")
lean("books", "SELECT /*+ BROADCAST(d) */ x.t, x.symbol, x.who, coalesce(x.v / nullif(d.size, 0), 0) AS w FROM book_values x JOIN book_sizes d ON d.t = x.t AND d.who = x.who")

# All books in one row a symbol and date: a pass for what a date's books add up to (and how many scores are not 0), a pass for
# the days' sums and the benchmark's
_BOOKS = ("original", "reversed", "neutral")
_EACH = lambda text: ", ".join(text.replace("?", b) for b in _BOOKS)
lean("book_wide", """SELECT /*+ SHUFFLE_HASH(a) */ s.t, s.symbol, s.member, a.alpha, greatest(coalesce(a.alpha, 0), 0) AS original, greatest(-coalesce(a.alpha, 0), 0) AS reversed, CASE WHEN s.member THEN 1.0 ELSE 0 END AS neutral
  FROM scored s LEFT JOIN alpha a ON a.t = s.t AND a.symbol = s.symbol""")
lean("book_totals", f"SELECT t, {_EACH('sum(?) AS ?')}, avg(CASE WHEN member THEN CASE WHEN abs(alpha) > 1e-9 THEN 1.0 ELSE 0 END END) AS nz FROM book_wide GROUP BY t")
lean("book_shares", f"SELECT /*+ BROADCAST(d) */ x.t, x.symbol, {_EACH('coalesce(x.? / nullif(d.?, 0), 0) AS ?')} FROM book_wide x JOIN book_totals d ON d.t = x.t")
lean("book_changes", f"SELECT t, symbol, {_EACH('?')}, {_EACH('abs(? - lag(?, 1, 0) OVER w) AS ?_moved')} FROM book_shares WINDOW w AS (PARTITION BY symbol ORDER BY t)")
lean("book_sums", f"""SELECT /*+ SHUFFLE_HASH(b) */ f.t, sum(f.benchmark_weight * f.fwd) AS bench, {_EACH('sum(b.? * f.fwd) AS ?')}, {_EACH('sum(b.?_moved) AS ?_moved')}
  FROM (SELECT t, symbol, benchmark_weight, o2 / nullif(o1, 0) - 1 AS fwd FROM rets2) f JOIN book_changes b ON b.t = f.t AND b.symbol = f.symbol WHERE f.fwd IS NOT NULL AND f.t >= 108 GROUP BY f.t""")
lean("direction_facts", "SELECT " + ", ".join(f"avg({b} - bench) * PER_YEAR AS {b}_gross_excess, avg(0.00126 * {b}_moved) * PER_YEAR AS {b}_cost_drag" for b in _BOOKS) + " FROM book_sums")
lean("direction_tool", STEPS["direction_tool"].replace("SELECT nonzero_rate FROM signal_coverage", "SELECT round(avg(nz), 6) AS nonzero_rate FROM book_totals"))

lean("jaccard_days", STEPS["jaccard_days"].replace("SELECT", "SELECT /*+ BROADCAST(f) */", 1))
# All that the continuity audit counts by date comes of one pass over the residuals; a window of 30 residuals is two counts so far
lean("continuity_rows", """SELECT /*+ BROADCAST(d), SHUFFLE_HASH(k) */ s.t, s.symbol, s.member, s.r, CASE WHEN s.member THEN CASE WHEN k.n >= 20 AND d.sd > 2.220446049250313e-16 THEN (k.pct - 0.5) / d.sd ELSE 0 END END AS alpha
  FROM resid s LEFT JOIN ranked k ON k.t = s.t AND k.symbol = s.symbol LEFT JOIN rank_days d ON d.t = s.t""")
lean("continuity_marks", """SELECT t, symbol, member, r, alpha, member AND r IS NOT NULL AS now, coalesce(lag(member AND r IS NOT NULL) OVER w, false) AS before, lag(alpha) OVER w AS prev, count(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
  FROM continuity_rows WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
lean("continuity_days", """SELECT t, count(r) AS active, sum(CASE WHEN member THEN 1.0 ELSE 0 END) AS members, sum(CASE WHEN now THEN 1.0 ELSE 0 END) AS covered, sum(CASE WHEN now AND before THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN now OR before THEN 1.0 ELSE 0 END), 0) AS jaccard,
  avg(CASE WHEN member THEN abs(r) END) AS scale, avg(abs(alpha - prev)) AS moved, max(member AND known - before_30 = 30) AS windowed FROM (SELECT *, lag(known, 30, 0) OVER (PARTITION BY symbol ORDER BY t) AS before_30 FROM continuity_marks) x GROUP BY t""")
lean("fitted_days", "SELECT t, active FROM continuity_days WHERE active > 0")
lean("coverage_days", "SELECT t, active, members, covered FROM continuity_days WHERE active > 0")
lean("continuity_windows", STEPS["continuity_windows"].replace("SELECT DISTINCT t FROM ou WHERE nv = 30 AND member", "SELECT t FROM continuity_days WHERE windowed"))
lean("continuity_jaccard", STEPS["continuity_jaccard"].replace("FROM jaccard_days", "FROM continuity_days d JOIN refits f ON f.t = d.t WHERE f.version > 0"))
lean("scale_days", "SELECT d.t, v.is_refit, d.scale, d.moved FROM continuity_days d JOIN versions v ON v.t = d.t WHERE d.active > 0")


# Pairs of names are products of blocks of names: a task reads two blocks of whole series, dealt once, and gives their pairs of
# all dates; no block is copied for the blocks that it meets
lean("covariance_series", "SELECT symbol, transform(sort_array(collect_list(struct(t, ret))), x -> x.ret) AS rets, min(t) AS since FROM rets2 GROUP BY symbol")
lean("covariance_lists", "SELECT /*+ BROADCAST(d) */ d.on_t, s.symbol, s.rets, s.since FROM covariance_series s CROSS JOIN (SELECT sort_array(collect_list(on_t)) AS on_t FROM covariance_dates) d WHERE size(d.on_t) > 0")


def covariance_pairs(lists: DataFrame, block: int = 400, window: int | None = None) -> DataFrame:
    """(on_t, symbol_a, symbol_b, v): the population covariance of each pair of names of a date.

    lists: (on_t, symbol, rets), the values of a date; or, with a window, on_t holds all dates, rets a name's whole series of one
    row a t from the t `since`, and each date takes the window values before it, missing ones at their mean (0 where all are).
    """
    n = max(1, -(-lists.select("symbol").distinct().count() // block))
    lists = lists.select("on_t", "symbol", "rets", "since" if window else F.lit(0).alias("since")).withColumn("own", F.pmod(F.xxhash64("symbol"), F.lit(n)).cast("int"))
    blocks = lists.repartitionById(n, "own").groupBy("on_t", "own").agg(F.collect_list(F.struct("symbol", "rets")).alias("names"), F.min("since").alias("since"), F.max("since").alias("last"))
    left, right = blocks.alias("a"), blocks.alias("b")
    pairs = left.hint("shuffle_replicate_nl").join(right, F.expr("a.on_t = b.on_t AND a.own <= b.own")).selectExpr("a.on_t", "a.own = b.own AS same", "a.names AS a", "b.names AS b", "least(a.since, b.since) AS since", "greatest(a.last, b.last) AS last")

    def block_of(names: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
        cells = names.values
        rets = cells.field("rets")
        if len(rets.value_lengths().unique()) > 1:
            raise ValueError("a name has not one row of every t")
        return cells.field("symbol"), rets.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rets), -1)

    def centred(x: np.ndarray) -> np.ndarray:
        known = np.isfinite(x)
        means = np.where(known, x, 0.0).sum(axis=1, keepdims=True) / np.maximum(known.sum(axis=1, keepdims=True), 1)
        x = np.where(known, x, means)
        return x - x.mean(axis=1, keepdims=True)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for on_t, same, a, b, since, last in zip(*batch.columns):
                (names_a, x), (names_b, y) = block_of(a), block_of(b)
                if since.as_py() != last.as_py() or x.shape[1] != y.shape[1]:
                    raise ValueError("a name has not one row of every t")
                rank = np.argsort(np.argsort(np.array([*names_a.to_pylist(), *names_b.to_pylist()], dtype=object), kind="stable"), kind="stable")
                first = rank[: len(x), None] <= rank[None, len(x) :]
                k, m = np.nonzero(np.tri(len(x), dtype=bool) if same.as_py() else np.ones_like(first))
                names = pa.concat_arrays([names_a, names_b])
                fore, back = np.where(first[k, m], k, len(x) + m), np.where(first[k, m], len(x) + m, k)
                one, two = names.take(pa.array(fore)), names.take(pa.array(back))
                for t in on_t.as_py() if window else [on_t.as_py()]:
                    cut = slice(max(0, t - window - since.as_py()), max(0, t - since.as_py())) if window else slice(None)
                    p, q = centred(x[:, cut]), centred(y[:, cut])
                    v = (p @ q.T / p.shape[1])[k, m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), one, two, pa.array(v)], ["on_t", "symbol_a", "symbol_b", "v"])

    return pairs.mapInArrow(multiply, "on_t int, symbol_a string, symbol_b string, v double")


MADE["covariance_products"] = ("covariance_lists", lambda lists: covariance_pairs(lists, window=104))
lean("shrunk_covariance", "SELECT on_t, symbol_a, symbol_b, round(CASE WHEN symbol_a = symbol_b THEN v + 1e-8 ELSE 0.5 * v END, 9) AS cov FROM covariance_products")
