"""Costs, lots, one-period weight execution, the deterministic pair and its spread backtest."""

from residua.plans.relations import step

step("orders_priced", "SELECT o_orderkey, o_orderdate, o_totalprice AS notional, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side FROM orders")
step("fee_schedule", """SELECT o_orderkey, side, round(CASE WHEN notional <= 0 THEN 0 ELSE greatest(5.0, notional * 0.00025) + notional * 0.00001 + CASE WHEN side = 'sell' THEN notional * CASE WHEN o_orderdate < TIMESTAMP '1998-08-28 00:00:00' THEN 0.001 ELSE 0.0005 END ELSE 0 END END, 8) AS fee FROM orders_priced""")
step("round_trip_cost", "SELECT y, round(2 * (0.00025 + 0.00001 + 0.001) + CASE WHEN y < 1998 THEN 0.001 ELSE 0.0005 END, 9) AS cost FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) x")
# a buy of 37 times the line's quantity with the cash of 30: whole lots of what was asked, cut to what the cash affords with fees,
# as execution_ledger does; the closed form may miss a lot by rounding, so the three lots about it are tried
step("lots_asked", """SELECT *, shares - shares % 100 AS lots, CAST(floor(least((cash + 1e-9) / (price * 1.00026), greatest(0, cash + 1e-9 - 5) / (price * 1.00001)) / 100) * 100 AS BIGINT) AS top FROM
  (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 37 AS BIGINT) AS shares, l_extendedprice / nullif(l_quantity, 0) AS price, l_extendedprice * 30 AS cash FROM lineitem) x WHERE price > 0""")
_PAID = "n{0} * price + CASE WHEN n{0} > 0 THEN greatest(5.0, n{0} * price * 0.00025) ELSE 0 END + n{0} * price * 0.00001 <= cash + 1e-9"
step("lot_rounding", f"""SELECT l_orderkey, l_linenumber, l_partkey, shares, lots, CASE WHEN {_PAID.format(0)} THEN n0 WHEN {_PAID.format(1)} THEN n1 ELSE n2 END AS affordable FROM
  (SELECT *, least(lots, top + 100) AS n0, greatest(least(lots, top + 100) - 100, 0) AS n1, greatest(least(lots, top + 100) - 200, 0) AS n2 FROM lots_asked) x""")
step("blocked_reason", "SELECT t, symbol, side, CASE WHEN state = 'suspended' THEN 'suspended' WHEN side = 'buy' AND state = 'upper_limit' THEN 'upper_limit' WHEN side = 'sell' AND state = 'lower_limit' THEN 'lower_limit' END AS reason FROM limit_prices CROSS JOIN (SELECT 'buy' AS side UNION ALL SELECT 'sell') s")
step("weight_targets", "SELECT a.t, a.symbol, greatest(a.alpha, 0) / nullif(sum(greatest(a.alpha, 0)) OVER (PARTITION BY a.t), 0) AS target, p.benchmark_weight AS held, NOT p.paused AND NOT p.is_st AS can_buy, NOT p.paused AS can_sell FROM alpha a JOIN panel p ON p.t = a.t AND p.symbol = a.symbol")
step("weight_sides", "SELECT *, CASE WHEN can_sell THEN greatest(held - target, 0) ELSE 0 END AS sell, CASE WHEN can_buy THEN greatest(target - held, 0) ELSE 0 END AS want, sum(held) OVER (PARTITION BY t) AS invested FROM weight_targets")
step("weight_scaled", "SELECT *, greatest(0, 1 - invested + sum(sell) OVER (PARTITION BY t)) AS cash, sum(want) OVER (PARTITION BY t) AS wanted FROM weight_sides")
step("weight_execution", """SELECT t, symbol, round(held - sell + bought + 1e-10, 6) AS weight, round(sell + 1e-10, 6) AS sold, round(bought + 1e-10, 6) AS bought FROM
  (SELECT *, want * least(1, coalesce(cash / nullif(wanted, 0), 0)) AS bought FROM weight_scaled) x""")  # weights of ranks often end in a 5: halves go up
step("trade_costs", "SELECT w.t, round(sum(bought) * 0.00126 + sum(sold) * (0.00126 + CASE WHEN c.d < DATE '1998-08-28' THEN 0.001 ELSE 0.0005 END), 9) AS cost FROM (SELECT t, sell AS sold, want * least(1, coalesce(cash / nullif(wanted, 0), 0)) AS bought FROM weight_scaled) w JOIN calendar c ON c.t = w.t GROUP BY w.t, c.d")

# Pairs: the first two share classes of each supplier, by the weeks in which both have a price. The hedge is fitted on the
# first 60 rows, the spread is scaled by the 30 rows before; positions hold until the z-score leaves its bands.
step("classes", "SELECT t, d, close_price, <<div CAST(substring(symbol, 4) AS BIGINT) ;; 3>> AS pair, CAST(substring(symbol, 4) AS BIGINT) % 3 AS class FROM panel")
step("pair_closes", "SELECT pair, t, d, max(CASE WHEN class = 0 THEN close_price END) AS asset_a, max(CASE WHEN class = 1 THEN close_price END) AS asset_b FROM classes WHERE class < 2 GROUP BY pair, t, d")
step("pair", "SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n, d, asset_a, asset_b FROM pair_closes WHERE asset_a IS NOT NULL AND asset_b IS NOT NULL")
step("pair_part", """SELECT pair, 'full' AS part, i, n, d, asset_a, asset_b FROM pair UNION ALL SELECT pair, CASE WHEN i < <<div n ;; 2>> THEN 'first' ELSE 'second' END, CASE WHEN i < <<div n ;; 2>> THEN i ELSE i - <<div n ;; 2>> END,
  CASE WHEN i < <<div n ;; 2>> THEN <<div n ;; 2>> ELSE n - <<div n ;; 2>> END, d, asset_a, asset_b FROM pair""")
step("pair_fit", "SELECT pair, part, coalesce(regr_slope(asset_a, asset_b), 0) AS beta, coalesce(regr_intercept(asset_a, asset_b), avg(asset_a)) AS alpha FROM pair_part WHERE i < 60 AND n > 60 GROUP BY pair, part")
step("pair_spread", "SELECT p.pair, p.part, p.i, p.d, f.beta, asset_a - (f.alpha + f.beta * asset_b) AS spread, coalesce(asset_a / nullif(lag(asset_a) OVER w, 0) - 1, 0) AS ra, coalesce(asset_b / nullif(lag(asset_b) OVER w, 0) - 1, 0) AS rb FROM pair_part p JOIN pair_fit f ON f.pair = p.pair AND f.part = p.part WINDOW w AS (PARTITION BY p.pair, p.part ORDER BY p.i)")
step("pair_z", "SELECT *, CASE WHEN i >= 30 AND s > 1e-12 THEN round((spread - m) / s, 9) END AS z FROM (SELECT *, avg(spread) OVER w AS m, stddev_samp(spread) OVER w AS s FROM pair_spread WINDOW w AS (PARTITION BY pair, part ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) x")
step("pair_dec", "SELECT *, CASE WHEN i < 60 OR z IS NULL THEN 0 WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 WHEN abs(z) < 0.1 THEN 0 END AS dec FROM pair_z")
step("pair_grp", "SELECT *, count(dec) OVER (PARTITION BY pair, part ORDER BY i) AS grp FROM pair_dec")
step("pair_pos", "SELECT *, coalesce(max(dec) OVER (PARTITION BY pair, part, grp), 0) AS pos FROM pair_grp")
step("pair_rows", "SELECT pair, part, i, pos, prev * (ra - beta * rb) / (1 + abs(beta)) AS r0, abs(pos - prev) AS traded FROM (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY pair, part ORDER BY i) AS prev FROM pair_pos) x")
step("pair_cost", "SELECT pair, part, i, pos, bp, r0 - bp / 10000.0 * traded AS r, traded FROM pair_rows CROSS JOIN (SELECT 0 AS bp UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20) c WHERE part = 'full' OR bp = 5")
# A day that loses all ends the pair's wealth: no logarithm of what is not positive, and its ratios are null
step("pair_wealth", "SELECT *, exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY pair, part, bp ORDER BY i)) AS wealth FROM pair_cost")
step("pair_peak", "SELECT *, greatest(1, max(wealth) OVER (PARTITION BY pair, part, bp ORDER BY i)) AS peak FROM pair_wealth")
step("pair_sums", """SELECT pair, part, bp, count(*) AS days, sum(CASE WHEN r > -1 THEN ln(1 + r) END) AS growth, min(r) AS worst, stddev_samp(r) AS s, max(1 - wealth / peak) AS max_drawdown, CAST(sum(traded) AS BIGINT) AS traded,
  CAST(sum(CASE WHEN traded > 0 THEN 1 ELSE 0 END) AS BIGINT) AS trades, CAST(sum(CASE WHEN pos <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS held, min(CASE WHEN pos <> 0 THEN i END) AS first_position FROM pair_peak GROUP BY pair, part, bp""")
step("pair_metrics", """SELECT pair, part, bp, days, traded, trades, held, first_position, max_drawdown, annual_return, annual_vol, round(coalesce(annual_return / nullif(annual_vol, 0), 0), 5) AS sharpe FROM
  (SELECT *, CASE WHEN worst > -1 THEN power(exp(growth), 1.0 * PER_YEAR / days) - 1 END AS annual_return, coalesce(s, 0) * sqrt(PER_YEAR) AS annual_vol FROM pair_sums) x""")
step("pair_series", "SELECT pair, CAST(i AS BIGINT) AS i, CAST(d AS STRING) AS d, asset_a, asset_b FROM pair")
step("pair_signal", "SELECT pair, CAST(i AS BIGINT) AS i, round(spread, 6) AS spread, round(z, 6) AS z, CAST(pos AS INT) AS pos FROM pair_pos WHERE part = 'full'")
step("pair_backtest", """SELECT pair, days, round(annual_return, 6) AS annual_return, round(annual_vol, 6) AS annual_vol, sharpe, round(max_drawdown, 6) AS max_drawdown, trades, round(traded / (1.0 * days), 6) AS average_turnover, held AS position_days, CAST(first_position AS BIGINT) AS first_position
  FROM pair_metrics WHERE part = 'full' AND bp = 5""")
step("pair_costs", """SELECT pair, CAST(sum(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_scenarios, count(*) AS scenarios, max(CASE WHEN bp = 20 THEN sharpe END) > 0 AS survives_highest,
  round(max(CASE WHEN bp = 20 THEN sharpe END) - max(CASE WHEN bp = 0 THEN sharpe END), 6) AS sharpe_change FROM pair_metrics WHERE part = 'full' GROUP BY pair""")
step("pair_cost_ladder", "SELECT m.pair, m.bp, m.sharpe, round(m.annual_return, 6) AS annual_return, round(m.max_drawdown, 6) AS max_drawdown, c.positive_scenarios, c.scenarios, c.survives_highest, c.sharpe_change FROM pair_metrics m JOIN pair_costs c ON c.pair = m.pair WHERE m.part = 'full'")
step("pair_periods", "SELECT pair, max(CASE WHEN part = 'first' THEN sharpe END) AS first_sharpe, max(CASE WHEN part = 'second' THEN sharpe END) AS second_sharpe FROM pair_metrics WHERE part <> 'full' GROUP BY pair HAVING count(*) = 2")
step("pair_period_stability", "SELECT pair, first_sharpe, second_sharpe, first_sharpe > 0 AND second_sharpe > 0 AS both_positive, round(abs(first_sharpe - second_sharpe), 6) AS sharpe_gap, round(abs(first_sharpe - second_sharpe), 6) <= 1.0 AS stable FROM pair_periods")

# What a pair's results say, and which checks they ask for. Sharpe ratios of 1 and 0, the tools of the checks
# that are recommended, two of them at most, and what follows from them.
step("result_interpretation", """SELECT b.pair, b.sharpe, CASE WHEN b.sharpe > 1 THEN 'positive' WHEN b.sharpe > 0 THEN 'positive_not_strong' ELSE 'not_positive' END AS performance, CASE WHEN b.sharpe > 1 THEN 'medium' ELSE 'low' END AS mean_reversion_confidence,
  coalesce(c.survives_highest, false) AS cost_robust, coalesce(p.both_positive AND p.stable, false) AS period_robust,
  CASE WHEN b.sharpe > 0 AND coalesce(c.survives_highest, false) AND coalesce(p.both_positive AND p.stable, false) THEN 'supported' WHEN b.sharpe > 0 THEN 'incomplete_or_mixed' ELSE 'not_supported' END AS verdict,
  CASE WHEN b.sharpe > 0 AND coalesce(c.survives_highest, false) AND coalesce(p.both_positive AND p.stable, false) THEN 'medium' ELSE 'low' END AS confidence, false AS parameter_search_authorized, false AS holdout_accessed
  FROM pair_backtest b LEFT JOIN pair_costs c ON c.pair = b.pair LEFT JOIN pair_period_stability p ON p.pair = b.pair""")
step("recommended", """SELECT pair, place, experiment FROM pair_backtest CROSS JOIN (SELECT 1 AS place, 'Cost sensitivity test' AS experiment UNION ALL SELECT 2, 'Rolling-period analysis' UNION ALL SELECT 3, 'Signal-module replacement') r""")
step("tool_names", "SELECT 'cost sensitivity test' AS experiment, 'run_cost_sensitivity_experiment' AS tool UNION ALL SELECT 'rolling-period analysis', 'run_period_stability_experiment'")
step("tool_plan", """SELECT pair, tool, priority FROM (SELECT pair, tool, row_number() OVER (PARTITION BY pair ORDER BY place) AS priority FROM
  (SELECT r.pair, n.tool, min(r.place) AS place FROM recommended r JOIN tool_names n ON n.experiment = lower(trim(r.experiment)) GROUP BY r.pair, n.tool) x) y WHERE priority <= 2""")
