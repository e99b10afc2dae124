"""The (period, symbol) panel: dense grid, forward fill, point-in-time membership, limits and returns."""

from residua.plans.relations import STEPS, lean, step

# ---- grid and fills: a symbol is one of a supplier's three share classes under its board's prefix, a row a week, so a year
# is 52 rows; calendar rows, not rows present, are what lags and windows count. Money is summed in whole cents and prices are
# whole cents, halves up: no result hangs on the order of a sum.
step("pace", "SELECT 52 AS per_year")
step("trades", "SELECT concat(CASE l_suppkey % 5 WHEN 1 THEN '300' WHEN 2 THEN '688' WHEN 3 THEN '830' ELSE '600' END, lpad(CAST(l_suppkey * 3 + l_linenumber % 3 AS STRING), 9, '0')) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem")
step("week", "SELECT symbol, d, CAST(sum(q) AS BIGINT) AS volume, CAST(sum(x) AS BIGINT) AS money_cents FROM trades GROUP BY symbol, d")
# a close is the mean price of the symbol's last four traded weeks, an open lies half way from the close before
step("closes", """SELECT symbol, d, volume, money_cents, <<div CAST(2 * sum(money_cents) OVER w + sum(volume) OVER w AS BIGINT) ;; CAST(nullif(2 * sum(volume) OVER w, 0) AS BIGINT)>> AS close_cents FROM week
  WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
step("cell", "SELECT symbol, d, volume, money_cents, close_cents, <<div close_cents + lag(close_cents, 1, close_cents) OVER (PARTITION BY symbol ORDER BY d) + 1 ;; 2>> AS open_cents FROM closes")
step("calendar", "SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS t, year(d) * 12 + month(d) AS mi FROM (SELECT DISTINCT d FROM cell) days")
step("universe", "SELECT DISTINCT symbol FROM cell")
step("dense", """SELECT c.t, c.d, c.mi, c.symbol, x.close_cents, x.open_cents, coalesce(x.volume, 0) AS volume, coalesce(x.money_cents, 0) AS money_cents, x.close_cents IS NULL AS paused,
  count(x.close_cents) OVER (PARTITION BY c.symbol ORDER BY c.t) AS grp FROM (SELECT /*+ BROADCAST(calendar) */ t, d, mi, symbol FROM universe CROSS JOIN calendar) c LEFT JOIN cell x ON x.symbol = c.symbol AND x.d = c.d""")
step("prices", """SELECT t, d, mi, symbol, CAST(volume AS DOUBLE) AS volume, money_cents, money_cents / 100.0 AS money, paused, max(close_cents) OVER (PARTITION BY symbol, grp) / 100.0 AS close_price, max(open_cents) OVER (PARTITION BY symbol, grp) / 100.0 AS open_price,
  symbol LIKE '%7' AND t % 40 < 5 AS is_st FROM dense""")
step("month_money", "SELECT symbol, mi, CAST(sum(money_cents) AS BIGINT) AS mm FROM prices GROUP BY symbol, mi")
step("snapshot", "SELECT symbol, mi + 1 AS mi, mm, row_number() OVER (PARTITION BY mi ORDER BY mm DESC, symbol) AS rk, count(*) OVER (PARTITION BY mi) AS listed FROM month_money WHERE mm > 0")
step("members", "SELECT symbol, mi, mm / sum(mm) OVER (PARTITION BY mi) AS weight FROM snapshot WHERE rk <= ceil(listed * 0.88)")
step("panel", """SELECT p.t, p.d, p.symbol, p.close_price AS adjusted_close, p.open_price, p.close_price, p.volume, p.money, p.paused, p.is_st,
  m.symbol IS NOT NULL AS member, coalesce(m.weight, 0) AS benchmark_weight,
  lag(p.close_price) OVER (PARTITION BY p.symbol ORDER BY p.t) AS preclose FROM prices p LEFT JOIN members m ON m.symbol = p.symbol AND m.mi = p.mi""")

step("panel_build", """SELECT t, CAST(d AS STRING) AS d, symbol, round(adjusted_close, 6) AS adjusted_close, round(open_price, 6) AS open_price, round(volume, 2) AS volume, round(money, 2) AS money,
  paused, is_st, member, round(benchmark_weight, 9) AS benchmark_weight FROM panel""")
step("pit_membership", "SELECT symbol, mi, rk AS member_rank, round(mm / 100.0, 2) AS money FROM snapshot WHERE rk <= ceil(listed * 0.88)")
step("prior_trading_day", """SELECT m.mi, CAST(max(c.d) AS STRING) AS snapshot_day FROM (SELECT mi, min(d) AS first_day FROM calendar GROUP BY mi) m JOIN calendar c ON c.d < m.first_day AND c.mi >= m.mi - 2 GROUP BY m.mi""")
step("benchmark_weights", """SELECT mi, symbol, round(CASE WHEN mm > 0 AND symbol NOT LIKE '830%' THEN mm ELSE med END / sum(CASE WHEN mm > 0 AND symbol NOT LIKE '830%' THEN mm ELSE med END) OVER (PARTITION BY mi), 9) AS cap_weight,
  round(1.0 / count(*) OVER (PARTITION BY mi), 9) AS equal_weight FROM (SELECT s.*, x.med FROM snapshot s JOIN
  (SELECT mi, percentile_cont(0.5) WITHIN GROUP (ORDER BY mm) AS med FROM snapshot WHERE symbol NOT LIKE '830%' GROUP BY mi) x ON x.mi = s.mi) y""")
step("panel_audit", """SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(mem) AS BIGINT) AS member_cells, round(sum(mp) / nullif(sum(mem), 0), 9) AS paused_rate, round(sum(ms) / nullif(sum(mem), 0), 9) AS st_rate,
  CAST(sum(CASE WHEN abs(w - 1) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_weight_days, round(sum(miss) / nullif(sum(mem), 0), 9) AS missing_rate FROM
  (SELECT t, count(*) AS n, sum(CASE WHEN member THEN 1.0 ELSE 0 END) AS mem, sum(CASE WHEN member AND paused THEN 1.0 ELSE 0 END) AS mp, sum(CASE WHEN member AND is_st THEN 1.0 ELSE 0 END) AS ms,
   sum(CASE WHEN member AND adjusted_close IS NULL THEN 1.0 ELSE 0 END) AS miss, sum(benchmark_weight) AS w FROM panel GROUP BY t) a""")
step("member_changes", """SELECT mi, CAST(sum(CASE WHEN prev IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS entered, count(*) AS members FROM
  (SELECT a.mi, a.symbol, b.symbol AS prev FROM members a LEFT JOIN members b ON b.symbol = a.symbol AND b.mi = a.mi - 1) x GROUP BY mi""")

# ---- returns: guarded, by calendar row
step("rets", """SELECT *, CASE WHEN adjusted_close > 0 AND preclose > 0 THEN adjusted_close / preclose - 1 END AS ret, CASE WHEN close_price > 0 THEN open_price * adjusted_close / close_price END AS adj_open FROM panel""")
step("rets2", """SELECT *, lead(adj_open) OVER (PARTITION BY symbol ORDER BY t) AS o1, lead(adj_open, 2) OVER (PARTITION BY symbol ORDER BY t) AS o2, lead(adj_open, 6) OVER (PARTITION BY symbol ORDER BY t) AS o6,
  lead(adj_open, 11) OVER (PARTITION BY symbol ORDER BY t) AS o11, lead(adj_open, 21) OVER (PARTITION BY symbol ORDER BY t) AS o21 FROM rets""")
step("returns_close", "SELECT t, symbol, round(ret, 9) AS ret FROM rets")
step("returns_open", "SELECT t, symbol, round(o1 / nullif(adj_open, 0) - 1, 9) + 0.0 AS open_to_open, round(o1 / nullif(adjusted_close, 0) - 1, 9) + 0.0 AS close_to_next_open FROM rets2")
step("forward", "SELECT t, symbol, member, h, CASE h WHEN 1 THEN o2 WHEN 5 THEN o6 WHEN 10 THEN o11 ELSE o21 END / nullif(o1, 0) - 1 AS fwd FROM rets2 CROSS JOIN (SELECT 1 AS h UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20) hs")
step("forward_returns", "SELECT t, symbol, h, round(fwd, 9) AS fwd FROM forward")
step("pct_change", "SELECT t, symbol, round(coalesce(adjusted_close / nullif(preclose, 0) - 1, 0), 9) AS change FROM panel")

# ---- derived prices
step("limit_rate", """SELECT *, <<div pre_cents * (100 + percent) + 50 ;; 100>> AS high_cents, <<div pre_cents * (100 - percent) + 50 ;; 100>> AS low_cents FROM
  (SELECT *, CASE WHEN symbol LIKE '688%' THEN 20 WHEN symbol LIKE '300%' AND d >= DATE '1998-08-24' THEN 20 WHEN symbol LIKE '830%' THEN 30 WHEN is_st THEN 5 ELSE 10 END AS percent,
   CAST(round(preclose * 100) AS BIGINT) AS pre_cents, CAST(round(open_price * 100) AS BIGINT) AS open_cents FROM panel) p""")
step("limit_prices", """SELECT t, symbol, percent / 100.0 AS rate, high_cents / 100.0 AS high_limit, low_cents / 100.0 AS low_limit,
  CASE WHEN paused THEN 'suspended' WHEN open_cents >= high_cents THEN 'upper_limit' WHEN open_cents <= low_cents THEN 'lower_limit' ELSE 'tradable' END AS state FROM limit_rate WHERE preclose IS NOT NULL""")
step("tradable_flags", """SELECT t, symbol, member AND NOT is_st AS eligible, NOT paused AND open_price > 0 AND volume > 0 AS tradable,
  coalesce(NOT paused AND open_price > 0 AND volume > 0 AND NOT is_st AND open_cents < high_cents, false) AS can_buy,
  coalesce(NOT paused AND open_price > 0 AND volume > 0 AND open_cents > low_cents, false) AS can_sell FROM limit_rate""")
# ratios of cents often end in a 5: halves go up, also where the last bit of the product lies below
step("adjusted_index", """SELECT t, symbol, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY t)) + 1e-9, 6) AS adjusted_index FROM
  (SELECT *, min(CASE WHEN NOT paused THEN t END) OVER (PARTITION BY symbol) AS first_t, max(CASE WHEN NOT paused THEN t END) OVER (PARTITION BY symbol) AS last_t FROM rets) x WHERE t BETWEEN first_t AND last_t""")
step("fill_limited", """SELECT t, symbol, round(CASE WHEN t - last_t <= 120 THEN shares END, 6) AS implied_shares FROM (SELECT t, symbol, max(s) OVER (PARTITION BY symbol, g) AS shares, max(CASE WHEN s IS NOT NULL THEN t END) OVER (PARTITION BY symbol, g) AS last_t FROM
  (SELECT t, symbol, s, count(s) OVER (PARTITION BY symbol ORDER BY t) AS g FROM (SELECT t, symbol, CASE WHEN NOT paused AND t % 130 < 3 THEN volume / 0.01 END AS s FROM prices) a) b) c""")
step("dedupe_keep_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) x WHERE rn = 1")
step("string_bars", "SELECT CAST(t AS STRING) AS ts, symbol, CASE WHEN paused THEN '' ELSE CAST(round(volume, 2) AS STRING) END AS volume, CASE WHEN paused THEN '0' ELSE '1' END AS tradestatus FROM prices")
step("coerce_strings", "SELECT <<int ts>> AS t, symbol, <<dbl volume>> AS volume FROM string_bars WHERE tradestatus = '1'")

# How Spark runs these: a fill is the last price so far, in the order that the rows are in; what a bucket of symbols is joined
# with is looked up within the bucket
lean("dense", STEPS["dense"].replace("SELECT c.t", "SELECT /*+ SHUFFLE_HASH(x) */ c.t", 1))
lean("prices", """SELECT t, d, mi, symbol, CAST(volume AS DOUBLE) AS volume, money_cents, money_cents / 100.0 AS money, paused, seen.c / 100.0 AS close_price, seen.o / 100.0 AS open_price, symbol LIKE '%7' AND t % 40 < 5 AS is_st FROM
  (SELECT *, last_value(CASE WHEN close_cents IS NOT NULL THEN struct(close_cents AS c, open_cents AS o) END) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM dense) x""")
lean("panel", STEPS["panel"].replace("SELECT p.t", "SELECT /*+ SHUFFLE_HASH(m) */ p.t", 1))
lean("ranked_months", "SELECT symbol, mi, mm, row_number() OVER (PARTITION BY mi ORDER BY mm DESC, symbol) AS rk, count(*) OVER (PARTITION BY mi) AS listed FROM month_money WHERE mm > 0")
lean("members", "SELECT symbol, mi + 1 AS mi, mm / sum(mm) OVER (PARTITION BY mi) AS weight FROM ranked_months WHERE rk <= ceil(listed * 0.88)")
