"""Residuals with zero factors, rolling Ornstein-Uhlenbeck fits, rank and buffered signals, Fourier features."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.plans.relations import MADE, STEPS, lean, step

# K = 0 residual: the return itself, under the refit's eligibility rules; a period drops out if a mapped return is missing
step("history", """SELECT t, d, symbol, member, ret, count(ret) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING) AS n_hist,
  stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING) AS vol, CASE WHEN t >= 104 THEN min(CASE WHEN t >= 104 THEN t END) OVER (PARTITION BY symbol, year(d) * 12 + month(d)) END AS refit_t FROM rets""")
step("mapped", "SELECT t AS refit_t, symbol FROM history WHERE t = refit_t AND member AND n_hist = 104 AND vol > 2.220446049250313e-16")
step("residual", """SELECT t, symbol, member, refit_t, ret AS r FROM (SELECT h.*, count(h.ret) OVER (PARTITION BY h.t) AS have, count(*) OVER (PARTITION BY h.t) AS want FROM history h JOIN mapped m ON m.refit_t = h.refit_t AND m.symbol = h.symbol) x WHERE have = want""")
step("resid", "SELECT g.t, g.symbol, g.member, r.r, g.ret, g.d FROM rets g LEFT JOIN residual r ON r.t = g.t AND r.symbol = g.symbol")
step("residuals_k0", "SELECT t, symbol, refit_t, round(r, 9) AS residual FROM residual")

# Rolling OU as AR(1) on the cumulative residual; slope, R2 and innovation variance do not depend on where the sum starts
step("ou_path", "SELECT t, symbol, member, r, ret, sum(coalesce(r, 0)) OVER (PARTITION BY symbol ORDER BY t) AS y, count(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS nv FROM resid")
step("ou_lagged", "SELECT *, lag(y) OVER (PARTITION BY symbol ORDER BY t) AS x, lag(y, 30) OVER (PARTITION BY symbol ORDER BY t) AS y30 FROM ou_path")
step("ou_moments", """SELECT t, symbol, member, r, ret, nv, y, coalesce(y30, 0) AS y0, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_r2(y, x) OVER w AS r2, var_pop(y) OVER w AS vy, var_pop(x) OVER w AS vx
  FROM ou_lagged WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)""")
step("ou", """SELECT t, symbol, member, r, ret, nv, y, y0, a, b, r2, vy, CASE WHEN nv = 30 AND vx > 2.220446049250313e-16 AND b > 0 AND b < 1 AND vy * (1 - r2) > 0
  THEN (y - a / (1 - b)) / sqrt(vy * (1 - r2) / (1 - b * b)) END AS z FROM ou_moments""")
step("ou_pos", "SELECT *, CASE WHEN z IS NULL OR r2 <= 0.25 THEN 0 WHEN z > 1.25 THEN -1 WHEN z < -1.25 THEN 1 ELSE 0 END AS pos FROM ou")
step("ou_fit", "SELECT t, symbol, round(b, 6) AS b, round(-ln(b), 6) AS kappa, round(r2, 6) AS r2, round(z, 5) AS z FROM ou WHERE z IS NOT NULL")
step("ou_positions", "SELECT t, symbol, CASE WHEN t < (SELECT max(t) FROM calendar) THEN pos ELSE 0 END AS position FROM ou_pos WHERE nv = 30")
step("ou_epsilon", """SELECT t, symbol, round(((a - y0 * (1 - b)) / (1 - b + 1e-6) - (y - y0)) / sqrt(vy * (1 - r2) / abs(1 - b * b + 1e-6)), 4) AS signal FROM ou WHERE nv = 30 AND b > 0 AND b < 1 AND r2 > 0.25 AND vy * (1 - r2) > 0""")

# Cross-sectional ranks of the trail5 five-period residual; ties share their mean rank
step("trail5", "SELECT t, symbol, member, ret, r, sum(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5, count(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5 FROM resid")
step("scored", "SELECT t, symbol, member, ret, CASE WHEN n5 = 5 AND member THEN round(-s5, 12) END AS score FROM trail5")
step("ranked", """SELECT t, symbol, score, (rank() OVER (PARTITION BY t ORDER BY score) + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY t) AS pct, count(*) OVER (PARTITION BY t) AS n FROM scored WHERE score IS NOT NULL""")
step("alpha", """SELECT s.t, s.symbol, k.pct, CASE WHEN k.n >= 20 AND k.sd > 2.220446049250313e-16 THEN (k.pct - 0.5) / k.sd ELSE 0 END AS alpha FROM scored s
  LEFT JOIN (SELECT *, stddev_pop(pct) OVER (PARTITION BY t) AS sd FROM ranked) k ON k.t = s.t AND k.symbol = s.symbol WHERE s.member""")
step("rank_alpha", "SELECT t, symbol, round(pct, 9) AS pct, round(alpha, 6) AS alpha FROM alpha")

# Hysteresis without a loop: the last forced value holds until an opposing band cancels it
step("banded", """SELECT s.t, s.symbol, s.member, s.score IS NOT NULL AS valid, k.n, CASE WHEN s.score IS NULL THEN 0 WHEN k.n < 20 THEN NULL WHEN k.pct >= 0.8 THEN 1 WHEN k.pct <= 0.2 THEN -1 WHEN k.pct > 0.4 AND k.pct < 0.6 THEN 0 END AS dec,
  CASE WHEN s.score IS NULL OR k.n < 20 THEN 0 WHEN k.pct >= 0.6 AND k.pct < 0.8 THEN -1 WHEN k.pct > 0.2 AND k.pct <= 0.4 THEN 1 ELSE 0 END AS opp FROM scored s LEFT JOIN ranked k ON k.t = s.t AND k.symbol = s.symbol""")
step("grouped", "SELECT *, count(dec) OVER (PARTITION BY symbol ORDER BY t) AS grp FROM banded")
step("based", "SELECT *, max(dec) OVER (PARTITION BY symbol, grp) AS base FROM grouped")
step("buffered", "SELECT t, symbol, member, valid, n, CASE WHEN base IS NULL OR max(CASE WHEN opp <> 0 AND opp = base THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, grp ORDER BY t) = 1 THEN 0 ELSE base END AS state FROM based")
step("buffered_alpha", """SELECT t, symbol, CAST(state AS INT) AS state, CASE WHEN valid AND n >= 20 AND s > 2.220446049250313e-16 THEN round((state - m) / s, 6) ELSE 0 END AS alpha
  FROM (SELECT *, avg(CASE WHEN valid THEN state END) OVER (PARTITION BY t) AS m, stddev_pop(CASE WHEN valid THEN state END) OVER (PARTITION BY t) AS s FROM buffered) x WHERE member""")
step("state_share", "SELECT t, round(avg(CASE WHEN state > 0 THEN 1.0 ELSE 0 END), 9) AS long_share, round(avg(CASE WHEN state < 0 THEN 1.0 ELSE 0 END), 9) AS short_share, round(avg(CASE WHEN state = 0 THEN 1.0 ELSE 0 END), 9) AS flat_share FROM buffered WHERE member GROUP BY t")
step("alpha_change", "SELECT t, round(moved, 6) AS mean_change, shared FROM alpha_moves")

# Fourier features: 16 real and 14 imaginary parts of the transform of a cumulative 30-period window, as products of the window's
# list with fixed rows. Where the sum starts shows in the first part only, as the other rows add up to nothing
step("windows", """SELECT t, symbol, coalesce(y30, 0) AS y0, <<collect y>> OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ys, nv FROM ou_lagged""")
_ROWS = [[math.cos(2 * math.pi * k * j / 30) if k < 16 else -math.sin(2 * math.pi * (k - 15) * j / 30) for j in range(30)] for k in range(30)]
_PARTS = ", ".join(f"{{}} AS f{k}".format(f"<<dot ys ;; <<list {', '.join(f'{v:.17f}' for v in row)}>>>>" + (" - 30 * y0" if k == 0 else "")) for k, row in enumerate(_ROWS))
step("fourier_wide", f"SELECT t, symbol, {_PARTS} FROM windows WHERE nv = 30")
step("fourier_features", f"SELECT t, symbol, CAST(k.i AS INT) AS feature, round(CASE k.i {' '.join(f'WHEN {k} THEN f{k}' for k in range(30))} END, 6) AS value FROM fourier_wide CROSS JOIN <<series 30>> k")
step("cumulative_windows", "SELECT t, symbol, CAST(k.i AS INT) AS j, round(<<item ys ;; k.i>> - y0, 9) + 0.0 AS value FROM windows CROSS JOIN <<series 30>> k WHERE nv = 30")

# The threshold backtest over long histories: rows are cut into blocks that also hold the 30 rows before, so sums and moments
# reach no further back. A window of 30 whole residuals (a zero is a missing one) decides the next row's position.
step("halo", "SELECT symbol, t, r, own + k AS block, k = 0 AS mine FROM (SELECT symbol, t, r, <<div t ;; 250>> AS own FROM resid) x CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks WHERE k = 0 OR t % 250 >= 220")
step("halo_path", "SELECT symbol, block, mine, t, sum(coalesce(r, 0)) OVER (PARTITION BY symbol, block ORDER BY t) AS y, count(CASE WHEN r <> 0 THEN 1 END) OVER (PARTITION BY symbol, block ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS nv FROM halo")
step("halo_lagged", "SELECT *, lag(y) OVER (PARTITION BY symbol, block ORDER BY t) AS x, coalesce(lag(y, 30) OVER (PARTITION BY symbol, block ORDER BY t), 0) AS y0 FROM halo_path")
step("halo_moments", """SELECT symbol, t, mine, nv, y - y0 AS last, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, y0, regr_r2(y, x) OVER w AS r2, var_pop(y) OVER w AS vy, var_pop(x) OVER w AS vx
  FROM halo_lagged WINDOW w AS (PARTITION BY symbol, block ORDER BY t ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)""")
step("halo_scores", """SELECT symbol, t + 1 AS t, round(((a - y0 * (1 - b)) / (1 - b + 1e-6) - last) / sqrt(vy * (1 - r2) / abs(1 - b * b + 1e-6)), 9) AS score FROM halo_moments WHERE mine AND nv = 30 AND vx > 0 AND b > 0 AND b < 1 AND r2 > 0.25 AND vy * (1 - r2) > 0""")
step("threshold_positions", "SELECT g.t, g.symbol, coalesce(g.r, 0) AS r, CASE WHEN s.score > 1.25 THEN 1 WHEN s.score < -1.25 THEN -1 ELSE 0 END AS pos FROM resid g LEFT JOIN halo_scores s ON s.symbol = g.symbol AND s.t = g.t WHERE g.t >= 134")
step("threshold_weights", "SELECT t, symbol, r, pos, coalesce(pos / nullif(sum(abs(pos)) OVER (PARTITION BY t), 0), 0) AS w FROM threshold_positions")
step("threshold_days", "SELECT t, sum(w * r) AS gross, sum(abs(w - pw)) AS turnover, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short_share, count(CASE WHEN pos <> 0 THEN 1 END) AS active FROM (SELECT *, lag(w, 1, 0) OVER (PARTITION BY symbol ORDER BY t) AS pw FROM threshold_weights) x GROUP BY t")
step("threshold_backtest", "SELECT t, round(gross, 9) AS gross, round(turnover, 9) AS turnover, round(short_share, 9) AS short_share, active, round(gross - 0.0005 * turnover - 0.0001 * short_share, 9) AS net FROM threshold_days")
step("threshold_summary", "SELECT count(*) AS days, round(avg(net) * PER_YEAR, 6) AS annual_mean, round(stddev_pop(net) * sqrt(PER_YEAR), 6) AS annual_vol, round(coalesce(avg(net) / nullif(stddev_pop(net), 0), 0) * sqrt(PER_YEAR), 5) AS sharpe, round(avg(active), 6) AS mean_active FROM threshold_backtest")

# How Spark runs these: rows stay with their symbol, and what a date says of all its symbols comes to them as one row a date
# Whether the 104 returns before a row are all there and not all alike: from counts so far. Returns are ratios of whole cents, so
# two that differ do so by far more than the deviation asked for.
# All symbols have the same rows, so a month's refit is a row of the calendar.
lean("refit_days", "SELECT mi, min(t) AS refit_t FROM calendar WHERE t >= 104 GROUP BY mi")
lean("history", "SELECT /*+ BROADCAST(c) */ h.t, h.symbol, h.member, h.ret, CASE WHEN h.t >= 104 THEN c.refit_t END AS refit_t FROM rets h LEFT JOIN refit_days c ON c.mi = year(h.d) * 12 + month(h.d)")
lean("history_counts", """SELECT t, symbol, member, refit_t, count(ret) OVER w AS known, count(CASE WHEN ret <> before THEN 1 END) OVER w AS changes
  FROM (SELECT t, symbol, member, ret, refit_t, lag(ret) OVER (PARTITION BY symbol ORDER BY t) AS before FROM history) x WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
lean("mapped", """SELECT t AS refit_t, symbol FROM (SELECT t, symbol, member, refit_t, lag(known, 1, 0) OVER w - lag(known, 105, 0) OVER w AS n_hist, lag(changes, 1, 0) OVER w - lag(changes, 104, 0) OVER w AS n_changes FROM history_counts WINDOW w AS (PARTITION BY symbol ORDER BY t)) x
  WHERE t = refit_t AND member AND n_hist = 104 AND n_changes > 0""")
lean("broken", "SELECT /*+ SHUFFLE_HASH(m) */ DISTINCT h.t FROM history h JOIN mapped m ON m.refit_t = h.refit_t AND m.symbol = h.symbol WHERE h.ret IS NULL")
lean("residual", """SELECT /*+ BROADCAST(b), SHUFFLE_HASH(m) */ h.t, h.symbol, h.member, h.refit_t, h.ret AS r FROM history h JOIN mapped m ON m.refit_t = h.refit_t AND m.symbol = h.symbol LEFT ANTI JOIN broken b ON b.t = h.t""")
lean("held", "SELECT t, symbol, member, r, nv, pos FROM ou_held")
lean("ou_positions", STEPS["ou_positions"].replace("FROM ou_pos", "FROM held"))
lean("rank_days", "SELECT t, stddev_pop(pct) AS sd FROM ranked GROUP BY t")
lean("alpha", """SELECT /*+ BROADCAST(d), SHUFFLE_HASH(k) */ s.t, s.symbol, k.pct, CASE WHEN k.n >= 20 AND d.sd > 2.220446049250313e-16 THEN (k.pct - 0.5) / d.sd ELSE 0 END AS alpha FROM scored s
  LEFT JOIN ranked k ON k.t = s.t AND k.symbol = s.symbol LEFT JOIN rank_days d ON d.t = s.t WHERE s.member""")
lean("state_moments", "SELECT t, avg(CASE WHEN valid THEN state END) AS m, stddev_pop(CASE WHEN valid THEN state END) AS s FROM buffered GROUP BY t")
lean("buffered_alpha", """SELECT /*+ BROADCAST(d) */ x.t, x.symbol, CAST(x.state AS INT) AS state, CASE WHEN x.valid AND x.n >= 20 AND d.s > 2.220446049250313e-16 THEN round((x.state - d.m) / d.s, 6) ELSE 0 END AS alpha
  FROM buffered x JOIN state_moments d ON d.t = x.t WHERE x.member""")
lean("threshold_sizes", "SELECT t, sum(abs(pos)) AS size FROM threshold_positions GROUP BY t")
lean("threshold_weights", "SELECT /*+ BROADCAST(d) */ p.t, p.symbol, p.r, p.pos, coalesce(p.pos / nullif(d.size, 0), 0) AS w FROM threshold_positions p JOIN threshold_sizes d ON d.t = p.t")
lean("resid", STEPS["resid"].replace("SELECT g.t", "SELECT /*+ SHUFFLE_HASH(r) */ g.t", 1))
lean("banded", STEPS["banded"].replace("SELECT s.t", "SELECT /*+ SHUFFLE_HASH(k) */ s.t", 1))


def _regressed(w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(b, a, r2, vy, vx) of windows of 30 values of a path, regressed on themselves a row before."""
    x, z = w[:, :-1] - w[:, :1], w[:, 1:] - w[:, 1:2]  # from their first values, so what stands still is 0 throughout
    mx, mz = x.mean(axis=1, keepdims=True), z.mean(axis=1, keepdims=True)
    x, z = x - mx, z - mz
    vx, vz, cov = (x * x).mean(axis=1), (z * z).mean(axis=1), (x * z).mean(axis=1)
    with np.errstate(all="ignore"):
        b = cov / vx
        return b, (w[:, 1] + mz[:, 0]) - b * (w[:, 0] + mx[:, 0]), cov * cov / (vx * vz), vz, vx


def _fits(paths: pd.Series) -> pd.DataFrame:
    """Each symbol's path regressed on itself a row before, over 29 rows; nulls where fewer lie before or nothing moves."""
    out = []
    for path in paths:
        y = np.asarray(path, float)
        moments = np.full((5, len(y)), np.nan)
        if len(y) >= 30:
            moments[:, 29:] = _regressed(np.lib.stride_tricks.sliding_window_view(y, 30))
        out.append([[None if v != v else v for v in row] for row in moments.tolist()])
    return pd.DataFrame(out, columns=["b", "a", "r2", "vy", "vx"])


def _held(residuals: pd.Series) -> pd.DataFrame:
    """(nv, pos) of each symbol's residuals as ou_path, ou_fits, ou and ou_pos give them; only windows that are whole are fitted."""
    counts, taken = [], []
    for path in residuals:
        r = np.asarray(path, float)
        there = np.isfinite(r)
        known = np.concatenate((np.zeros(30, int), np.cumsum(there)))
        nv, pos = (known[30:] - known[:-30]).astype(np.int32), np.zeros(len(r), np.int32)
        at = np.flatnonzero(nv == 30)
        if len(at):
            y = np.cumsum(np.where(there, r, 0.0))
            b, a, r2, vy, vx = _regressed(np.lib.stride_tricks.sliding_window_view(y, 30)[at - 29])
            with np.errstate(all="ignore"):
                z = (y[at] - a / (1 - b)) / np.sqrt(vy * (1 - r2) / (1 - b * b))
                good = (vx > 2.220446049250313e-16) & (b > 0) & (b < 1) & (vy * (1 - r2) > 0) & (r2 > 0.25)
            pos[at] = np.where(good & (z > 1.25), -1, np.where(good & (z < -1.25), 1, 0))
        counts.append(nv)
        taken.append(pos)
    return pd.DataFrame({"nv": counts, "pos": taken})


def held_positions(resid: DataFrame) -> DataFrame:
    """(t, symbol, member, r, nv, pos) of resid's rows; a symbol's rows are one list while it is fitted."""
    listed = resid.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("t", "member", "r"))).alias("rows"))
    fitted = listed.withColumn("f", F.pandas_udf(_held, "nv array<int>, pos array<int>")(F.col("rows.r")))
    return fitted.select("symbol", F.inline(F.arrays_zip("rows", F.col("f.nv").alias("nv"), F.col("f.pos").alias("pos")))).select("rows.t", "symbol", "rows.member", "rows.r", F.col("nv").cast("long").alias("nv"), "pos")


def _scores(residuals: pd.Series) -> pd.Series:
    """Each symbol's halo_scores, a row later; only windows of 30 residuals that are there and not zero are fitted."""
    out = []
    for path in residuals:
        r = np.asarray(path, float)
        known = np.concatenate((np.zeros(30, int), np.cumsum(np.isfinite(r) & (r != 0))))
        at = np.flatnonzero(known[30:] - known[:-30] == 30)
        score = np.full(len(r) + 1, np.nan)
        if len(at):
            y = np.cumsum(np.lib.stride_tricks.sliding_window_view(r, 30)[at - 29], axis=1)
            b, a, r2, vy, vx = _regressed(y)
            with np.errstate(all="ignore"):
                s = (a / (1 - b + 1e-6) - y[:, -1]) / np.sqrt(vy * (1 - r2) / np.abs(1 - b * b + 1e-6))
                score[at + 1] = np.where((vx > 0) & (b > 0) & (b < 1) & (r2 > 0.25) & (vy * (1 - r2) > 0), s, np.nan)
        out.append(score[:-1])
    return pd.Series(out)


def threshold_fits(resid: DataFrame) -> DataFrame:
    """(t, symbol, r, score) of resid's rows, the score being that of the row before; NaN where there is none."""
    listed = resid.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("t", "r"))).alias("rows"))
    fitted = listed.withColumn("score", F.pandas_udf(_scores, "array<double>")(F.col("rows.r")))
    return fitted.select("symbol", F.inline(F.arrays_zip("rows", "score"))).select("rows.t", "symbol", "rows.r", F.round(F.nanvl("score", F.lit(None)), 9).alias("score"))


MADE["ou_held"] = ("resid", held_positions)
MADE["threshold_fits"] = ("resid", threshold_fits)
lean("threshold_positions", "SELECT t, symbol, coalesce(r, 0) AS r, CASE WHEN score > 1.25 THEN 1 WHEN score < -1.25 THEN -1 ELSE 0 END AS pos FROM threshold_fits WHERE t >= 134")


def rolling_fits(paths: DataFrame) -> DataFrame:
    """ou_moments of ou_lagged rows; a symbol's rows are one list while it is fitted."""
    listed = paths.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("t", "member", "r", "ret", "nv", "y", F.coalesce("y30", F.lit(0.0)).alias("y0")))).alias("rows"))
    fitted = listed.withColumn("f", F.pandas_udf(_fits, "b array<double>, a array<double>, r2 array<double>, vy array<double>, vx array<double>")(F.col("rows.y")))
    return fitted.select("symbol", F.inline(F.arrays_zip("rows", *[F.col(f"f.{c}").alias(c) for c in ("b", "a", "r2", "vy", "vx")]))).select("symbol", "rows.*", "b", "a", "r2", "vy", "vx")


MADE["ou_fits"] = ("ou_lagged", rolling_fits)
lean("ou_moments", "SELECT t, symbol, member, r, ret, nv, y, y0, b, a, r2, vy, vx FROM ou_fits")
