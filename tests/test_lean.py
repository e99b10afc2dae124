"""Steps that Spark runs by a way of its own: rows stay with their symbol, fits of a flat path are null."""

import numpy as np
import pytest

from residua import catalog  # noqa: F401  registers the steps
from residua.operators.signals import held_positions, rolling_fits, threshold_fits
from residua.plans import store
from residua.plans.relations import relation

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, keys", [("ou_lagged", 0), ("alpha", 1), ("long_weights", 3), ("mechanism_lag", 4), ("bt_lag", 1), ("book_moves", 3), ("reversal_sums", 0), ("threshold_weights", 1)])
def test_rows_stay_with_their_symbol(spark, name, keys):
    plan = relation(spark, SMALLEST, name)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("symbol" not in line for line in dealt) and len(dealt) <= keys  # what is dealt is one row a date


def test_kept_tables_go_with_the_folder(spark):
    relation(spark, SMALLEST, "resid").count()
    mine = [v[2] for k, v in store._TABLES.items() if k[1] == SMALLEST and v[2]]
    assert mine and all(spark.catalog.tableExists(t) for t in mine)


def test_fits_against_least_squares(spark):
    r = np.random.default_rng(3)
    paths = {"a": np.cumsum(r.normal(0, 0.02, 45)), "flat": np.full(40, 3.3), "short": np.cumsum(r.normal(0, 1, 20)), "late": np.concatenate((np.full(35, 0.7), [1.1] * 5))}
    rows = [(t, s, True, 0.0, 0.0, 30, float(y[t]), float(y[t - 30]) if t >= 30 else None) for s, y in paths.items() for t in range(len(y))]
    got = {(x.symbol, x.t): x for x in rolling_fits(spark.createDataFrame(rows, "t int, symbol string, member boolean, r double, ret double, nv int, y double, y30 double")).collect()}
    assert len(got) == len(rows)
    for (s, t), x in got.items():
        y = paths[s]
        if t < 29 or s == "flat":
            assert x.b is None or x.vx == 0
            continue
        before, now = y[t - 29 : t], y[t - 28 : t + 1]
        assert x.vy == pytest.approx(now.var(), abs=1e-15) and x.vx == pytest.approx(before.var(), abs=1e-15)
        if min(before.var(), now.var()) > 1e-20:
            b, a = np.polyfit(before, now, 1)
            assert x.b == pytest.approx(b, abs=1e-9) and x.a == pytest.approx(a, abs=1e-9) and x.r2 == pytest.approx(np.corrcoef(before, now)[0, 1] ** 2, abs=1e-9)


@pytest.mark.parametrize("name", ["trail5", "ou_lagged", "bt_base", "history_counts"])
def test_kept_rows_are_not_sorted_again(spark, name):
    plan = relation(spark, SMALLEST, name)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not [line for line in plan.splitlines() if " Sort " in line and "symbol" in line]


def test_month_refits_take_no_window(spark):
    plan = relation(spark, SMALLEST, "residual")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(symbol" not in plan  # a refit is a row of the calendar, not a window along each symbol


@pytest.mark.parametrize("step, made, columns", [("ou_pos", held_positions, ["nv", "pos"]), ("threshold_positions", threshold_fits, ["pos"])])
def test_positions_in_lists_are_those_of_the_steps(spark, step, made, columns):
    """Native regressions over 29 rows took 637 task seconds at six copies of sf0.1, made twice."""
    g = np.random.default_rng(5)
    rows = [(t, f"s{k}", True, None if t < 40 + 9 * k or (k == 3 and t == 300) else 0.0 if k == 4 and g.random() < 0.02 else float(g.normal(0, 0.02))) for k in range(6) for t in range(560)]
    resid = spark.createDataFrame(rows, "t int, symbol string, member boolean, r double")
    plain = relation(spark, SMALLEST, step, resid=resid.selectExpr("*", "r AS ret"))
    want = {(x.symbol, x.t): tuple(x[c] for c in columns) for x in plain.collect()}
    got = made(resid)
    if step == "threshold_positions":
        got = got.where("t >= 134").selectExpr("t", "symbol", "CASE WHEN score > 1.25 THEN 1 WHEN score < -1.25 THEN -1 ELSE 0 END AS pos")
    assert {(x.symbol, x.t): tuple(x[c] for c in columns) for x in got.collect()} == want and {-1, 0, 1} == {v[-1] for v in want.values()}


def test_both_sides_of_a_book_are_one_pass(spark):
    plan = relation(spark, SMALLEST, "pnl")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") <= 3  # one reading of the forward returns, not one for the book and one for the benchmark


def test_the_audit_of_dates_is_one_pass_without_fits(spark):
    from residua.plans.relations import LEAN, STEPS, _needs

    needs = _needs("continuity_audit", [], STEPS | LEAN)
    assert not {"held", "ou", "ou_moments"} & set(needs)  # a whole window of residuals is counted, not fitted
    days = relation(spark, SMALLEST, "continuity_days")
    assert days.count() == relation(spark, SMALLEST, "calendar").count()
    plan = relation(spark, SMALLEST, "continuity_audit")._jdf.queryExecution().optimizedPlan().toString()
    assert "residua_resid" not in plan and "residua_ranked" not in plan  # dates only: no symbol's rows are read again


def test_mechanism_and_backtest_share_their_days(spark):
    scans = relation(spark, SMALLEST, "held_days")._jdf.queryExecution().executedPlan().toString()
    assert scans.count("Scan parquet spark_catalog.default.residua_held") <= 2  # a pass for the sizes of dates, a pass for their sums
    for name in ("mechanism_days", "bt_days"):
        plan = relation(spark, SMALLEST, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "residua_held_" not in plan.replace("residua_held_days", ""), name
    days = {(r.dir, r.t): r for r in relation(spark, SMALLEST, "mechanism_days").collect()}
    assert days and all(days[-d, t].ret == -r.ret and days[-d, t].turnover == r.turnover for (d, t), r in days.items())


@pytest.mark.parametrize("halves", [True, False])
def test_ranks_of_a_date_against_sql(spark, halves):
    """Ties, missing values, values that do not differ and dates of few rows, against the windows of the step's SQL."""
    from residua.operators.evaluation import _LAGS, rank_correlations

    r, lags = np.random.default_rng(6), _LAGS
    value = lambda t, j: None if (t + j) % 9 == 0 else float(r.integers(-3, 4)) if t != 3 else 1.0
    n = {0: 60, 1: 60, 2: 15, 3: 40, 4: 45}
    rows = [(t, f"s{j:03d}", float(r.integers(0, 6)), *[value(t, j + h) for h in lags]) for t in n for j in r.permutation(n[t]).tolist()]
    wide = spark.createDataFrame(rows, "t int, symbol string, a double, " + ", ".join(f"f{h} double" for h in lags))
    wide.createOrReplaceTempView("ranked_rows")
    each = " UNION ALL ".join(f"SELECT {h} AS h, t, symbol, a AS x, f{h} AS y FROM ranked_rows WHERE f{h} IS NOT NULL" for h in lags)
    if halves:
        rank = lambda c: f"rank() OVER (PARTITION BY h, t ORDER BY {c}) + (count(*) OVER (PARTITION BY h, t, {c}) - 1) / 2.0"
    else:
        rank = lambda c: f"row_number() OVER (PARTITION BY h, t ORDER BY {c}, symbol)"
        wide = wide.selectExpr("t", "symbol", *[x for h in lags for x in (f"CASE WHEN f{h} IS NOT NULL THEN a END AS s{h}", f"f{h}")])
    spread = "WHERE sx > 0 AND sy > 0" if halves else ""
    want = spark.sql(f"SELECT h, t, corr(rx, ry) AS ic, count(*) AS n FROM (SELECT h, t, {rank('x')} AS rx, {rank('y')} AS ry, max(x) OVER (PARTITION BY h, t) - min(x) OVER (PARTITION BY h, t) AS sx, max(y) OVER (PARTITION BY h, t) - min(y) OVER (PARTITION BY h, t) AS sy FROM ({each})) {spread} GROUP BY h, t HAVING count(*) >= 20")
    got = {(x.h, x.t): (x.ic, x.n) for x in rank_correlations(wide, halves).collect()}
    want = {(x.h, x.t): (x.ic, x.n) for x in want.collect()}
    assert set(got) == set(want) and (2 not in {t for _, t in got}) and ((1, 3) in got) == (not halves)
    assert all(got[k][1] == n and got[k][0] == pytest.approx(ic, abs=1e-12) for k, (ic, n) in want.items())
    plan = relation(spark, SMALLEST, "ic_days" if halves else "reversal_days")._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan and "row_number(" not in plan


def test_books_are_walked_side_by_side(spark):
    plan = relation(spark, SMALLEST, "direction_facts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6 and "reversed AS who" not in plan  # no row a book
    got, want = relation(spark, SMALLEST, "direction_facts").first(), relation(spark, SMALLEST, "direction_facts", region=spark.read.parquet(f"{SMALLEST}/region.parquet")).first()
    assert all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want.asDict())
