"""Factor fits read each row of the panel where it lies: no row is dealt or copied per fit."""

from residua import catalog
from residua.operators.factors import _rets, query_composed_alpha
from residua.operators.lowrank import matrices
from residua.plans.relations import relation

SMALLEST = "/root/testdata/sf0.001"


def _dealt(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_matrices_move_no_rows(spark):
    relation(spark, SMALLEST, "panel").count()
    wide = matrices(_rets(spark, SMALLEST))
    assert _dealt(wide) == [] and "Generate" not in wide._jdf.queryExecution().optimizedPlan().toString()
    rows = wide.collect()
    assert sum(len(r.symbols) for r in rows) == catalog.queries()["panel_build"](spark, SMALLEST).select("symbol").distinct().count()


def test_alpha_moves_no_rows(spark):
    plan = query_composed_alpha(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and not [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(t#" in line]
    assert all("symbol" not in line for line in _dealt(query_composed_alpha(spark, SMALLEST)))  # what is dealt is one row a date and task


def test_sums_meet_once_a_core(spark):
    from residua.operators.factors import daily_fits
    from residua.operators.lowrank import FitConfig, plan_of, solutions

    wide = matrices(_rets(spark, SMALLEST)).repartition(50)
    plan = plan_of(daily_fits(_rets(spark, SMALLEST), 104, 52))
    text = solutions(wide, plan, FitConfig())._jdf.queryExecution().executedPlan().toString()
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in text


def test_passes_over_matrices_equal_rows(spark):
    import pytest
    from pyspark.sql import functions as F

    from residua.operators.factors import composed_backtest, daily_fits, daily_residuals, definition_comparison, ou_backtest, positions_of
    from residua.operators.lowrank import FitConfig, plan_of, shared, solutions
    from residua.sources.markets import factor_market

    gone = "(t = 50 OR (symbol IN (SELECT min(symbol) FROM m) AND t IN (33, 34, 70)))"  # a day without returns, and a name that leaves and comes back
    market = factor_market(spark, 100, 8, 2)
    market = spark.sql(f"SELECT t, symbol, CASE WHEN NOT {gone} THEN ret END AS ret FROM {{m}}".replace("FROM m)", "FROM {m})"), m=market).localCheckpoint()
    conf, how = FitConfig(2, 20, 10), {"lookback": 8, "entry": 0.3, "least_fit": 0.1}
    rows = daily_residuals(market, 2, 20, 10, vectors=True).localCheckpoint()
    want = {r.t: r for r in ou_backtest(rows.select("t", "symbol", "residual"), rows.select("t", "symbol", "lead", "loading"), 2, **how).collect()}
    wide = matrices(market.withColumn("member", F.lit(True))).localCheckpoint()
    wide = wide.unionByName(matrices(market.where("false").withColumn("member", F.lit(True))))
    out = composed_backtest(wide, shared(solutions(wide, plan_of(daily_fits(market, 20, 7)), conf)), conf, **how)
    got = {r.t: r for r in out.collect()}
    assert sorted(got) == sorted(want) and 50 not in got and sum(r.turnover > 0 for r in got.values()) > 20
    for t, r in want.items():
        assert tuple(got[t]) == pytest.approx(tuple(r), abs=1e-11)
    residual = {(r.t, r.symbol): r.residual for r in rows.collect()}
    assert len({s for t, s in residual if t == 40}) == 7 and len({s for t, s in residual if t == 99}) == 8
    gain, size = {}, {}
    for r in positions_of(rows, **how).collect():
        if (r.t + 1, r.symbol) in residual:
            gain[r.t] = gain.get(r.t, 0) + r.position * residual[r.t + 1, r.symbol]
            size[r.t] = size.get(r.t, 0) + abs(r.position)
    days = [r for r in definition_comparison(market, 2, 20, 10, 8, 0.3, 0.1, block=7).collect()]
    stitched = {r.t: r for r in days if r.definition == "stitched"}
    assert len(days) == 2 * len(stitched) and sum(size.values()) > 20
    for t, r in stitched.items():
        assert r.positions == size.get(t, 0) and r.ret == pytest.approx(gain[t] / size[t] if size.get(t) else 0, abs=1e-12)


def test_the_backtest_of_compositions_makes_no_row_a_symbol_and_day(spark):
    from residua.operators.factors import query_composed_backtest

    plan = query_composed_backtest(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "residua_daily_fits" not in plan and all("symbol" not in line for line in _dealt(query_composed_backtest(spark, SMALLEST)))
