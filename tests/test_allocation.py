"""Training in passes over blocks of symbols against one matrix an origin; no day's rows are copied per origin."""

import numpy as np
import pytest

from residua.operators.neural import Allocation, allocation_of, blocks_of, evaluate_window, fit_window

CASES = {
    "plain": {"epochs": 2},
    "batches and costs": {"epochs": 2, "batch": 9, "cost": 0.001, "short_cost": 0.0005, "features": "cumsum"},
    "stocks": {"epochs": 2, "cost": 0.001, "short_cost": 0.0005},
    "attention": {"epochs": 1, "model": "attention", "features": "cumsum", "filters": 4, "heads": 2, "units": 5},
}


@pytest.mark.parametrize("case", CASES)
def test_blocks_give_what_one_matrix_gives(spark, case):
    r, days, names, train, test = np.random.default_rng(4), 75, 11, 40, 15
    conf = Allocation(lookback=8, chunk=50, **CASES[case])
    ret = r.normal(0, 0.01, (days, names))
    ret[:30, 3] = np.nan  # too few values in the first training window
    ret[:, 5] = 0.0
    ret[r.random(ret.shape) < 0.02] = np.nan
    maps = r.normal(0, 0.3, (2, days, names, 2))
    cells = [(t, f"s{j:02d}", float(ret[t, j]), *([m[t, j].tolist() for m in maps] if case == "stocks" else [])) for t in range(days) for j in range(names) if np.isfinite(ret[t, j])]
    frame = spark.createDataFrame(cells, "t int, symbol string, residual double" + (", lead array<double>, loading array<double>" if case == "stocks" else ""))
    blocks = blocks_of(frame, 3).cache()
    assert blocks.count() > 2 and blocks.agg({"symbols": "sum"}).first()[0] == names
    got = {(x.origin, x.t): (x.ret, x.turnover, x.short_share, x.loss) for x in allocation_of(blocks, conf, train, test).collect()}
    wanted = {}
    for o in range(train, days, test):
        some = np.nansum(np.where(np.isfinite(ret[o - train : o]), ret[o - train : o] != 0, 0), axis=0) >= conf.lookback
        x, m = ret[o - train : min(o + test, days), some], None
        if case == "stocks":
            m = tuple(np.where(np.isfinite(ret)[..., None], y, 0)[o - train : min(o + test, days), some] for y in maps)
        net, losses = fit_window(x[:train], conf, m and tuple(y[:train] for y in m))
        out = evaluate_window(net, x[train - 8 :], conf, m and tuple(y[train - 8 :] for y in m))
        wanted |= {(o, o + k): (out["returns"][k], out["turnover"][k], out["short"][k], losses[-1]) for k in range(len(out["returns"]))}
    assert set(got) == set(wanted) and len(got) == 35
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


def test_tasks_without_blocks(spark):
    r = np.random.default_rng(1)
    frame = spark.createDataFrame([(t, f"s{j}", float(r.normal(0, 0.01))) for t in range(30) for j in range(4)], "t int, symbol string, residual double")
    got = allocation_of(blocks_of(frame).repartition(6), Allocation(lookback=5, epochs=1), 20, 10).collect()
    assert len(got) == 10


def test_no_row_is_copied_per_origin(spark):
    from residua import catalog

    stored = catalog.queries()["rolling_allocation"](spark, "/root/testdata/sf0.001")
    assert stored.count() > 0
    from residua.plans import store

    [where] = [v[0] for k, v in store._TABLES.items() if k[1] == "/root/testdata/sf0.001" and k[3] == "resid_blocks"]
    assert sum(x.symbols for x in spark.read.parquet(where).collect()) == catalog.queries()["residuals_k0"](spark, "/root/testdata/sf0.001").select("symbol").distinct().count()
