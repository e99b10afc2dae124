"""Accounts walked on arrays of their names against the same days one by one; the query reads its prices once."""

import numpy as np
import pandas as pd
import pytest

from residua.operators.grouped import Account, Fees, query_execution_ledger, walked


@pytest.mark.parametrize("cash", [2e4, 1e6])
def test_arrays_against_days(cash):
    r = np.random.default_rng(int(cash))
    rows = [(t, f"{j:02d}", float("nan") if r.random() < 0.1 else float(r.integers(0, 30) * 70), float(r.uniform(3, 40)), *(r.random(3) < 0.15)) for t in range(60) for j in range(12)]
    frame = pd.DataFrame(rows, columns=["t", "symbol", "target", "price", "suspended", "at_upper", "at_lower"]).sample(frac=1, random_state=1)
    account, want = Account("a", cash), []
    for t, day in frame.sort_values(["t", "symbol"]).groupby("t"):
        want += account.day(t, day, Fees())
    got = list(zip(*walked("a", frame, cash, Fees())))
    assert got == want and len({x[-1] for x in got}) >= 5
    with pytest.raises(ValueError, match="no price"):
        walked("a", frame[(frame["t"] < 30) | (frame["symbol"] != "03")].assign(suspended=False, at_lower=False), cash, Fees())
    with pytest.raises(ValueError, match="negative"):
        walked("a", frame.assign(target=-1.0), cash, Fees())


def test_prices_are_read_once(spark):
    plan = query_execution_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
