"""Steps against a second derivation: loops in numpy over small panels, not the same text on another engine."""

import numpy as np
import pytest

import residua.catalog  # noqa: F401  registers all steps
from residua.plans.relations import relation

SF = "/root/testdata/sf0.001"


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(11)
    n, days = 26, 60
    residual = r.normal(0, 0.01, (days, n)).round(6)
    residual[r.random((days, n)) < 0.01] = np.nan
    member = np.ones((days, n), bool)
    member[10:30, 3] = member[::7, 5] = False
    member[40:45, 4:] = False  # too few names
    rows = [(t, f"s{i:02d}", bool(member[t, i]), None if np.isnan(residual[t, i]) else float(residual[t, i]), 0.0) for t in range(days) for i in range(n)]
    return residual, member, spark.createDataFrame(rows, "t int, symbol string, member boolean, r double, ret double")


def scores(residual, member, t):
    if t < 4:
        return np.zeros(residual.shape[1], bool), None
    past = residual[t - 4 : t + 1]
    valid = member[t] & np.isfinite(past).all(axis=0)
    return valid, (average_ranks(np.round(-past[:, valid].sum(axis=0), 12)) - 0.5) / max(valid.sum(), 1)


def table(df, *columns):
    return {(x["t"], x["symbol"]): tuple(x[c] for c in columns) for x in df.collect()}


def test_rank_and_buffered_alpha(spark, panel):
    residual, member, frame = panel
    rank, buffered = table(relation(spark, SF, "alpha", resid=frame), "alpha"), table(relation(spark, SF, "buffered_alpha", resid=frame), "alpha", "state")
    state = np.zeros(residual.shape[1], int)
    assert len(rank) == len(buffered) == member.sum()
    for t in range(len(residual)):
        valid, pct = scores(residual, member, t)
        want, held = np.zeros(len(state)), np.zeros(len(state))
        state[~valid] = 0
        if valid.sum() >= 20:
            want[valid] = (pct - 0.5) / pct.std()
            for i, p in zip(np.flatnonzero(valid), pct):
                if state[i] == 1 and p < 0.6 or state[i] == -1 and p > 0.4:
                    state[i] = 0
                if state[i] == 0:
                    state[i] = 1 if p >= 0.8 else -1 if p <= 0.2 else 0
            now = state[valid].astype(float)
            if now.std() > 0:
                held[valid] = (now - now.mean()) / now.std()
        for i in np.flatnonzero(member[t]):
            assert rank[t, f"s{i:02d}"][0] == pytest.approx(want[i], abs=1e-9)
            assert buffered[t, f"s{i:02d}"][0] == pytest.approx(held[i], abs=1e-6) and buffered[t, f"s{i:02d}"][1] == state[i]


def test_alpha_moves_over_shared_members(spark, panel):
    residual, member, frame = panel
    rank = table(relation(spark, SF, "alpha", resid=frame), "alpha")
    got = {x.t: (x.mean_change, x.shared) for x in relation(spark, SF, "alpha_change", resid=frame).collect()}
    for t in range(1, len(residual)):
        both = np.flatnonzero(member[t] & member[t - 1])
        want = np.mean([abs(rank[t, f"s{i:02d}"][0] - rank[t - 1, f"s{i:02d}"][0]) for i in both])
        assert got[t] == (pytest.approx(want, abs=1e-6), len(both))


def test_reversal_days(spark, panel):
    residual, member, frame = panel
    got = {(x.h, x.t): (x.ic, x.n) for x in relation(spark, SF, "reversal_ic", resid=frame).collect()}
    seen = 0
    for h in (1, 5, 10, 20):
        for t in range(h - 1, len(residual) - h):
            past, future = residual[t - h + 1 : t + 1], residual[t + 1 : t + h + 1]
            ok = member[t] & np.isfinite(past).all(axis=0) & np.isfinite(future).all(axis=0)
            if ok.sum() >= 20:
                order = lambda x: np.argsort(np.argsort(np.round(x, 12), kind="stable"))
                want = np.corrcoef(order(-past[:, ok].sum(axis=0)), order(future[:, ok].sum(axis=0)))[0, 1]
                assert got[h, t] == (pytest.approx(want, abs=1e-6), ok.sum())
                seen += 1
    assert seen == len(got) > 50


def test_every_window_has_features(spark, panel):
    residual, _, frame = panel
    frame = frame.where("t < 40")
    got = {}
    for x in relation(spark, SF, "fourier_features", resid=frame).collect():
        got.setdefault((x.t, x.symbol), {})[x.feature] = x.value
    want = {(t, f"s{i:02d}"): np.cumsum(residual[t - 29 : t + 1, i]) for t in range(29, 40) for i in range(residual.shape[1]) if np.isfinite(residual[t - 29 : t + 1, i]).all()}
    assert set(got) == set(want)
    for k, w in want.items():
        f = np.fft.rfft(w)
        assert [got[k][i] for i in range(30)] == pytest.approx([*f.real, *f.imag[1:-1]], abs=2e-6)


def test_threshold_backtest_equals_a_plain_loop(spark):
    r = np.random.default_rng(12)
    days, n = 560, 6  # three blocks of rows
    price = np.zeros((days + 1, n))
    for t in range(days):
        price[t + 1] = 0.8 * price[t] + r.normal(0, 0.01, n)
    residual = np.diff(price, axis=0).round(7)
    residual[r.random((days, n)) < 0.004] = np.nan
    residual[r.random((days, n)) < 0.004] = 0.0
    rows = [(t, f"s{j}", None if np.isnan(residual[t, j]) else float(residual[t, j])) for t in range(days) for j in range(n)]
    got = {x.t: x for x in relation(spark, SF, "threshold_backtest", resid=spark.createDataFrame(rows, "t int, symbol string, r double")).collect()}
    before, traded = np.zeros(n), 0
    assert sorted(got) == list(range(134, days))
    for t in range(134, days):
        p = np.zeros(n)
        for j in range(n):
            h = residual[t - 30 : t, j]
            if np.isfinite(h).all() and (h != 0).all():
                y = np.cumsum(h)
                b, a = np.polyfit(y[:-1], y[1:], 1)
                noise, fit = (y[1:] - a - b * y[:-1]).var(), np.corrcoef(y[:-1], y[1:])[0, 1] ** 2
                if 0 < b < 1 and fit > 0.25 and noise > 0:
                    z = (a / (1 - b + 1e-6) - y[-1]) / np.sqrt(noise / abs(1 - b * b + 1e-6))
                    p[j] = 1 if z > 1.25 else -1 if z < -1.25 else 0
        w = p / np.abs(p).sum() if p.any() else p
        x = got[t]
        turnover, short, gross = np.abs(w - before).sum(), np.maximum(-w, 0).sum(), w @ np.nan_to_num(residual[t])
        assert (x.gross, x.turnover, x.short_share, x.net) == pytest.approx((gross, turnover, short, gross - 0.0005 * turnover - 0.0001 * short), abs=2e-9) and x.active == np.abs(p).sum()
        before, traded = w, traded + x.active
    assert traded > 50


def test_daily_residuals_equal_a_plain_loop(spark):
    from residua.operators.grouped import factor_map
    from residua.operators.factors import comparison_summary, daily_residuals, definition_comparison, ou_backtest, ou_stock_alpha, positions_of
    from residua.sources.markets import factor_market

    market = factor_market(spark, 90, 8, 2)
    wide = market.toPandas().pivot(index="t", columns="symbol", values="ret").to_numpy()
    rows = daily_residuals(market, 2, 40, 20, block=7, vectors=True).collect()
    got = {(x.t, x.symbol): x for x in rows}
    names = sorted({x.symbol for x in rows})
    assert len(got) == len(rows) == 50 * 8
    maps = {t: np.eye(8) - np.array([got[t, s].loading for s in names]) @ np.array([got[t, s].lead for s in names]).T for t in range(40, 90)}
    for t in (40, 63, 89):
        past = wide[t - 40 : t]
        z = (past - past.mean(axis=0)) / past.std(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z)
        lead = vectors[:, ::-1][:, :2]
        loads = np.linalg.lstsq((past[-20:] / past.std(axis=0)) @ lead, past[-20:], rcond=None)[0]
        want = wide[t] - (wide[t] / past.std(axis=0)) @ lead @ loads
        for i in range(8):
            x = got[t, names[i]]
            assert x.residual == pytest.approx(want[i], abs=1e-12) and x.explained == pytest.approx(values[::-1][:2].sum() / values.sum())
        assert maps[t] @ wide[t] == pytest.approx(want, abs=1e-12) and maps[t] == pytest.approx(factor_map(past, 2, 20), abs=1e-9)
    res = spark.createDataFrame([(x.t, x.symbol, x.residual) for x in rows], "t int, symbol string, residual double")
    phi = spark.createDataFrame([(x.t, x.symbol, x.lead, x.loading) for x in rows], "t int, symbol string, lead array<double>, loading array<double>")
    pos = positions_of(res, lookback=20, entry=0.5, least_fit=0.1)
    alpha = table(ou_stock_alpha(pos, phi, market.where("t >= 40"), 2), "alpha")
    by_day = {}
    for (t, s), (p,) in table(pos, "position").items():
        by_day.setdefault(t, {})[s] = p
    assert sum(any(v.values()) for v in by_day.values()) > 5
    for t, p in by_day.items():
        w = np.array([p.get(s, 0) for s in names]) @ maps[t]
        want = (w - w.mean()) / w.std() if w.std() > 0 else np.zeros(8)
        assert [alpha[t, s][0] for s in names] == pytest.approx(want.tolist(), abs=1e-9)
    days = {x.t: x for x in ou_backtest(res, phi, 2, lookback=20, entry=0.5, least_fit=0.1).collect()}
    for t in range(60, 89):
        p = {s: by_day.get(t - 1, {}).get(s, 0) for s in names}
        w = np.array([p.get(s, 0) for s in names]) @ maps[t]
        size = np.abs(w).sum()
        assert days[t].gross == pytest.approx(sum(v * got[t, s].residual for s, v in p.items()) / size if size else 0, abs=1e-12)
        assert days[t].short_share == pytest.approx(np.maximum(-w, 0).sum() / size if size else 0, abs=1e-12)
    out = comparison_summary(definition_comparison(market, 2, 40, 20, 20, 0.5, 0.1, block=7)).first()
    assert out.stitched_days == out.current_days == 90 - 40 - 19 - 1


def test_backtest_accounts_for_every_day(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from residua.operators.backtest import Scenario, fill, long_only_backtest, turnover_summary
    from residua.operators.portfolio import Infeasible, PortfolioLimits, optimal_weights
    from residua.sources.markets import index_panel

    assert fill(np.array([0.5, 0.3, 0.0]), np.array([0.1, 0.3, 0.6]), np.array([True] * 3), np.array([False, True, True])).tolist() == pytest.approx([0.5, 0.3, 0.2])
    assert fill(np.array([0.5, 0.5]), np.array([0.2, 0.9]), np.array([True, True]), np.array([True, True])).tolist() == pytest.approx([0.2, 0.8])
    panel = index_panel(spark, 75, 80)
    w = "PARTITION BY symbol ORDER BY d"
    panel = panel.selectExpr("*", f"row_number() OVER ({w}) - 1 AS t", f"adjusted_close / lag(adjusted_close) OVER ({w}) - 1 AS ret", "open_price AS adj_open", "0.0D AS alpha_rank")
    tight = Scenario(sign=0.0, limits=PortfolioLimits(tracking_error=0.3))
    days = long_only_backtest(panel, {"neutral": tight, "rare": replace(tight, interval=5)}).toPandas().sort_values(["scenario", "t"])
    assert set(days["scenario"]) == {"neutral", "rare"} and days.groupby("scenario").size().tolist() == [13, 13]
    neutral = days[days["scenario"] == "neutral"]
    # without a signal the book is the benchmark: it pays only to undo the drift
    assert (neutral["strategy"] + neutral["cost"] - neutral["bench"]).abs().max() < 2e-4 and neutral["cost"].max() < 1e-3 and neutral["turnover"].max() < 0.2
    assert days[days["scenario"] == "rare"]["decided"].sum() == 3 and turnover_summary(spark.createDataFrame(days)).where("scenario = 'rare'").first().decisions == 3
    st = panel.withColumn("is_st", F.col("symbol") == "600003")
    after = long_only_backtest(st, {"x": replace(tight, forced=True)}).orderBy("t").first()
    assert after.names == 79 and after.limit_turnover > 0.2  # the marked name is sold at once
    with pytest.raises(Exception, match="nfeasible|sum of"):
        long_only_backtest(st, {"x": replace(tight, limits=PortfolioLimits(cap=0.001))}).collect()
    n, r = 30, np.random.default_rng(0)
    groups = (np.arange(n) % 3 == np.arange(3)[:, None]).astype(float)
    bench = np.full(n, 0.99 / n)
    args = r.normal(0, 0.01, n), bench, bench, np.eye(n) * 1e-4, PortfolioLimits(cap=0.1)
    free, bound = optimal_weights(*args), optimal_weights(*args, bands=(groups, 0.01))
    assert np.abs(groups @ (free - bench)).max() > 0.011 > 0.0101 > np.abs(groups @ (bound - bench)).max()
    with pytest.raises(Infeasible):
        optimal_weights(*args[:4], PortfolioLimits(cap=0.001))


def test_allocation_gradients_and_origins(spark):
    from dataclasses import replace

    from residua.operators import neural as N

    r = np.random.default_rng(3)
    scores, returns = r.normal(size=(6, 4)), r.normal(0, 0.01, (6, 4))
    loss, d = N.score_gradient(scores, returns, 0.001, 0.0005)
    for at in [(0, 0), (3, 2), (5, 3)]:
        up, down = scores.copy(), scores.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        f = lambda s: N.negative_sharpe(N.portfolio(s, returns, 0.001, 0.0005)["returns"])
        assert d[at] == pytest.approx((f(up) - f(down)) / 2e-6, rel=1e-4, abs=1e-7)
    p = N.portfolio(np.array([[1.0, -2.0], [0.5, 0.25]]), np.zeros((2, 2)))
    assert np.abs(p["weights"]).sum(axis=1).tolist() == [1, 1] and p["turnover"][0] == 1 and p["short"].tolist() == pytest.approx([2 / 3, 0])
    for kind in ("relu", "sigmoid"):
        conf = N.Allocation(dropout=0.0, activation=kind, hidden=(5, 3))
        net, x, target = N.Network(30, conf), r.normal(size=(7, 30)), r.normal(size=7)
        grads = net.gradients((net.forward(x), target)[1])
        for k in range(len(net.params)):
            place = tuple(0 for _ in net.params[k].shape)
            kept = net.params[k][place]
            values = []
            for e in (1e-6, -1e-6):
                net.params[k][place] = kept + e
                values.append((net.forward(x) * target).sum())
            net.params[k][place] = kept
            assert grads[k][place] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-4, abs=1e-7)
    x, valid = N.windows_of(r.normal(size=(40, 3)), 30, "fourier")
    assert x.shape == (10, 3, 30) and valid.all()
    rows = [(t, f"s{i}", float(v)) for i in range(5) for t, v in enumerate(r.normal(0, 0.01, 170))]
    frame = spark.createDataFrame(rows, "t int, symbol string, residual double")
    out = N.rolling_allocation(frame, N.Allocation(epochs=2), 100, 35).toPandas()
    assert sorted(out["origin"].unique()) == [100, 135] and len(out) == 70 and out["t"].is_unique
    # what comes after an origin's own days does not change them
    other = spark.createDataFrame([(t, s, v if t < 135 else -v) for t, s, v in rows], "t int, symbol string, residual double")
    again = N.rolling_allocation(other, N.Allocation(epochs=2), 100, 35, max_retrains=1).toPandas()
    first = out[out["origin"] == 100]
    assert again.sort_values("t")["ret"].tolist() == pytest.approx(first.sort_values("t")["ret"].tolist())
    with pytest.raises(ValueError):
        replace(conf, activation="tanh")


def test_panels_reports_and_providers(spark, tmp_path):
    import datetime as dt

    import pandas as pd

    from residua.sources import markets, panels as S
    from residua.sources import reports as R

    panel = markets.index_panel(spark, 10, 70)
    made = S.save_panel(panel, f"file://{tmp_path}/p", {"by": "test"})
    back = S.load_panel(spark, f"file://{tmp_path}/p")
    assert back.count() == 700 and S.fingerprint(back.orderBy("symbol")) == made["audit"]["fingerprint"] and made["audit"]["trading_days"] == 10
    changed = panel.withColumn("volume", panel.volume + 1)
    assert S.fingerprint(changed) != made["audit"]["fingerprint"] and S.sealed(panel) is panel
    with pytest.raises(ValueError, match="sealed"):
        S.sealed(panel, dt.date(2018, 1, 5))
    with pytest.raises(ValueError, match="one row"):
        S.save_panel(panel.unionAll(panel), f"file://{tmp_path}/q")
    wide = {c: panel.toPandas().pivot(index="d", columns="symbol", values=c).to_numpy() for c in S.FIELDS}
    (tmp_path / "npz").mkdir()
    np.savez_compressed(tmp_path / "npz" / "a.npz", dates=np.array(sorted(panel.toPandas()["d"].unique()), "datetime64[D]"), symbols=np.array([f"{600000 + i:06d}" for i in range(70)]), **wide)
    assert S.fingerprint(S.load_arrays(spark, f"file://{tmp_path}/npz")) == made["audit"]["fingerprint"]

    class Cursor:
        error_code, error_msg, fields = "0", "", ["date", "code", "close"]

        def __init__(self, rows):
            self.rows = rows

        def next(self):
            self.row = self.rows.pop(0) if self.rows else None
            return self.row is not None

        def get_row_data(self):
            return self.row

    assert S.drain(Cursor([["2020-01-02", "a", "1.5"]]), "history").shape[0] == 1
    failing = Cursor([])
    failing.error_code = "10002"
    with pytest.raises(S.ProviderError):
        S.drain(failing, "login")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Über")
    assert R.load_documents(spark, f"file://{tmp_path}/docs").first().text == "# Über"
    (tmp_path / "docs" / "b.docx").write_bytes(b"x")
    with pytest.raises(ValueError, match="neither"):
        R.load_documents(spark, f"file://{tmp_path}/docs")
    small = spark.createDataFrame(pd.DataFrame({"a": [1, 2], "b": ["x|y", None]}))
    assert R.markdown_table(small, "T").splitlines()[4:] == ["| 1 | x\\|y |", "| 2 |  |"]
    R.write_json(small, f"file://{tmp_path}/r.json")
    assert '"b": "x|y"' in R.read_text(spark, f"file://{tmp_path}/r.json")
    runs = []

    def run(origins):
        runs.extend(origins)
        return spark.createDataFrame([(o, o * 2) for o in origins], "origin int, v int")

    for origins in ([1, 2], [1, 2, 3]):
        assert sorted(x.v for x in R.resumed(spark, f"file://{tmp_path}/runs", {"k": 1}, origins, run).collect()) == [2 * o for o in origins]
    assert runs == [1, 2, 3]
    with pytest.raises(ValueError, match="another"):
        R.resumed(spark, f"file://{tmp_path}/runs", {"k": 2}, [1], run)
