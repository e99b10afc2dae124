import numpy as np

from residua.operators.factors import monthly_residuals, monthly_stock_alpha
from residua.operators.grouped import chunk_documents, execution_ledger, factor_map, ledger_totals
from residua.sources.arrays import read_array
from residua.streaming.bars import event_bars


def test_factor_map_removes_a_common_factor():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 1)) @ r.normal(1, 0.2, size=(1, 12)) + 0.01 * r.normal(size=(200, 12))
    assert np.allclose(factor_map(x, 0, 50), np.eye(12))
    assert (x @ factor_map(x, 1, 60).T).std() < 0.1 * x.std()


def panel(spark, late=0.0):
    r = np.random.default_rng(1)
    rows = [(t, t // 4, f"s{j:02d}", True, float(r.normal()) + (late if t >= 36 else 0.0) * j) for t in range(44) for j in range(8)]
    return spark.createDataFrame(rows, "t int, mi int, symbol string, member boolean, ret double")


def test_residuals_do_not_look_ahead(spark):
    a, b = ({(x.t, x.symbol): x.residual for x in monthly_residuals(panel(spark, late), 2, 20, 10).collect()} for late in (0.0, 5.0))
    past = [k for k in a if k[0] < 36]
    assert past and all(abs(a[k] - b[k]) < 1e-12 for k in past) and any(abs(a[k] - b[k]) > 1e-6 for k in a if k[0] >= 36)


def test_monthly_maps_and_alpha_equal_a_plain_loop(spark):
    r = np.random.default_rng(8)
    days, n, window, loads, look = 72, 9, 30, 15, 12
    ret = np.cumsum(r.normal(size=(days, 2)), axis=0) @ r.normal(size=(2, n)) * 0.01 + np.diff(r.normal(size=(days + 1, n)), axis=0)
    member = np.ones((days, n), bool)
    member[48:, 2] = member[:40, 5] = False
    ret[50, 7] = ret[10, 8] = np.nan  # a mapped return is missing on day 50; name 8 has no whole history at first
    rows = [(t, t // 9, f"s{j}", bool(member[t, j]), None if np.isnan(ret[t, j]) else float(ret[t, j])) for t in range(days) for j in range(n)]
    fitted = monthly_residuals(spark.createDataFrame(rows, "t int, mi int, symbol string, member boolean, ret double"), 2, window, loads, vectors=True).cache()
    got = {(x.t, x.symbol): x.residual for x in fitted.collect()}
    alpha = {(x.t, x.symbol): x.alpha for x in monthly_stock_alpha(fitted, 2, look, 0.5, 0.05).collect()}
    want, scores, names, phi, active = np.full((days, n), np.nan), {}, [], None, 0
    for t in range(window, days):
        if t == window or t % 9 == 0:
            past = ret[t - window : t]
            names = [j for j in range(n) if member[t, j] and np.isfinite(past[:, j]).all()]
            phi = factor_map(past[:, names], 2, loads)
        if not np.isfinite(ret[t, names]).all():
            continue
        want[t, names] = phi @ ret[t, names]
        p = np.zeros(len(names))
        for k, j in enumerate(names):
            h = want[t - look + 1 : t + 1, j]
            if t - look + 1 >= window and np.isfinite(h).all():
                y = np.cumsum(h)
                b, a = np.polyfit(y[:-1], y[1:], 1)
                fit = np.corrcoef(y[:-1], y[1:])[0, 1] ** 2
                noise = y[1:].var() * (1 - fit)
                if 0 < b < 1 and noise > 0 and fit > 0.05:
                    z = (y[-1] - a / (1 - b)) / np.sqrt(noise / (1 - b * b))
                    p[k] = -1 if z > 0.5 else 1 if z < -0.5 else 0
        mapped = p @ phi
        active += mapped.std() > 0
        for k, j in enumerate(names):
            scores[t, f"s{j}"] = (mapped[k] - mapped.mean()) / mapped.std() if mapped.std() > 0 else 0.0
    assert active > 10 and set(got) == set(alpha) == set(scores) and not any(t == 50 for t, _ in got)
    assert all(abs(got[t, s] - want[t, int(s[1:])]) < 1e-9 for t, s in got)
    assert all(abs(alpha[k] - scores[k]) < 1e-7 for k in scores)


def test_ledger_rules(spark):
    cols = "portfolio string, t int, symbol string, target long, price double, suspended boolean, at_upper boolean, at_lower boolean"
    rows = [
        ("p", 0, "A", 1000, 10.0, False, False, False), ("p", 0, "B", 150, 10.0, False, False, False), ("p", 0, "C", 100, 10.0, True, False, False), ("p", 0, "D", 100, 10.0, False, True, False),
        ("p", 1, "A", 0, 10.0, False, False, True), ("p", 1, "B", 100, 10.0, False, False, False), ("p", 2, "A", 0, 10.0, False, False, False), ("p", 2, "Z", 10**6, 10.0, False, False, False), ("p", 2, "B", None, 10.0, False, False, False),
    ]
    got = {(x.t, x.symbol): x for x in execution_ledger(spark.createDataFrame(rows, cols)).collect()}
    assert got[0, "A"].filled == 1000 and got[0, "A"].fees == 5.0 + 0.1
    assert (got[0, "B"].filled, got[0, "B"].reason) == (100, "lot_rounding")
    assert (got[0, "C"].reason, got[0, "D"].reason, got[1, "A"].reason, got[2, "Z"].reason) == ("suspended", "upper_limit", "lower_limit", "insufficient_cash")
    assert got[2, "A"].filled == 1000 and (1, "B") not in got and (got[2, "B"].side, got[2, "B"].filled) == ("sell", 100)  # held, no target
    total = ledger_totals(execution_ledger(spark.createDataFrame(rows, cols))).first()
    assert total.rejected_shares == sum(x.requested - x.filled for x in got.values()) and abs(total.total_fees - sum(x.fees for x in got.values())) < 1e-6
    # a purchase that costs all the cash to the last cent is affordable
    exact = execution_ledger(spark.createDataFrame([("q", 0, "A", 1000, 10.0, False, False, False)], cols), cash=1000 * 10.0 + 5.0 + 0.1).first()
    assert exact.filled == 1000


def test_chunks_cover_the_text(spark):
    text = "  \n" + ("A sentence of some words.  \r\n" * 20) + "\n\n" + "Another one. " * 60 + "tail " * 300
    got = chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string"), 500, 80).collect()
    mine = sorted((x for x in got if x.doc_id == 1), key=lambda x: x.chunk)
    whole = "\n".join(line.rstrip() for line in text.splitlines()).strip()
    assert [x.text for x in mine] == [whole[x.start_char : x.end_char].strip() for x in mine] and all(x.text for x in mine)
    assert mine[0].start_char == 0 and mine[-1].end_char == len(whole) and all(a.end_char >= b.start_char > a.start_char for a, b in zip(mine, mine[1:]))
    for x in mine[:-1]:  # ends behind a break past its half, where there is one
        breaks = [i for i in range(x.start_char + 251, x.start_char + 500) if whole[i : i + 2] in ("\n\n", ". ") and i + 2 <= x.start_char + 500]
        assert x.end_char == (breaks[-1] + 1 if breaks else x.start_char + 500)
        assert whole[x.end_char - 80 : mine[x.chunk + 1].start_char].strip().count(" ") == 0
    assert [x.text for x in got if x.doc_id == 3] == ["short"]


def test_arrays_and_bars(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[0.0, 1.5], [np.nan, -2.0]]))
    assert {(x.t, x.asset, x.residual) for x in read_array(spark, f"file://{tmp_path}").collect()} == {(0, 1, 1.5), (1, 1, -2.0)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(x.n for x in event_bars(events).collect()) == events.count()
