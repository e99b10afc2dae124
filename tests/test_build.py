"""Panels from provider tables against pandas, the session, and the cache of bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.sources.build import BAR_FIELDS, FreeProvider, LicensedProvider, cached_bars, cents_limit, month_ends_before, panel_from_bars, panel_from_tables
from residua.sources.panels import ProviderError

START = dt.date(2020, 8, 3)


def market(seed=1, n=5):
    r = np.random.default_rng(seed)
    days = pd.bdate_range("2020-06-01", "2020-09-30")
    names = ["sh.600001", "sh.688002", "sz.300003", "bj.830004", "sz.000005"][:n]
    rows = []
    for s in names:
        price = 10.0
        for i, d in enumerate(days):
            before, price = price, round(price * (1 + r.normal(0, 0.02)), 2)
            if s == "sz.000005" and i < 50 or r.random() < 0.04:
                continue  # no bar
            traded = r.random() > 0.05
            volume, turn = int(r.integers(1, 90)) * 1000, r.integers(0, 4) / 2
            rows.append((s, i, str(d.date()), s, str(before), "", "", str(price), f"{before:.2f}", str(volume) if traded else "", str(volume * price) if traded else "", "3", str(turn) if traded else "", "1" if traded else "0", f"{100 * (price / before - 1):.6f}", "1" if s == "sh.600001" and 60 < i < 70 else "0"))
    bars = pd.DataFrame(rows, columns=["symbol", "ordinal", *BAR_FIELDS.split(",")])
    again = bars.iloc[[7, 150]].assign(ordinal=10**6, close="99.99")  # a corrected bar comes last
    members = [(a, s) for a, left in (("2020-07-31", "sz.300003"), ("2020-08-31", "bj.830004")) for s in names if s != left]
    return days, pd.concat([bars, again]), members


def test_free_panel(spark):
    days, bars, members = market()
    calendar = spark.createDataFrame([(d.date(),) for d in days], "d date")
    frame = spark.createDataFrame(bars)
    got = panel_from_bars(frame, calendar, spark.createDataFrame(members, "as_of string, symbol string"), START).toPandas().set_index(["symbol", "d"]).sort_index()
    inside, caps = [d for d in days if d.date() >= START], {}
    assert len(got) == 5 * len(inside)
    for s, own in bars.groupby("symbol"):
        own = own.assign(d=pd.to_datetime(own["date"])).drop_duplicates("d", keep="last").set_index("d")
        num = own[["open", "close", "preclose", "volume", "amount", "turn", "tradestatus", "pctChg", "isST"]].apply(pd.to_numeric, errors="coerce").reindex(days)
        late, mine = num.loc[inside], got.loc[s]
        near = lambda c, want: np.testing.assert_allclose(mine[c].to_numpy(float), np.asarray(want, float), rtol=1e-9)  # noqa: B023,E731
        near("close_price", late["close"].ffill())
        near("open_price", late["open"].ffill())
        near("volume", late["volume"].fillna(0))
        near("money", late["amount"].fillna(0))
        st = late["isST"].ffill().fillna(0).to_numpy() == 1
        assert list(mine["is_st"]) == list(st) and list(mine["paused"]) == list(late["tradestatus"].fillna(0) != 1)
        index, seen = (1 + num["pctChg"].fillna(0) / 100).cumprod(), np.flatnonzero(num["close"].notna())
        index.iloc[: seen[0]] = index.iloc[seen[-1] + 1 :] = np.nan
        near("adjusted_close", index.loc[inside])
        before = late["preclose"].ffill()
        for d, b, flag in zip(inside, before, st):
            p = 30 if s[:2] == "bj" else 20 if s[:6] == "sh.688" or (s[:6] == "sz.300" and d >= pd.Timestamp("2020-08-24")) else 5 if flag else 10
            if not np.isnan(b):
                cents = round(b * 100)
                assert (mine.loc[d.date(), "high_limit"], mine.loc[d.date(), "low_limit"]) == ((cents * (100 + p) + 50) // 100 / 100, (cents * (100 - p) + 50) // 100 / 100)
        shares = (num["volume"] / (num["turn"] / 100)).where(num["turn"] > 0).ffill(limit=120)
        caps[s] = num["close"].ffill() * shares
    for as_of, month in (("2020-07-31", "2020-08"), ("2020-08-31", "2020-09")):
        names = [s for a, s in members if a == as_of]
        value = np.array([caps[s].get(pd.Timestamp(as_of), np.nan) for s in names])
        good = np.isfinite(value) & (value > 0)
        value[~good] = np.median(value[good])
        for s, w in zip(names, value / value.sum()):
            rows = got.loc[s][[str(d)[:7] == month for d in got.loc[s].index]]
            assert rows["member"].all() and np.allclose(rows["benchmark_weight"], w)
    assert not got.loc["sz.300003"].iloc[0]["member"] and got["is_st"].any()


def test_limits_are_exact_at_half_cents(spark):
    prices = [c / 100 for c in range(5, 4000, 5)]
    rows = spark.createDataFrame([(p,) for p in prices], "p double").select("p", *[cents_limit(F.col("p"), F.lit(k)).alias(f"l{k + 30}") for k in (-10, 5, 10)]).collect()
    for r in rows:
        c = round(r.p * 100)
        assert [r.l20, r.l35, r.l40] == [(c * (100 + k) + 50) // 100 / 100 for k in (-10, 5, 10)]


def test_refusals_and_small_universe(spark):
    days, bars, members = market()
    calendar = spark.createDataFrame([(d.date(),) for d in days], "d date")
    with pytest.raises(ValueError, match="at least 67"):
        panel_from_bars(None, calendar, None, START, max_symbols=20)
    with pytest.raises(ValueError, match="no day before"):
        month_ends_before(calendar, days[0].date())
    equal = panel_from_bars(spark.createDataFrame(bars), calendar, spark.createDataFrame(members, "as_of string, symbol string"), START, max_symbols=67)
    assert {round(x.benchmark_weight, 9) for x in equal.where("member").select("benchmark_weight").distinct().collect()} == {0.25}


def test_licensed_panel(spark):
    days = [dt.date(2021, 1, 29), dt.date(2021, 2, 1), dt.date(2021, 2, 26), dt.date(2021, 3, 1)]
    calendar = spark.createDataFrame([(d,) for d in days], "d date")
    raw = spark.createDataFrame([(s, d, 1.0, 2.0, 3.0, 4.0, 2.2, 1.8, 0.0) for s in "AB" for d in days if (s, d) != ("B", days[2])], "symbol string, d date, open double, close double, volume double, money double, high_limit double, low_limit double, paused double")
    adjusted = spark.createDataFrame([("A", d, 20.0 + i) for i, d in enumerate(days)], "symbol string, d date, close double")
    st = spark.createDataFrame([("A", days[3], True)], "symbol string, d date, is_st boolean")
    weights = spark.createDataFrame([("2021-01-29", "A", 3.0), ("2021-01-29", "B", 1.0), ("2021-01-29", "C", 0.0), ("2021-02-26", "A", 5.0)], "as_of string, symbol string, weight double")
    got = {(x.symbol, x.d): x for x in panel_from_tables(raw, adjusted, st, calendar, weights, dt.date(2021, 2, 1)).collect()}
    assert len(got) == 6 and (got["A", days[1]].benchmark_weight, got["B", days[1]].benchmark_weight, got["A", days[3]].benchmark_weight) == (0.75, 0.25, 1.0)
    assert not got["B", days[3]].member and got["B", days[2]].paused and got["B", days[2]].close_price is None and got["A", days[3]].is_st and got["A", days[2]].adjusted_close == 22.0
    with pytest.raises(ValueError, match="2021-03"):
        panel_from_tables(raw, adjusted, st, calendar, weights.where("as_of < '2021-02-01'"), dt.date(2021, 2, 1))


class Cursor:
    def __init__(self, fields=(), rows=(), code="0"):
        self.fields, self.rows, self.error_code, self.error_msg, self.at = list(fields), list(rows), code, "refused", -1

    def next(self):
        self.at += 1
        return self.at < len(self.rows)

    def get_row_data(self):
        return self.rows[self.at]


class Client:
    def __init__(self, code="0"):
        self.code, self.calls = code, []

    def login(self):
        return Cursor(code=self.code)

    def logout(self):
        self.calls.append("logout")

    def query_trade_dates(self, start_date, end_date):
        return Cursor(["calendar_date", "is_trading_day"], [["2020-01-03", "1"], ["2020-01-04", "0"], ["2020-01-02", "1"]])

    def query_zz500_stocks(self, date):
        return Cursor(["code"], [["sz.2"], ["sh.1"]] if date else [])

    def query_history_k_data_plus(self, symbol, fields, start_date, end_date, frequency, adjustflag):
        self.calls.append((symbol, adjustflag))
        return Cursor(["date", "code", "close"], [] if symbol == "sz.9" else [["2020-01-02", symbol, "1.5"], ["2020-01-02", symbol, ""]])


def test_session_and_cache(spark, tmp_path):
    client = Client()
    with FreeProvider(client) as p:
        assert p.calendar("a", "b") == ["2020-01-02", "2020-01-03"] and p.members("2020-01-02") == ["sh.1", "sz.2"]
        with pytest.raises(ProviderError, match="none on"):
            p.members("")
        with pytest.raises(ValueError, match="one of"):
            p.history("sh.1", "a", "b", "other")
        ask = lambda symbols: cached_bars(spark, f"file://{tmp_path}/cache", symbols, "2020-01-01", "2020-01-31", lambda s: p.history(s, "2020-01-01", "2020-01-31"), block=2)
        got = ask(["sh.1", "sz.2", "sz.9"])
        assert {(x.symbol, x.ordinal, x.close) for x in got.collect()} == {(s, i, c) for s in ("sh.1", "sz.2") for i, c in ((0, "1.5"), (1, ""))}
        before = len(client.calls)
        assert ask(["sz.9", "sz.2", "sh.7"]).count() == 4 and client.calls[before:] == [("sh.7", "3")]
    assert client.calls[-1] == "logout"
    with pytest.raises(ProviderError, match="no session"):
        p.calendar("a", "b")
    with pytest.raises(ProviderError, match="login"), FreeProvider(Client("7")):
        pass


def test_licensed_provider():
    class Licensed:
        def auth(self, user, password):
            self.known = password == "right"

        def is_auth(self):
            return self.known

        def get_trade_days(self, start_date, end_date):
            return [dt.date(2021, 1, 5), dt.date(2021, 1, 4)]

        def get_index_weights(self, index, date):
            return pd.DataFrame({"weight": [2.0, 0.0]}, index=["A", "B"]) if index == "some" else pd.DataFrame({"code": ["A"], "weight": [0.0]}) if index == "zero" else None

    p = LicensedProvider(Licensed(), "me", "right")
    assert p.calendar("", "") == ["2021-01-04", "2021-01-05"] and p.weights("some", "2021-01-04").to_dict("records") == [{"as_of": "2021-01-04", "symbol": "A", "weight": 2.0}]
    for index in ("zero", "none"):
        with pytest.raises(ProviderError, match="weights"):
            p.weights(index, "2021-01-04")
    with pytest.raises(ProviderError, match="refused"):
        LicensedProvider(Licensed(), "me", "wrong")
