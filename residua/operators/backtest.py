"""Long-only backtest: decided at a close, executed at the next open, drifting in between."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.portfolio import Infeasible, PortfolioLimits, Task, best_weights, shrunk_risk
from residua.plans.relations import relation
from residua.plans.store import stored

# A buy pays commission, transfer fee and slippage; a sale also stamp duty, by its date.
BUY_COST, STAMP_CHANGE, STAMP_BEFORE, STAMP_AFTER = 0.00126, "1998-08-28", 0.001, 0.0005


@dataclass(frozen=True)
class Scenario:
    """How alpha becomes trades. sign: 1 original, -1 reversed, 0 neutral; interval: days between decisions."""

    sign: float = 1.0
    signal: str = "rank"
    interval: int = 1
    forced: bool = False
    limits: PortfolioLimits = field(default_factory=PortfolioLimits)
    window: int = 60
    alpha_scale: float = 0.002
    #: Limits that no weights meet end the run; if not strict, that day's holdings stay as they are.
    strict: bool = True
    #: Of optimal_weights(), which is asked only where dual_weights() does not settle.
    iterations: int = 20_000
    tolerance: float = 1e-7


def fill(held: np.ndarray, target: np.ndarray, can_buy: np.ndarray, can_sell: np.ndarray) -> np.ndarray:
    """Weights after the open: sales where allowed, buys where allowed, scaled to the cash there is."""
    change = target - held
    sold = np.where(can_sell, np.minimum(change, 0), 0.0)
    bought = np.where(can_buy, np.maximum(change, 0), 0.0)
    cash, wanted = max(0.0, 1 - held.sum()) - sold.sum(), bought.sum()
    return held + sold + bought * (min(1.0, cash / wanted) if wanted > 0 else 1.0)


OUT = "book string, scenario string, t int, d date, strategy double, bench double, cost double, turnover double, decided boolean, mandatory boolean, limit_turnover double, names int"


@dataclass
class _Grids:
    """A book's panel as days by names, for all its scenarios."""

    panel: pd.DataFrame

    def __post_init__(self) -> None:
        days, names = np.sort(self.panel["t"].unique()), np.sort(self.panel["symbol"].unique())
        self.at = np.searchsorted(days, self.panel["t"]), np.searchsorted(names, self.panel["symbol"])
        self.shape = len(days), len(names)
        if len(self.panel) != len(set(zip(*self.at))):
            raise ValueError("a symbol has two rows of one t")
        self.member, self.st, self.paused = (self.flags(c) for c in ("member", "is_st", "paused"))
        self.ret, self.open, self.volume, self.up, self.down, self.weight, self.price = (self.numbers(c) for c in ("ret", "adj_open", "volume", "high_limit", "low_limit", "benchmark_weight", "open_price"))
        self.t, self.days = days, self.panel.groupby("t")["d"].first().sort_index().to_numpy()
        self.month = np.array([str(d)[:7] for d in self.days])

    def flags(self, column: str) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        out[self.at] = self.panel[column].fillna(False).astype(bool)
        return out

    def numbers(self, column: str) -> np.ndarray:
        out = np.full(self.shape, np.nan)
        out[self.at] = self.panel[column].to_numpy(float)
        return out


def _walk(conf: Scenario, name: str, grids: _Grids) -> list[tuple]:
    """The path of one scenario."""
    member, st, paused, ret, open_, volume, up, down, price = grids.member, grids.st, grids.paused, grids.ret, grids.open, grids.volume, grids.up, grids.down, grids.price
    t, days, month, weight, alpha = grids.t, grids.days, grids.month, grids.weight, grids.numbers(f"alpha_{conf.signal}")
    n_days, n = ret.shape
    gain = np.full_like(open_, np.nan)
    with np.errstate(all="ignore"):
        gain[:-1] = open_[1:] / open_[:-1] - 1
    gain = np.nan_to_num(gain, nan=0.0, posinf=0.0, neginf=0.0)
    alpha, weight = np.nan_to_num(alpha) * conf.sign * conf.alpha_scale, np.where(member, np.nan_to_num(weight), 0.0)
    exposure, first = conf.limits.exposure, conf.window
    while first < n_days and weight[first].sum() <= 0:
        first += 1
    if first >= n_days - 2:
        return []
    held = weight[first] / weight[first].sum() * exposure
    goal, open_orders = held.copy(), np.zeros(n, bool)
    risk_month, working, cov, out = None, np.empty(0, int), None, []
    for i in range(first, n_days - 2):
        if weight[i].sum() <= 0:
            continue
        bench = weight[i] / weight[i].sum()
        eligible, before = member[i] & ~st[i], member[i - 1] & ~st[i - 1]
        leaving = float(held[~eligible & (held > 1e-8)].sum())
        changed = not np.array_equal(member[i], member[i - 1])
        mandatory = conf.forced and (changed or not np.array_equal(eligible, before))
        decided, limit = (i - first) % conf.interval == 0 or mandatory, 0.0
        if decided:
            if month[i] != risk_month or changed:
                working = np.flatnonzero(eligible | (held > 1e-12))
                cov, risk_month = shrunk_risk(ret[i - conf.window + 1 : i + 1][:, working]), month[i]
            if not len(working):
                continue
            limit = conf.limits.turnover + (leaving if conf.forced else 0.0)
            try:
                best = best_weights(Task(alpha[i, working], bench[working], held[working], cov, replace(conf.limits, turnover=limit), eligible[working], iterations=conf.iterations, tolerance=conf.tolerance))
            except Infeasible as e:
                if conf.strict:
                    raise Infeasible(f"scenario {name}, day {t[i]}, {len(working)} names, turnover {conf.limits.turnover} and forced exits {leaving:.4f}: {e}") from e
                best = None
            target, decided = (held.copy(), False) if best is None else (np.zeros(n), True)
            if best is not None:
                target[working] = best
        else:
            target = np.where(open_orders, goal, held)
        k = i + 1
        market = ~paused[k] & np.isfinite(price[k]) & (price[k] > 0) & (volume[k] > 0)
        with np.errstate(invalid="ignore"):
            now = fill(held, target, market & ~st[k] & (price[k] < up[k] - 1e-10), market & (price[k] > down[k] + 1e-10))
        open_orders, goal = np.abs(now - target) > 1e-8, target
        move = now - held
        stamp = STAMP_BEFORE if str(days[k])[:10] < STAMP_CHANGE else STAMP_AFTER
        cost = float(np.maximum(move, 0).sum() * BUY_COST + np.maximum(-move, 0).sum() * (BUY_COST + stamp))
        gross = float(now @ gain[k])
        growth = 1 + gross - cost
        if growth <= 0:
            raise ValueError(f"scenario {name} loses all on day {t[k]}")
        out.append((name, int(t[k]), days[k], gross - cost, float(bench @ gain[k]) * exposure, cost, 0.5 * float(np.abs(move).sum()), bool(decided), bool(mandatory), limit, int((now > 1e-10).sum())))
        held = now * (1 + gain[k]) / growth
        held[np.abs(held) < 1e-10] = 0.0
    return out


def long_only_backtest(panel: DataFrame, scenarios: dict[str, Scenario]) -> DataFrame:
    """One row per scenario and executed day: net strategy and benchmark return, cost, turnover, what was decided.

    panel: t, d, symbol, member, is_st, paused, ret, adj_open, open_price, volume, high_limit, low_limit,
    benchmark_weight and alpha_<signal> columns, and book where there are several, each with names of its own; books
    of one number deal, where there is one, are walked in one group. A decision at close t is filled at open t + 1 under limits,
    suspensions and cash, and earns the open-to-open return from there; unfilled orders stay open until the next decision. A path
    depends on every earlier day, so a book's rows are in one group, in which its scenarios are walked; groups run in parallel.
    """
    if "book" not in panel.columns:
        panel = panel.withColumn("book", F.lit("all"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for book, rows in group.groupby("book"):
            grids = _Grids(rows)
            out += [(book, *row) for name, conf in scenarios.items() for row in _walk(conf, name, grids)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return panel.groupBy("deal" if "deal" in panel.columns else "book").applyInPandas(run, OUT)


def turnover_summary(days: DataFrame, per_year: int = 252) -> DataFrame:
    """Per book and scenario: decisions, mandatory ones, days with trades, mean and annual turnover, mean on trade days, largest."""
    traded = F.col("turnover") > 1e-12
    return days.groupBy("book", "scenario").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("decided").cast("long")).alias("decisions"), F.sum(F.col("mandatory").cast("long")).alias("mandatory"), F.sum(traded.cast("long")).alias("trade_days"),
        F.avg("turnover").alias("mean_turnover"), (F.avg("turnover") * per_year).alias("annual_turnover"), F.avg(F.when(traded, F.col("turnover"))).alias("mean_on_trade_days"), F.max("turnover").alias("max_turnover"),
    )


# ---- queries

_SMALL = PortfolioLimits(cap=0.08, tracking_error=0.30, turnover=0.25, periods=52)
SCENARIOS = {
    "daily": Scenario(limits=_SMALL, forced=True, strict=False, iterations=1500, tolerance=1e-5), "reversed": Scenario(limits=_SMALL, sign=-1.0, forced=True, strict=False, iterations=1500, tolerance=1e-5), "neutral": Scenario(limits=_SMALL, sign=0.0, forced=True, strict=False, iterations=1500, tolerance=1e-5),
    "five_session": Scenario(limits=replace(_SMALL, turnover=0.05), interval=5, forced=True, strict=False, iterations=1500, tolerance=1e-5), "buffered": Scenario(limits=replace(_SMALL, turnover=0.05), signal="buffered", forced=True, strict=False, iterations=1500, tolerance=1e-5),
}


#: Books walked in one group, where each core has four groups at least: rows are dealt to fewer tasks.
TOGETHER = 8


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "long_only_days", lambda: _run(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = relation(spark, sf_dir, "rets2").select("t", "d", "symbol", "member", "is_st", "paused", "ret", "adj_open", "open_price", "volume", "benchmark_weight")
    limits = relation(spark, sf_dir, "limit_prices").select("t", "symbol", "high_limit", "low_limit")
    rank = relation(spark, sf_dir, "alpha").select("t", "symbol", F.col("alpha").alias("alpha_rank"))
    buffered = relation(spark, sf_dir, "buffered_alpha").select("t", "symbol", F.col("alpha").alias("alpha_buffered"))
    panel = rets.join(limits, ["t", "symbol"], "left").join(rank, ["t", "symbol"], "left").join(buffered, ["t", "symbol"], "left")
    book = F.floor(F.substring("symbol", 4, 9).cast("long") / 150)  # the names of fifty suppliers
    books = spark.read.parquet(f"{sf_dir}/supplier.parquet").count() // 50 + 1
    together = max(1, min(TOGETHER, books // (4 * spark.sparkContext.defaultParallelism)))
    panel = panel.withColumns({"book": book.cast("string"), "deal": F.floor(book / together).cast("int")})
    return long_only_backtest(panel.repartitionById(max(1, -(-books // together)), "deal"), SCENARIOS)  # a task a group: hashed, some tasks would hold several


def query_long_only_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _days(spark, sf_dir)
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def query_long_only_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turnover_summary(_days(spark, sf_dir), 52)
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _judged(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    days = _days(spark, sf_dir).where("scenario = 'daily'").groupBy("t").agg(*[F.avg(c).alias(c) for c in ("strategy", "bench", "cost")])  # all books alike
    scaled = days.select("t", (F.col("strategy") + F.col("cost")).alias("gross"), "strategy", "bench", "cost")
    return relation(spark, sf_dir, step, scaled=scaled, calendar=relation(spark, sf_dir, "calendar"))


def query_long_only_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, "period_metrics")


def query_long_only_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, "admission_decision")


QUERIES = {"long_only_backtest": query_long_only_backtest, "long_only_turnover": query_long_only_turnover, "long_only_periods": query_long_only_periods, "long_only_admission": query_long_only_admission}
