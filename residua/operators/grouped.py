"""Operators that need dense linear algebra or an ordered walk: one Arrow-backed group per refit or portfolio."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.plans.relations import relation


def factor_map(history: np.ndarray, factors: int, loading_rows: int) -> np.ndarray:
    """The matrix that turns returns into residuals of the leading correlation factors (rows: residual, columns: stock).

    history: rows are periods, columns stocks, all finite with positive spread. Zero factors give the identity.
    """
    n = history.shape[1]
    if factors == 0 or n <= factors:
        return np.eye(n) if factors == 0 else np.empty((0, n))
    spread = history.std(axis=0)
    z = (history - history.mean(axis=0)) / spread
    _, vectors = np.linalg.eigh(z.T @ z / len(z))
    lead = vectors[:, ::-1][:, :factors] / spread[:, None]
    recent = history[-loading_rows:]
    loadings, *_ = np.linalg.lstsq(recent @ lead, recent, rcond=None)
    return np.eye(n) - (lead @ loadings).T


@dataclass(frozen=True)
class Fees:
    """A lot, the commission and its least sum, transfer fee, stamp duty of a sale."""

    lot: int = 100
    commission: float = 0.00025
    least: float = 5.0
    transfer: float = 0.00001
    stamp: float = 0.0005

    def of(self, notional: float, sell: bool) -> float:
        return 0.0 if notional <= 0 else max(self.least, notional * self.commission) + notional * self.transfer + (notional * self.stamp if sell else 0.0)

    def affordable(self, asked: int, price: float, money: float) -> int:
        n = asked - asked % self.lot
        top = int(min((money + 1e-9) / (price * (1 + self.commission + self.transfer)), max(0.0, money + 1e-9 - self.least) / (price * (1 + self.transfer))) // self.lot * self.lot)
        n = min(n, max(top + self.lot, 0))  # the closed form may miss a lot by rounding; the test below decides
        while n > 0 and n * price + self.of(n * price, False) > money + 1e-9:
            n -= self.lot
        return max(n, 0)


@dataclass
class Account:
    """Cash and whole shares held by symbol, checked when made and after each day."""

    name: str
    money: float
    held: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.check()

    def check(self, sellable: dict[str, int] | None = None) -> None:
        if not (np.isfinite(self.money) and self.money >= 0):
            raise ValueError(f"the cash of {self.name} is {self.money}")
        for shares in (self.held, sellable or {}):
            for s, n in shares.items():
                if not isinstance(n, int) or n < 0 or n > self.held.get(s, 0):
                    raise ValueError(f"{self.name} cannot have {n!r} shares of {s}")

    def day(self, t: object, day: pd.DataFrame, fees: Fees) -> list[tuple]:
        """Fills (t, symbol, side, requested, filled, price, fees, reason) of one day's targets; the account is moved on."""
        out, sellable, rows = [], dict(self.held), {r.symbol: r for r in day.itertuples()}
        goal = {s: (0 if pd.isna(r.target) else int(r.target)) for s, r in rows.items()}
        if any(n < 0 for n in goal.values()):
            raise ValueError(f"a target of {self.name} on day {t} is negative")
        for sell in (True, False):
            for symbol in sorted({*self.held, *goal}):  # what is held without a target is sold
                gap = goal.get(symbol, 0) - self.held.get(symbol, 0)
                if gap == 0 or (gap < 0) != sell:
                    continue
                r = rows.get(symbol)
                if r is None or not (np.isfinite(r.price) and r.price > 0):
                    raise ValueError(f"no price of {symbol} on day {t}")
                asked, reason, done = abs(gap), "", 0
                if r.suspended:
                    reason = "suspended"
                elif sell and r.at_lower:
                    reason = "lower_limit"
                elif not sell and r.at_upper:
                    reason = "upper_limit"
                elif sell:
                    done = min(asked, sellable.get(symbol, 0))
                    reason = "" if done == asked else "t_plus_one"
                else:
                    done, whole = fees.affordable(asked, r.price, self.money), asked - asked % fees.lot
                    reason = "insufficient_cash" if done < whole else "" if done == asked else "lot_rounding"
                cost = fees.of(done * r.price, sell)
                self.money = max(0.0, self.money + (done * r.price if sell else -done * r.price) - cost)
                self.held[symbol] = self.held.get(symbol, 0) + (-done if sell else done)
                if sell and done:
                    sellable[symbol] -= done
                out.append((t, symbol, "sell" if sell else "buy", asked, done, r.price, cost, reason))
        self.check(sellable)
        self.held = {s: n for s, n in self.held.items() if n}
        return out


def walked(name: str, group: pd.DataFrame, cash: float, fees: Fees) -> tuple[list, ...]:
    """All days of an account as columns (t, then FILLS): what Account.day() gives day by day, from arrays of its names. A name
    at its target costs nothing."""
    group = group.sort_values(["t", "symbol"])
    code, names = pd.factorize(group["symbol"], sort=True)
    t, price, target = group["t"].to_numpy(), group["price"].to_numpy(float), group["target"].fillna(0).to_numpy(np.int64)
    suspended, upper, lower = (group[c].to_numpy(bool).tolist() for c in ("suspended", "at_upper", "at_lower"))
    account, held = Account(name, cash), np.zeros(len(names), np.int64)
    out: tuple[list, ...] = tuple([] for _ in range(8))
    bounds = [*np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))).tolist(), len(t)] if len(t) else []
    for lo, hi in zip(bounds, bounds[1:]):
        day, goal, row = t[lo].item(), np.zeros_like(held), np.full(len(held), -1)
        goal[code[lo:hi]], row[code[lo:hi]] = target[lo:hi], np.arange(lo, hi)
        if (goal < 0).any():
            raise ValueError(f"a target of {name} on day {day} is negative")
        gap = goal - held
        for k in [*np.flatnonzero(gap < 0).tolist(), *np.flatnonzero(gap > 0).tolist()]:  # what is held without a target is sold
            asked, i, sell, reason, done = abs(gap.item(k)), row.item(k), gap.item(k) < 0, "", 0
            paid = price.item(i) if i >= 0 else float("nan")
            if not 0 < paid < float("inf"):
                raise ValueError(f"no price of {names[k]} on day {day}")
            if suspended[i]:
                reason = "suspended"
            elif sell and lower[i]:
                reason = "lower_limit"
            elif not sell and upper[i]:
                reason = "upper_limit"
            elif sell:
                done = asked  # a target is not negative, so no more is asked than was held at the day's start
            else:
                done, whole = fees.affordable(asked, paid, account.money), asked - asked % fees.lot
                reason = "insufficient_cash" if done < whole else "" if done == asked else "lot_rounding"
            cost = fees.of(done * paid, sell)
            account.money = max(0.0, account.money + (done * paid if sell else -done * paid) - cost)
            held[k] += -done if sell else done
            for column, value in zip(out, (day, names[k], "sell" if sell else "buy", asked, done, paid, cost, reason)):
                column.append(value)
        account.check()
    return out


FILLS = "symbol string, side string, requested long, filled long, price double, fees double, reason string"


def execution_ledger(targets: DataFrame, cash: float = 1e6, fees: Fees = Fees()) -> DataFrame:
    """Fills of share targets under T+1, limits, lots and fees: (portfolio, t, symbol, side, requested, filled, price, fees, reason).

    targets: portfolio, t, symbol, target (shares), price, suspended, at_upper, at_lower. Days are walked in order within
    a portfolio; portfolios run in parallel. Sells come before buys, symbols in order; only what was held at the day's
    start can be sold; buys are cut to what cash affords.
    """
    names = ["portfolio", "t", *[c.split()[0] for c in FILLS.split(", ")]]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        name = group["portfolio"].iloc[0]
        columns = walked(name, group, cash, fees)
        return pd.DataFrame(dict(zip(names, ([name] * len(columns[0]), *columns))), columns=names)

    return targets.groupBy("portfolio").applyInPandas(walk, f"portfolio string, t int, {FILLS}")


def chunks_of(text: str | None, max_chars: int = 1400, overlap: int = 200) -> Iterator[tuple[int, int, int, str]]:
    """(chunk, start_char, end_char, text) of one text; see chunk_documents."""
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive, overlap from 0 to less than it")
    text = "\n".join(line.rstrip() for line in (text or "").splitlines()).strip()
    at = number = 0
    while at < len(text):
        end = min(at + max_chars, len(text))
        if end < len(text):
            stop = max(text.rfind("\n\n", at, end), text.rfind(". ", at, end))
            if stop > at + max_chars // 2:
                end = stop + 1
        if chunk := text[at:end].strip():
            yield number, at, end, chunk
            number += 1
        if end >= len(text):
            break
        at = end - overlap
        while 0 < at < len(text) and not text[at].isspace():
            at += 1
        while 0 < at < len(text) and text[at].isspace():
            at += 1


class Chunks:
    """A table function: SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 1400, 200) c."""

    def eval(self, text: str, max_chars: int = 1400, overlap: int = 200):
        yield from chunks_of(text, max_chars, overlap)


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """Makes Chunks callable from SQL under a name."""
    spark.udtf.register(name, F.udtf(Chunks, returnType="chunk int, start_char int, end_char int, text string"))


def chunk_documents(docs: DataFrame, max_chars: int = 1400, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, start_char, end_char, text): chunks of at most max_chars of each text, whose lines lose trailing and
    which itself loses outer white space. A chunk ends one character behind the start of the last blank line or ". " where
    that lies past half of it; the next starts overlap characters earlier, moved to the start of the next word. Empty
    chunks are dropped and not counted."""
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive, overlap from 0 to less than it")

    def run(frames):
        for frame in frames:
            rows = [(i, *span) for i, t in zip(frame["id"], frame["text"]) for span in chunks_of(t, max_chars, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start_char", "end_char", "text"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "doc_id long, chunk int, start_char int, end_char int, text string")


def ledger_totals(fills: DataFrame) -> DataFrame:
    """(portfolio, fills, rejected_shares, total_fees): what was asked for and not filled, and all fees."""
    return fills.groupBy("portfolio").agg(F.count(F.lit(1)).alias("fills"), F.sum(F.col("requested") - F.col("filled")).alias("rejected_shares"), F.round(F.sum("fees"), 6).alias("total_fees"))


# ---- queries

#: Cash of a registered account.
CASH = 1e7


def query_execution_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts for the names of each ten suppliers, so accounts grow with the names; each may put a share of its cash in a member."""
    # the state is that of limit_prices: both are columns of one row
    state = F.when(F.col("paused"), "suspended").when(F.col("open_cents") >= F.col("high_cents"), "upper_limit").when(F.col("open_cents") <= F.col("low_cents"), "lower_limit").otherwise("tradable")
    targets = relation(spark, sf_dir, "limit_rate").where("preclose IS NOT NULL AND close_price > 0").withColumn("state", state)
    desk = F.floor(F.substring("symbol", 4, 9).cast("long") / 30).cast("string")
    fractions = F.explode(F.array(*[F.struct(F.lit(n).alias("portfolio"), F.lit(f).alias("f")) for n, f in (("equal", 0.04), ("half", 0.02))]))
    wide = targets.select("t", "symbol", desk.alias("desk"), fractions.alias("p"), F.col("close_price").alias("price"), "member", "state")
    shares = F.when(F.col("member"), F.floor(F.lit(CASH) * F.col("p.f") / F.col("price") / 100) * 100).otherwise(0).cast("long")
    account = F.concat_ws("-", "p.portfolio", "desk").alias("portfolio")
    return execution_ledger(wide.select(account, "t", "symbol", shares.alias("target"), "price", (F.col("state") == "suspended").alias("suspended"), (F.col("state") == "upper_limit").alias("at_upper"), (F.col("state") == "lower_limit").alias("at_lower")), cash=CASH)


def query_execution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_totals(query_execution_ledger(spark, sf_dir))


def query_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query_chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_documents as SQL: a table function beside its table."""
    register_chunks(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.sql("SELECT d.doc_id, c.chunk, c.start_char, c.end_char, c.text FROM {docs} d, LATERAL chunks(d.text, 1400, 200) c", docs=docs)


QUERIES = {"chunk_table_function": query_chunk_table_function, "execution_ledger": query_execution_ledger, "execution_totals": query_execution_totals, "chunk_documents": query_chunk_documents}
