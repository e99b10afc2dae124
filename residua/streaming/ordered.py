"""State that is carried from day to day on a stream: rows of a key wait until the watermark has passed their day, and days are
then answered in order, so the answers do not depend on how the stream was cut into batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from residua.operators.grouped import FILLS, Account, Fees

#: One day's step of a key: (key, state or None, day, its rows) to (rows of the answer without key and day, state).
Step = Callable[[str, dict | None, pd.Timestamp, pd.DataFrame], tuple[list[tuple], dict]]


class OrderedDays(StatefulProcessor):
    """Keeps a key's open days as Arrow bytes and its state as JSON; a timer per day tells when the day is closed."""

    def __init__(self, step: Step, names: list[str]):
        self.step, self.names = step, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.days = handle.getMapState("days", "day long", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, part in frame.groupby("d"):
                at = (int(pd.Timestamp(day).value // 1_000_000),)
                if self.days.containsKey(at):
                    part = pd.concat([_read(self.days.getValue(at)[0]), part])
                else:
                    self.handle.registerTimer(at[0])
                self.days.updateValue(at, (_bytes(part),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, out = timerValues.getCurrentWatermarkInMs(), []
        for at in sorted(k for k in self.days.keys() if k[0] <= closed):  # timers may come in any order
            state = json.loads(self.state.get()[0]) if self.state.exists() else None
            day = pd.Timestamp(at[0], unit="ms")
            answer, state = self.step(key[0], state, day, _read(self.days.getValue(at)[0]))
            self.state.update((json.dumps(state),))
            self.days.removeKey(at)
            out += [(key[0], day, *row) for row in answer]
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _bytes(frame: pd.DataFrame) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def by_day(rows: DataFrame, key: str, step: Step, ddl: str, late: str = "1 day") -> DataFrame:
    """(key, d, columns of ddl): step over each key's days in order. rows: the key (string), d (timestamp at a day's start) and
    what step reads. A day is answered once a day that lies `late` after it has been seen; rows that come later still are
    dropped by the watermark. The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    names = [key, "d", *[c.split()[0] for c in ddl.split(", ")]]
    timed = rows.withWatermark("d", late)
    return timed.groupBy(key).transformWithStateInPandas(OrderedDays(step, names), f"{key} string, d timestamp, {ddl}", "Append", "EventTime")


def ledger_stream(targets: DataFrame, cash: float = 1e6, fees: Fees = Fees(), late: str = "1 day") -> DataFrame:
    """execution_ledger on a stream: targets with d in place of t; cash and holdings are the state of a portfolio."""

    def step(name: str, state: dict | None, day: pd.Timestamp, rows: pd.DataFrame) -> tuple[list[tuple], dict]:
        account = Account(name, cash if state is None else state["money"], {} if state is None else state["held"])
        fills = account.day(day, rows.sort_values("symbol"), fees)
        return [fill[1:] for fill in fills], {"money": account.money, "held": account.held}

    return by_day(targets, "portfolio", step, FILLS, late)


def buffered_stream(ranks: DataFrame, late: str = "1 day", enter: float = 0.8, leave: float = 0.6, least: int = 20) -> DataFrame:
    """(symbol, d, state): positions that enter beyond one rank and leave within another. ranks: symbol, d, pct (null: no valid
    score that day), n (valid names of the day). With fewer than `least` names a state stays as it is."""

    def step(symbol: str, state: dict | None, day: pd.Timestamp, rows: pd.DataFrame) -> tuple[list[tuple], dict]:
        held, row = (0 if state is None else state["held"]), rows.iloc[0]
        if pd.isna(row["pct"]):
            held = 0
        elif row["n"] >= least:
            pct = float(row["pct"])
            if (held == 1 and pct < leave) or (held == -1 and pct > 1 - leave):
                held = 0
            if held == 0:
                held = 1 if pct >= enter else -1 if pct <= 1 - enter else 0
        return [(held,)], {"held": held}

    return by_day(ranks, "symbol", step, "state int", late)


def first_of(rows: DataFrame, keys: list[str], time: str = "d", late: str = "1 day") -> DataFrame:
    """The first row of each key, as far as the watermark remembers: a stream cannot wait for the last one, as dedupe_keep_last does."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
