"""Streams cut in any way give the batch queries' rows, also after a restart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators.grouped import execution_ledger
from residua.streaming.ordered import buffered_stream, first_of, ledger_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.unset(key)


def streamed(spark, frame, cuts, plan, folder, schema):
    """Rows of plan over a stream of files, each a piece of frame, run in two goes from one checkpoint."""
    source = folder / "in"
    source.mkdir()
    ends = [*cuts, len(frame)]
    for go, pieces in enumerate((list(zip([0, *cuts], ends))[: len(ends) // 2], list(zip([0, *cuts], ends))[len(ends) // 2 :])):
        for k, (a, b) in enumerate(pieces):
            frame.iloc[a:b].to_parquet(source / f"{go}-{k:03d}.parquet", coerce_timestamps="us")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        query = plan(stream).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"file://{folder}/out")


def days(n):
    return pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n), "D")


def test_ledger(rocks, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for t, d in enumerate(days(9)):
        for p in ("a", "b"):
            for s in ("X", "Y", "Z"):
                rows.append((p, t, d, s, int(r.integers(0, 9)) * 100 + int(r.integers(0, 2)) * 50, float(r.integers(800, 1200)) / 100, bool(r.random() < 0.1), bool(r.random() < 0.1), bool(r.random() < 0.1)))
    names = "portfolio t d symbol target price suspended at_upper at_lower".split()
    frame = pd.DataFrame(rows, columns=names)
    end = pd.DataFrame([("end", 99, pd.Timestamp("2024-02-01"), "X", 0, 1.0, False, False, False)], columns=names)  # a later day closes the last one
    schema = "portfolio string, t long, d timestamp, symbol string, target long, price double, suspended boolean, at_upper boolean, at_lower boolean"
    batch = execution_ledger(rocks.createDataFrame(frame.drop(columns="d")), cash=2e4).toPandas()
    want = sorted(batch.assign(d=days(9)[batch["t"]]).drop(columns="t")[["portfolio", "d", "symbol", "side", "requested", "filled", "price", "fees", "reason"]].itertuples(index=False, name=None))
    assert {x[-1] for x in want} >= {"", "insufficient_cash"}
    for k, cuts in enumerate(([6, 12, 18, 24, 30, 36, 42, 48], [3, 9, 20, 50])):  # by days, and through days
        folder = tmp_path / str(k)
        folder.mkdir()
        got = streamed(rocks, pd.concat([frame, end]), cuts, lambda s: ledger_stream(s, cash=2e4), folder, schema).toPandas()
        assert sorted(got.itertuples(index=False, name=None)) == want


def test_buffered_positions(rocks, tmp_path):
    r = np.random.default_rng(4)
    pct = np.round(np.clip(0.5 + np.cumsum(r.normal(0, 0.15, (25, 4)), axis=0) % 1 - 0.5, 0, 1), 3)
    rows = [(f"s{j}", d, None if r.random() < 0.05 else pct[t, j], 30 if t % 9 else 10) for t, d in enumerate(days(25)) for j in range(4)]
    state, want = [0] * 4, []
    for k, (s, d, p, n) in enumerate(rows):
        j = k % 4
        if p is None:
            state[j] = 0
        elif n >= 20:
            if state[j] * (p - 0.5) < 0.1 and state[j]:
                state[j] = 0
            state[j] = state[j] or (1 if p >= 0.8 else -1 if p <= 0.2 else 0)
        want.append((s, d, state[j]))
    frame = pd.DataFrame([*rows, ("end", pd.Timestamp("2024-03-01"), None, 0)], columns=["symbol", "d", "pct", "n"])
    got = streamed(rocks, frame, [1, 7, 30, 31, 77], buffered_stream, tmp_path, "symbol string, d timestamp, pct double, n long").toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want) and len({x[2] for x in want}) == 3


def test_first_of(rocks, tmp_path):
    frame = pd.DataFrame([(1, d, k) for k, d in enumerate(days(3).repeat(2))] + [(2, days(3)[2], 9)], columns=["id", "d", "k"])
    got = streamed(rocks, frame, [2, 4], lambda s: first_of(s, ["id"], late="30 days"), tmp_path, "id long, d timestamp, k long")
    assert sorted((x.id, x.k) for x in got.collect()) == [(1, 0), (2, 9)] and got.agg(F.count("*")).first()[0] == 2


def test_chunks_as_a_table_function(spark):
    from residua.operators.grouped import chunk_documents, register_chunks

    text = "\n\n".join(f"Part {i}. " + "word " * (40 + 13 * i) for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "short. text")], "doc_id long, text string")
    register_chunks(spark, "cut_up")
    docs.createOrReplaceTempView("chunked_docs")
    for size, overlap in ((1400, 200), (90, 0)):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM chunked_docs d, LATERAL cut_up(d.text, {size}, {overlap}) c").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, chunk_documents(docs, size, overlap).collect())) and len(got) > 3
