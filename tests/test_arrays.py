"""Arrays read in blocks against numpy."""

import gzip

import numpy as np
import pandas as pd
import pytest

from residua.sources.arrays import ArraySource, array_audit, blocks, layouts, read_array
from residua.sources.panels import FIELDS, load_arrays


def cells(array, zeros=False):
    keep = np.isfinite(array) & (zeros | (array != 0))
    return {(int(t), int(s)): float(array[t, s]) for t, s in zip(*np.nonzero(keep))}


@pytest.mark.parametrize("dtype, order", [("<f8", "C"), (">f4", "C"), ("<f8", "F"), ("<i8", "C")])
def test_blocks_of_rows(spark, tmp_path, dtype, order):
    r = np.random.default_rng(1)
    a = np.asarray(np.round(r.normal(size=(103, 17)) * 4), dtype=dtype, order=order)
    if a.dtype.kind == "f":
        a[3, 4], a[5, 6] = np.nan, np.inf
    np.save(tmp_path / "a.npy", a)
    frame = read_array(spark, f"file://{tmp_path}", block_bytes=1000)
    assert {(x.t, x.asset): x.residual for x in frame.collect()} == cells(a) and frame.count() == len(cells(a))
    n = len(blocks(f"{tmp_path}/a.npy", layouts(f"{tmp_path}/a.npy"), 1000))
    assert frame.rdd.getNumPartitions() == n == (1 if order == "F" else -(-103 // (1000 // (a.itemsize * 17))))
    assert {(x.t, x.asset): x.residual for x in read_array(spark, f"{tmp_path}/a.npy", zero_is_missing=False).collect()} == cells(a, True)


def test_folders_gzip_and_refusals(spark, tmp_path):
    a, b = np.arange(6.0).reshape(2, 3), np.ones((4, 2))
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "a.npy", a)
    with gzip.open(tmp_path / "deep" / "b.npy.gz", "wb") as f:
        np.save(f, b)
    (tmp_path / "other.txt").write_text("no array")
    spark.dataSource.register(ArraySource)
    got = spark.read.format("npy").load(f"file://{tmp_path}").groupBy("path").count().collect()
    assert {(x.path.rsplit("/", 1)[1], x["count"]) for x in got} == {("a.npy", 5), ("b.npy.gz", 8)}
    np.save(tmp_path / "o.npy", np.array([[{}]], object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        read_array(spark, f"{tmp_path}/o.npy").collect()
    np.save(tmp_path / "c.npy", np.zeros(3))
    with pytest.raises(Exception, match="dimensions"):
        read_array(spark, f"{tmp_path}/c.npy").collect()
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert read_array(spark, f"{tmp_path}/e.npy").count() == 0
    raw = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(raw[:-4])
    with pytest.raises(Exception, match="too early"):
        read_array(spark, f"{tmp_path}/cut.npy").collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_panels(spark, tmp_path, save):
    r = np.random.default_rng(2)
    dates = pd.bdate_range("2020-01-01", periods=40).to_numpy().astype("datetime64[D]")
    matrices = {c: r.random((40, 9)) < 0.2 if c in ("paused", "is_st", "member") else r.normal(size=(40, 9)) for c in FIELDS}
    save(tmp_path / "p.npz", dates=dates, symbols=np.array([f"s{i}" for i in range(9)]), **matrices)
    frame = load_arrays(spark, f"file://{tmp_path}/p.npz", block_bytes=7000)
    got = frame.toPandas().sort_values(["d", "symbol"])
    assert len(got) == 360 and list(got["d"].unique()) == list(pd.to_datetime(dates).date)
    assert all(np.array_equal(got[c].to_numpy().reshape(40, 9), m) for c, m in matrices.items())
    assert frame.rdd.getNumPartitions() == (1 if save is np.savez_compressed else 4)
    save(tmp_path / "bad.npz", dates=dates, symbols=np.array(["a"]))
    with pytest.raises(Exception, match="lacks"):
        load_arrays(spark, f"{tmp_path}/bad.npz").collect()


def test_audit(spark, tmp_path):
    a = np.array([[1.0, 0.0, np.nan], [3.0, -1.0, np.inf]], np.float32)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.full((2, 2), np.nan))
    got = {r.path.rsplit("/", 1)[1]: r for r in array_audit(spark, f"file://{tmp_path}").collect()}
    assert (got["a.npy"].rows, got["a.npy"].columns, got["a.npy"].dtype) == (2, 3, "float32")
    assert (got["a.npy"].finite_share, got["a.npy"].zero_share, got["a.npy"].std_nonzero) == pytest.approx((4 / 6, 0.25, np.std([1, 3, -1])))
    assert got["b.npy"].finite_share == 0 and got["b.npy"].zero_share is None
