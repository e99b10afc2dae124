"""Dense arrays as tables, by a data source whose tasks follow bytes.

A .npy file, and a stored member of a .npz archive, is a header and then the cells, so a task can read the rows of its own
block and nothing else. What is compressed (.npy.gz, members of a compressed archive) can only be read from its start: one
task a file, which still holds one block at a time.
"""

from __future__ import annotations

import gzip
import io
import math
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_BYTES = 64 << 20
#: Cells of one Arrow batch.
BATCH_CELLS = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Where an array's cells lie in its file: from byte `start`, or -1 where they must be decoded from the file's start."""

    member: str
    start: int
    dtype: str
    shape: tuple[int, ...]
    by_columns: bool

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * math.prod(self.shape[1:])


class Block(InputPartition):
    """Rows first to last of the arrays of one file; whole: all rows, decoded from the start."""

    def __init__(self, path: str, arrays: tuple[Layout, ...], first: int, last: int, whole: bool):
        super().__init__((path, arrays, first, last, whole))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> BinaryIO:
    store, place = _store(path)
    return store.open_input_file(place)


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The path itself, or the files below it with one of the endings, in order."""
    store, place = _store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    below = (f.path for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(endings))
    return [path.rstrip("/") + "/" + f[len(place.rstrip("/")) + 1 :] for f in sorted(below)]


def _header(stream: BinaryIO, member: str, start: int) -> Layout:
    """The layout behind a stream at an array's magic; start is that place in the file, or -1."""
    counted = _Counted(stream)
    version = np.lib.format.read_magic(counted)
    shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(counted)
    if dtype.hasobject:
        raise ValueError(f"{member} holds objects; they are not read")
    return Layout(member, -1 if start < 0 else start + counted.n, dtype.str, shape, by_columns and len(shape) > 1)


class _Counted(io.RawIOBase):
    """A reader that knows how far it has come."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.n = stream, 0

    def read(self, size: int = -1) -> bytes:
        raw = self.stream.read(size)
        self.n += len(raw)
        return raw


def layouts(path: str) -> list[Layout]:
    """Of the arrays in a .npy, .npy.gz or .npz file; only headers are read."""
    with _open(path) as f:
        if path.endswith(".npy.gz"):
            with gzip.open(f) as g:
                return [_header(g, path, -1)]
        if not path.endswith(".npz"):
            return [_header(f, path, 0)]
        out = []
        with zipfile.ZipFile(f) as z:
            for info in z.infolist():
                at = -1
                if info.compress_type == zipfile.ZIP_STORED:
                    f.seek(info.header_offset + 26)  # the local header's lengths of name and extra field
                    at = info.header_offset + 30 + sum(int.from_bytes(f.read(2), "little") for _ in range(2))
                with z.open(info) as member:
                    out.append(_header(member, info.filename.removesuffix(".npy"), at))
        return out


def blocks(path: str, arrays: list[Layout], block_bytes: int) -> list[Block]:
    """Of files whose arrays have the same rows: blocks of rows of about block_bytes, or one block where some array cannot be cut."""
    rows = arrays[0].shape[0] if arrays[0].shape else 0
    whole = any(a.start < 0 or a.by_columns for a in arrays)
    step = max(1, block_bytes // max(1, sum(a.row_bytes for a in arrays)))
    return [Block(path, tuple(arrays), 0, rows, True)] if whole and rows else [Block(path, tuple(arrays), lo, min(lo + step, rows), False) for lo in range(0, rows, step)]


def _rows(stream: BinaryIO, a: Layout, n: int) -> np.ndarray:
    raw = stream.read(n * a.row_bytes)
    if len(raw) != n * a.row_bytes:
        raise ValueError(f"{a.member} ends too early")
    return np.frombuffer(raw, a.dtype).reshape(n, *a.shape[1:])


def _tiles(path: str, arrays: tuple[Layout, ...], first: int, last: int, whole: bool, cells: int = BATCH_CELLS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, the arrays' rows from there), some rows at a time; the arrays of a whole file are decoded side by side."""
    step = max(1, cells // max(1, max(math.prod(a.shape[1:]) for a in arrays)))
    with ExitStack() as open_files:
        if whole and path.endswith(".npz"):
            z = open_files.enter_context(zipfile.ZipFile(open_files.enter_context(_open(path))))
            streams = [open_files.enter_context(z.open(f"{a.member}.npy")) for a in arrays]
        else:
            streams = [open_files.enter_context(_open(path)) for _ in arrays]
            if path.endswith(".gz"):
                streams = [open_files.enter_context(gzip.open(s)) for s in streams]
        columns = {}
        for k, (s, a) in enumerate(zip(streams, arrays)):
            if whole:
                _header(s, a.member, -1)
                if a.by_columns:  # cells of a row lie far apart: such an array is held whole
                    columns[k] = np.frombuffer(s.read(a.row_bytes * a.shape[0]), a.dtype).reshape(a.shape, order="F")
            else:
                s.seek(a.start + first * a.row_bytes)
        for lo in range(first, last, step):
            n = min(step, last - lo)
            yield lo, [columns[k][lo : lo + n] if k in columns else _rows(s, a, n) for k, (s, a) in enumerate(zip(streams, arrays))]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, endings: tuple[str, ...]):
        self.path, self.schema, self.endings = options["path"], schema, endings
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK_BYTES)))
        self.keep_zeros = str(options.get("zeroismissing", options.get("zeroIsMissing", "true"))).lower() == "false"

    def arrays(self, path: str) -> list[Layout]:
        return layouts(path)

    def partitions(self) -> list[Block]:
        return [b for path in _files(self.path, self.endings) for b in blocks(path, self.arrays(path), self.block)]


class ArrayReader(_Reader):
    def arrays(self, path: str) -> list[Layout]:
        found = layouts(path)
        for a in found:
            if len(a.shape) != 2:
                raise ValueError(f"{a.member} has {len(a.shape)} dimensions, not two")
        return found

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has rows
            return
        path, schema = partition.value[0], to_arrow_schema(self.schema)
        for lo, [tile] in _tiles(*partition.value):
            tile = tile.astype(float)
            t, s = np.nonzero(np.isfinite(tile) & (self.keep_zeros | (tile != 0)))
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(t), np.int32), [path]).dictionary_decode(), pa.array((t + lo).astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(tile[t, s])], schema=schema)


class ArraySource(DataSource):
    """spark.read.format("npy").load(path): a row for each finite cell of the two-dimensional .npy and .npy.gz files below path.
    Options: blockBytes, bytes a task reads (default 64 MB); zeroIsMissing (default true)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, t int, asset int, residual double"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, schema, (".npy", ".npy.gz"))


def read_array(spark: SparkSession, path: str, *, zero_is_missing: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, t, asset, residual) of each finite cell of the two-dimensional arrays below path; objects are refused."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").option("blockBytes", block_bytes).option("zeroIsMissing", str(zero_is_missing).lower()).load(path)


def array_audit(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, columns, dtype, finite_share, zero_share, std_nonzero) of the two-dimensional arrays below path: shape and type
    from the headers, shares of zeros among the finite cells, the deviation of the finite cells that are not zero."""
    heads = [(file, *a.shape, np.dtype(a.dtype).name) for file in _files(path, (".npy", ".npy.gz")) for a in layouts(file)]
    shapes = spark.createDataFrame(heads, "path string, rows long, columns long, dtype string")
    nonzero = F.when(F.col("residual") != 0, F.col("residual"))
    sums = read_array(spark, path, zero_is_missing=False).groupBy("path").agg(F.count(F.lit(1)).alias("finite"), F.count(F.when(F.col("residual") == 0, 1)).alias("zeros"), F.stddev_pop(nonzero).alias("std_nonzero"))
    finite = F.coalesce("finite", F.lit(0))
    return shapes.join(sums, "path", "left").select("path", "rows", "columns", "dtype", F.try_divide(finite, F.col("rows") * F.col("columns")).alias("finite_share"), F.try_divide("zeros", "finite").alias("zero_share"), "std_nonzero")


class PanelReader(_Reader):
    def arrays(self, path: str) -> list[Layout]:
        """The panel's matrices; dates and symbols are read apart."""
        found, fields = {a.member: a for a in layouts(path)}, [f.name for f in self.schema.fields[2:]]
        missing = [c for c in ("dates", "symbols", *fields) if c not in found]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        shape = (found["dates"].shape[0], found["symbols"].shape[0])
        if any(found[c].shape != shape for c in fields):
            raise ValueError(f"{path}: every matrix must be {shape[0]} days by {shape[1]} symbols")
        return [found[c] for c in fields]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has rows
            return
        path, schema = partition.value[0], to_arrow_schema(self.schema)
        with _open(path) as f, np.load(f, allow_pickle=False) as z:
            days, symbols = pd.to_datetime(z["dates"]).date, z["symbols"].astype(str)
        for lo, tiles in _tiles(*partition.value):
            n = len(tiles[0])
            columns = [pa.array(np.repeat(days[lo : lo + n], len(symbols)), pa.date32()), pa.array(np.tile(symbols, n))]
            columns += [pa.array(tile.ravel()).cast(f.type) for tile, f in zip(tiles, list(schema)[2:])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class PanelSource(DataSource):
    """spark.read.format("npz_panel").schema(d date, symbol string, fields).load(path): .npz archives of dates, symbols and a
    day-by-symbol matrix for each field. Option: blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "npz_panel"

    def reader(self, schema: StructType) -> PanelReader:
        return PanelReader(self.options, schema, (".npz",))
