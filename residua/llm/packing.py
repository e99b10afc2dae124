"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from . import _units as N
from ._cluster import released, written

# Classes of bytes: a separator, a letter, a digit, another sign, and what only the tokenizer itself can tell apart
# (the apostrophe, as "'s" is a unit of its own, controls, and all but ASCII and Latin-1 letters).
_SEPARATOR, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[T.SEPARATOR] = _SEPARATOR
_CLASS[ord("'")] = _OTHER


class UnitIds:
    """Token ids of texts by the tokenizer's own units (words, digits, runs of signs), each of which is encoded once.

    The tokenizer drops white space, lower-cases, and never joins what a change of class separates, so a text's ids are
    those of its units in turn. Runs of non-space bytes with anything but ASCII and Latin-1 letters, or over HASHED_UNIT
    bytes, are encoded whole. Units are known by 64-bit hashes; the table is bounded and shared by a worker's tasks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("units are told apart by the suffix that closes a word; the tokenizer has none")
        vocabulary = self.model.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.table = N.IdTable()

    def _units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case; starts and ends of the units; which of them are whole runs for the tokenizer."""
        kind, low = _CLASS[raw], T.LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] & 0xC0 == 0x80) & (raw[lead + 1] & 0xDF != 0x97)]  # U+00D7 and U+00F7 are no letters
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[raw[lead + 1] < 0x9F]
        low[upper + 1] += 32
        starts, ends = T.word_bounds(raw)
        odd = np.concatenate(([0], np.cumsum(kind == _OTHER)))
        whole = (odd[ends] > odd[starts]) | (ends - starts > N.HASHED_UNIT)
        if whole.any():
            step = np.zeros(len(raw) + 1, np.int8)
            step[starts[whole]], step[ends[whole]] = 1, -1
            inside = np.cumsum(step[:-1]).astype(bool)
            kind[inside] = _OTHER
            low[inside] = raw[inside]
        edge = np.ones(len(raw), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(raw))
        real = kind[first] != _SEPARATOR
        return low, first[real], last[real], kind[first[real]] == _OTHER

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, keys: np.ndarray) -> None:
        """Encodes distinct units: the whole runs one by one, the others joined by spaces, as each ends with an id that closes a word."""
        for lo in range(0, int((~whole).sum()), 4000):
            some = np.flatnonzero(~whole)[lo : lo + 4000]
            lens = ends[some] - starts[some]
            text = np.full(int(lens.sum()) + len(some), 32, np.uint8)
            text[N.slices(np.cumsum(lens + 1) - lens - 1, lens)] = low[N.slices(starts[some], lens)]
            ids = np.array(self.encode([text.tobytes().decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            close = np.flatnonzero(self.closing[ids]) + 1
            if len(close) != len(some):
                raise ValueError("a unit is not closed by one id")
            self.table.add(keys[some], np.diff(close, prepend=0), ids)
        some = np.flatnonzero(whole)
        for lo in range(0, len(some), 4000):
            part = some[lo : lo + 4000]
            runs = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            got = [x.ids for x in self.encode(runs, add_special_tokens=False)]
            self.table.add(keys[part], np.array([len(x) for x in got]), np.array([i for x in got for i in x], np.uint32))

    def _buffer(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a buffer, and where each unit starts and its ids end."""
        low, starts, ends, whole = self._units(raw)
        keys = N.unit_hashes(_TERMS[low], starts, ends)
        for i in np.flatnonzero(ends - starts > N.HASHED_UNIT).tolist():
            keys[i] = N.long_hash(low[starts[i] : ends[i]].tobytes())
        entries = self.table.lookup.get(keys)
        if (entries < 0).any():
            missing = np.flatnonzero(entries < 0)
            if self.table.full(len(missing)):
                self.table.clear()
                missing = np.arange(len(keys))
            _, at = np.unique(keys[missing], return_index=True)
            new = missing[at]
            self._learn(low, starts[new], ends[new], whole[new], keys[new])
            entries = self.table.lookup.get(keys)
        return *self.table.ids(entries), starts

    def of_all(self, texts: list[bytes], end_id: int) -> Iterator[bytes]:
        """Each text's ids and the end id, as little-endian uint32."""
        end = struct.pack("<I", end_id)
        for lo, hi in N.groups([len(t) + 1 for t in texts]):
            if hi - lo == 1 and len(texts[lo]) > N.CHUNK:
                yield b"".join(self._buffer(np.frombuffer(part, np.uint8))[0].astype("<u4").tobytes() for part in _at_spaces(texts[lo])) + end
                continue
            ids, closed, starts = self._buffer(np.frombuffer(b" ".join(texts[lo:hi]) + b" ", np.uint8))
            bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            cuts = np.concatenate(([0], closed))[np.searchsorted(starts, np.concatenate(([0], bounds)))]
            raw = ids.astype("<u4").tobytes()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield raw[4 * a : 4 * b] + end


_TERMS = T.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _at_spaces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about N.CHUNK bytes, cut behind separators; a longer run without any stays whole."""
    lo = 0
    while lo < len(text):
        hi = lo + N.CHUNK
        while hi < len(text) and not T.SEPARATOR[text[hi - 1]]:
            hi += 1
        yield text[lo:hi]
        lo = hi


@lru_cache(1)
def unit_ids(path: str) -> UnitIds:
    """One tokenizer and one bounded table for all tasks of a worker process."""
    return UnitIds(path)


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_ids(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), units.of_all(texts, end_id)):
                    for i in range(0, len(ids), 4 * capacity):
                        piece = ids[i : i + 4 * capacity]
                        for to, x in zip(out, (doc, i // (4 * capacity), i // 4, len(piece) // 4, zlib.crc32(piece), piece if keep_ids else None)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to room, as (length, copies).

    Subset sums are the bits of one integer; longer lengths come first and copies are added in powers of two. The sets
    before each addition are kept to read the combination back.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, k = min(counts[size], room // size), 1
        while left > 0:
            k_now = min(k, left)
            steps.append((size, k_now, reach))
            reach |= (reach << (size * k_now)) & mask
            left, k = left - k_now, 2 * k
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + k
            at -= size * k
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, copies), ...]).

    Each bin starts with the longest length left and takes the fullest combination of the others; the same combination
    is repeated while its lengths last. Every step uses up a length or lowers its count below what a bin needs, so the
    work follows the number of different lengths (at most capacity), not the number of pieces.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    bins = []
    while left:
        top = max(left)
        rest = {s: n - (s == top) for s, n in left.items() if n > (s == top)}
        content = dict(fullest(rest, capacity - top))
        content[top] = content.get(top, 0) + 1
        times = min(left[s] // k for s, k in content.items())
        bins.append((times, sorted(content.items(), reverse=True)))
        for s, k in content.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return bins


@dataclass(frozen=True)
class PackingConfig:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    #: Pieces of one length are numbered in buckets of about this many.
    rows_per_bucket: int = 500_000
    min_buckets: int = 64


def tokenized_pieces(docs: DataFrame, conf: PackingConfig, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """doc, piece, start, length, ids_crc32, ids (little-endian uint32): each text's ids, the end id, cut at capacity."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(released(_pieces(conf.tokenizer, conf.capacity, conf.end_id, keep_ids)), "doc long, piece int, start long, length long, ids_crc32 long, ids binary")


def assign(pieces: DataFrame, conf: PackingConfig) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table with a column length, 1 to capacity).

    Only the histogram of lengths (at most capacity rows) reaches the driver. Pieces of one length are numbered by
    bucket, so a length that a third of all pieces share is spread over many tasks; the number then leads to a bin
    through a table that has one row per kind of bin and length in it.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    buckets = max(conf.min_buckets, -(-max(histogram.values(), default=0) // conf.rows_per_bucket))
    slots, first_bin, used = [], 0, dict.fromkeys(histogram, 0)
    for times, content in plan_bins(histogram, conf.capacity):
        offset = 0
        for length, copies in content:
            slots.append((length, used[length], used[length] + times * copies, times, first_bin, offset))
            used[length] += times * copies
            offset += length * copies
        first_bin += times
    assert used == histogram and total == sum(used.values())
    table: dict[int, np.ndarray] = {}
    for s in slots:
        table.setdefault(s[0], []).append(s[1:])
    table = {k: np.array(v, np.int64) for k, v in table.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by capacity, whatever the input: rows per kind of bin and length

    salted = pieces.withColumn("_b", F.pmod(F.xxhash64("doc", "piece", "ids_crc32", "_row"), F.lit(buckets)).cast("int"))
    sums = salted.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_b").orderBy("doc", "piece", "ids_crc32", "_row")
    ranked = salted.withColumn("_r", F.row_number().over(within)).join(starts, ["length", "_b"]).withColumn("_rank", F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start", "_row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                rows, spec = np.flatnonzero(length == size), shared.value[int(size)]
                k = spec[np.searchsorted(spec[:, 0], rank[rows], side="right") - 1]
                inner = rank[rows] - k[:, 0]
                seq[rows] = k[:, 3] + inner % k[:, 2]
                off[rows] = k[:, 4] + (inner // k[:, 2]) * size
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(seq), pa.array(off)], keep + ["sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(released(place), f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, conf: PackingConfig, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if wanted.

    Texts are tokenized whole and end with conf.end_id; those over conf.capacity are cut into pieces of that length.
    Minimum bin slack then fills sequences of at most conf.capacity ids. Defined cases: a null, empty or blank text is
    its end id alone; a null id is kept as null; repeated rows are packed one by one; other columns are ignored; an
    empty table gives an empty table.
    """
    cut = tokenized_pieces(docs, conf, id_col, text_col, keep_ids=keep_ids).withColumn("_row", F.monotonically_increasing_id())
    pieces = written(cut if keep_ids else cut.drop("ids"), "pieces")  # written once: a row's number must not change later
    placed = assign(pieces, conf).withColumnRenamed("doc", id_col)
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
