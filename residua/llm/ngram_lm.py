"""Interpolated modified Kneser-Ney model over byte n-grams: counted, smoothed and joined by Spark.

An n-gram of order k is one long: 23 bits of the language's CRC above k bytes. Counting and scoring read texts in Arrow
batches; smoothing is DataFrame work on distinct n-grams. The model is stored as sorted arrays, a row per shard: an n-gram's
shard hangs on its language and the two bytes before its last, so all orders that score one n-gram lie in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import checked, discard, give_back, released, written
from ._units import groups

ORDER = 5
PAD = np.full(ORDER - 1, 10, np.int64)
SLICE = 1 << 18
FLUSH = 1_000_000
BLOB_BYTES = 1 << 20


def language_code(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) & 0x7FFFFF


def grams(text: bytes, code: int) -> Iterator[np.ndarray]:
    """Keys of the ORDER-grams ending at each byte, in slices of bounded length."""
    for lo in range(0, len(text), SLICE):
        head = PAD if lo == 0 else np.frombuffer(text[lo - ORDER + 1 : lo], np.uint8).astype(np.int64)
        b = np.concatenate((head, np.frombuffer(text[lo : lo + SLICE], np.uint8).astype(np.int64)))
        n = len(b) - ORDER + 1
        key = np.full(n, code, np.int64)
        for j in range(ORDER):
            key = (key << 8) | b[j : n + j]
        yield key


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


class Tally:
    """Counts of n-grams, kept as sorted arrays."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size >= SLICE:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            self.parts.append(runs(np.sort(np.concatenate(self.raw))))
            self.raw, self.size = [], 0
        if len(self.parts) > 12:
            self.parts = [_merge(self.parts)]

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        self.settle()
        out = _merge(self.parts) if self.parts else None
        self.parts = []
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    codes: dict = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    for keys in grams(text, codes.setdefault(lang, language_code(lang))):
                        tally.add(keys)
        if sum(len(p[0]) for p in tally.parts) > FLUSH:
            keys, n = tally.take()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "c"])
    rest = tally.take()
    if rest:
        for lo in range(0, len(rest[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rest[0][lo : lo + 100_000]), pa.array(rest[1][lo : lo + 100_000])], ["key", "c"])


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key, c) over all texts: each task's counts are merged before they are shuffled."""
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(released(_count), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _shorter(key: Column, k: int) -> Column:
    """The k-gram without its oldest byte: a (k - 1)-gram."""
    low = (1 << (8 * (k - 1))) - 1
    return F.shiftleft(F.shiftright(key, 8 * k), 8 * (k - 1)).bitwiseOR(key.bitwiseAND(F.lit(low).cast("long")))


def _discounts(levels: DataFrame) -> DataFrame:
    """Per order and language, the three modified Kneser-Ney discounts; 0.5, 1 and 1.5 where a count of counts is zero."""
    n = levels.groupBy("k", "lang").agg(*[F.sum(F.when(F.col("c") == j, 1).otherwise(0)).cast("double").alias(f"n{j}") for j in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    out = [F.when(whole, F.greatest(F.lit(0.05), F.least(F.lit(float(j)), j - (j + 1) * y * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}"))))).otherwise(F.lit(j / 2)).alias(f"d{j}") for j in (1, 2, 3)]
    return n.select("k", "lang", *out)


def train(counts: DataFrame) -> DataFrame:
    """A written table of all orders k: (k, key, ctx, seen, tot, mass). seen is the discounted count of key; tot and mass are
    its context's sum of counts and of discounts. Lower orders count distinct left neighbours. Every context has at most
    256 successors, so no key is hot."""
    level, parts = counts, []
    for k in range(ORDER, 0, -1):
        parts.append(level.select(F.lit(k).alias("k"), "key", "c", F.shiftright("key", 8 * k).alias("lang")))
        if k > 1:
            level = level.groupBy(_shorter(F.col("key"), k).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    levels = written(reduce(DataFrame.unionAll, parts), "levels")
    rows = levels.join(F.broadcast(_discounts(levels)), ["k", "lang"])  # one row per order and language
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.select("k", "key", F.shiftright("key", 8).alias("ctx"), F.col("c").cast("double").alias("c"), cut.alias("cut"))
    context = Window.partitionBy("k", "ctx")  # at most 256 rows
    stats = written(rows.select("k", "key", "ctx", (F.col("c") - F.col("cut")).alias("seen"), F.sum("c").over(context).alias("tot"), F.sum("cut").over(context).alias("mass")), "stats")
    discard(levels)
    return stats


def _ending(key: Column, n: int) -> Column:
    """The n-gram that ends an ORDER-gram."""
    return F.shiftleft(F.shiftright(key, 8 * ORDER), 8 * n).bitwiseOR(key.bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("long")))


#: Distinct n-grams of a shard, and the least number of shards.
SHARD_ROWS, SHARDS = 200_000, 256
_LOW = {k: np.int64((1 << (8 * k)) - 1) for k in range(1, ORDER)}


def _shard(key: Column, k: int, shards: int) -> Column:
    """Where a k-gram lies (k of 3 or more): by its language and the two bytes before its last one, which the n-grams of all
    orders and their contexts share that one ORDER-gram is scored by."""
    return F.pmod(F.xxhash64(F.shiftright(key, 8 * k), F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFF).cast("long"))), F.lit(shards)).cast("int")


def _pairs(group: pa.Table) -> pa.Table:
    """One language's n-grams of one and two bytes (at most 65,792 rows) as the probability of every byte after every byte."""
    k, key, seen, tot, mass = (group.column(c).to_numpy() for c in ("k", "key", "seen", "tot", "mass"))
    single, lang = k == 1, int(key[0] >> (8 * int(k[0])))
    first = np.full(256, mass[single][0] / 256)
    first[key[single] & 255] += seen[single]
    first /= tot[single][0]
    own, sums, rest = np.zeros((256, 256)), np.ones(256), np.ones(256)  # a byte never followed leaves the single byte's chance
    before = (key[~single] >> 8) & 255
    own[before, key[~single] & 255], sums[before], rest[before] = seen[~single], tot[~single], mass[~single]
    p = (own + rest[:, None] * first) / sums[:, None]
    return pa.table({"pair": (np.int64(lang) << np.int64(16)) | np.arange(1 << 16, dtype=np.int64), "p": p.ravel()})


def _packed(group: pa.Table) -> pa.Table:
    """The shard's n-grams of each order from 3 up as sorted arrays, contexts with their sums beside them."""
    row: dict = {"shard": pa.array([group.column("shard")[0].as_py()], pa.int32())}
    order, key, ctx, seen, tot, mass = (group.column(c).to_numpy() for c in ("k", "key", "ctx", "seen", "tot", "mass"))
    for k in range(3, ORDER + 1):
        at = np.flatnonzero(order == k)
        at = at[np.argsort(key[at], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], ctx[at][1:] != ctx[at][:-1]))) if len(at) else at  # keys in order have contexts in order
        for name, values in (("key", key[at]), ("seen", seen[at]), ("ctx", ctx[at][first]), ("tot", tot[at][first]), ("mass", mass[at][first])):
            row[f"{name}{k}"] = pa.array([values.tobytes()], pa.binary())
    give_back()
    return pa.table(row)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of wanted among sorted_keys."""
    at = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == wanted) if len(sorted_keys) else np.zeros(len(wanted), bool)


def _looked_up(need: pa.Table, store: pa.Table) -> pa.Table:
    """The shard's asked ORDER-grams through its arrays, one order after the other: an order whose context was never seen is left out."""
    key, p = need.column("key").to_numpy(), need.column("p").to_numpy()
    for k in range(3, ORDER + 1) if store.num_rows else ():
        held = {n: np.frombuffer(store.column(f"{n}{k}")[0].as_buffer(), np.int64 if n in ("key", "ctx") else np.float64) for n in ("key", "seen", "ctx", "tot", "mass")}
        gram = key if k == ORDER else ((key >> (8 * ORDER)) << (8 * k)) | (key & _LOW[k])
        at, known = _find(held["key"], gram)
        place, after = _find(held["ctx"], gram >> 8)
        if len(held["key"]):
            seen = np.where(known, held["seen"][at], 0.0)
            p = np.where(after, (seen + held["mass"][place] * p) / held["tot"][place], p)
    return pa.table({"key": key, "logp": np.log(p)})


def store(stats: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables of the model: (pair, p), the chance of each byte after each byte of a language, and one row per shard
    with the n-grams of three bytes and more as sorted arrays."""
    pairs = stats.where("k <= 2").withColumn("lang", F.expr("shiftright(key, 8 * k)")).groupBy("lang").applyInArrow(_pairs, "pair long, p double")
    place = reduce(lambda other, k: F.when(F.col("k") == k, _shard(F.col("key"), k, shards)).otherwise(other), range(3, ORDER), _shard(F.col("key"), ORDER, shards))
    ddl = "shard int, " + ", ".join(f"{name}{k} binary" for k in range(3, ORDER + 1) for name in ("key", "seen", "ctx", "tot", "mass"))
    return written(pairs, "pairs"), written(stats.where("k > 2").withColumn("shard", place).groupBy("shard").applyInArrow(_packed, ddl), "store")


def resolve(need: DataFrame, stats: DataFrame) -> DataFrame:
    """A written table (key, logp) of every key in need: interpolated from uniform bytes up, an order whose context was never
    seen being left out. The asked n-grams meet the pairs' table once and their shard's arrays once. stats is deleted as soon
    as the arrays are written."""
    shards = max(SHARDS, -(-(need.count() + stats.count()) // SHARD_ROWS))
    pairs, arrays = store(stats, shards)
    discard(stats)
    asked = need.select("key", _ending(F.col("key"), 2).alias("_pair"), _shard(F.col("key"), ORDER, shards).alias("shard"))
    asked = asked.join(checked(pairs), F.col("_pair") == F.col("pair"), "left").select("shard", "key", F.coalesce("p", F.lit(1 / 256)).alias("p"))
    out = written(asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(_looked_up, "key long, logp double"), "resolved")
    discard(pairs, arrays)
    return out


def resolved(trusted: DataFrame, docs: DataFrame, train_lang: str = "lang", ask_lang: str = "lang") -> DataFrame:
    """The written table (key, logp) of all n-grams of docs under a model of the texts in trusted. Intermediate tables are
    deleted as soon as the next is written."""
    counts = written(count_ngrams(trusted, lang_col=train_lang), "counts")
    stats = train(counts)
    discard(counts)
    need = written(count_ngrams(docs, lang_col=ask_lang).select("key"), "need")
    table = resolve(need, stats)
    discard(need)
    return table


Facts = tuple[list[tuple[str, str]], Callable[[bytes], tuple]]
_ARROW = {"long": pa.int64(), "double": pa.float64()}


def _rows(lang: pa.Array, text: pa.Array, keys: np.ndarray, logp: np.ndarray, facts: Facts | None) -> list[pa.Array]:
    """The mean log probability of each text, then its facts."""
    columns: list[list] = [[] for _ in range(1 + len(facts[0] if facts else ()))]
    codes: dict = {}
    for lo in range(0, len(lang), 500):
        for x, y in zip(lang.slice(lo, 500).to_pylist(), text.slice(lo, 500).cast(pa.binary()).to_pylist()):
            if x not in codes:
                codes[x] = language_code(x)
            total = 0.0
            for k in grams(y or b"", codes[x]):
                distinct, n = runs(np.sort(k))
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                if not len(keys) or (keys[at] != distinct).any():
                    raise ValueError("an n-gram was not looked up: the texts read differently the second time")
                total += float((logp[at] * n).sum())
            columns[0].append(total / len(y) if y else None)
            for to, value in zip(columns[1:], facts[1](y or b"") if facts else ()):
                to.append(value)
    return [pa.array(c, t) for c, t in zip(columns, [pa.float64(), *[_ARROW[t] for _, t in (facts[0] if facts else ())]])]


def _prepared(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, out: str, facts: Facts | None) -> tuple[DataFrame, list[str], str]:
    base = docs.select(*keep, F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    new = [(out, "double"), *(facts[0] if facts else [])]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(keep)]] + [f"`{n}` {t}" for n, t in new])
    return base, [*base.columns[: len(keep)], *[n for n, _ in new]], ddl


def _blobs(chunks: int):
    """Neighbouring rows as one compressed stream of about BLOB_BYTES, dealt into chunks by its own checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1).cast(pa.binary())), 0).to_pylist()
            for lo, hi in groups(sizes, BLOB_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(lo, hi - lo))
                blob = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(blob) % chunks], pa.int32()), pa.array([blob], pa.binary())], ["_chunk", "_blob"])

    return run


def _unpacked(group: pa.Table) -> Iterator[pa.RecordBatch]:
    for blob in group.column("_blob"):
        yield from pa.ipc.open_stream(blob.as_buffer())


def score(docs: DataFrame, table: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", out: str = "logp_mean", facts: Facts | None = None, chunk_bytes: int = 32 << 20) -> DataFrame:
    """Adds the mean log probability per byte (null without bytes); table must hold every n-gram of docs.

    Texts are dealt, as compressed runs of neighbours, into chunks of about chunk_bytes; each chunk's distinct n-grams are
    joined with the sharded table, and what comes back meets the chunk's texts again as one pair of sorted arrays (one
    shuffle of the texts, used twice). A task holds one chunk at a time, whatever the size of the table; repeated rows
    lie in as many chunks as their bytes need. docs should be a table, whose parts read alike when a task is run again;
    a task that misses an n-gram raises an error."""
    base, names, ddl = _prepared(docs, keep, text_col, lang_col, out, facts)
    volume = base.agg(F.sum(F.octet_length("_text")).alias("b")).first()["b"] or 0
    dealt = base.mapInArrow(released(_blobs(max(1, -(-volume // chunk_bytes)))), "_chunk int, _blob binary")

    def wanted(group: pa.Table) -> pa.Table:
        tally = Tally()
        for batch in _unpacked(group):
            for x, y in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).cast(pa.binary()).to_pylist()):
                for keys in grams(y or b"", language_code(x)):
                    tally.add(keys)
        got = tally.take()
        keys = got[0] if got else np.empty(0, np.int64)
        give_back()
        return pa.table({"_chunk": pa.array(np.full(len(keys), group.column("_chunk")[0].as_py(), np.int32)), "key": pa.array(keys)})

    answers = dealt.groupBy("_chunk").applyInArrow(wanted, "_chunk int, key long").join(table.select("key", F.col("logp").cast("float").alias("logp")), "key")

    def scored(group: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.sort_by("key")
        keys, logp = answer.column("key").to_numpy(), answer.column("logp").to_numpy()
        parts = []
        for batch in _unpacked(group):
            new = _rows(batch.column(len(keep)), batch.column(len(keep) + 1), keys, logp, facts)
            parts.append(pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names))
        give_back()
        return pa.Table.from_batches(parts)

    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(scored, ddl)


def fences(scored: DataFrame, lang: str, value: str, size: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(_lang, _lo, _hi): two quantiles of value per language, over the different (value, size).

    Equal texts have equal values, so a group of copies counts once. Quantiles are read from counts of values rounded to
    0.001: only those counts are gathered, whatever the input.
    """
    once = scored.where(F.col(value).isNotNull()).select(F.col(lang).alias("_lang"), F.round(value, 6).alias("_v"), F.col(size).alias("_s")).distinct()
    cells = once.groupBy("_lang", F.round("_v", 3).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cells.withColumn("_c", F.sum("_n").over(Window.partitionBy("_lang").orderBy("_v"))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_lang")))
    at = lambda q: F.min(F.when(F.col("_c") >= q * F.col("_all"), F.col("_v")))
    return ranked.groupBy("_lang").agg(at(low).alias("_lo"), at(high).alias("_hi"))


def half_width(size: str, reach: float, least: float, short: int) -> Column:
    """How far beyond its quartile a value may lie: reach times the quartiles' distance, wider for short texts."""
    return F.greatest(F.lit(reach) * (F.col("_hi") - F.col("_lo")), F.lit(least)) * F.sqrt(1 + F.lit(float(short)) / F.greatest(F.col(size), F.lit(1)))
