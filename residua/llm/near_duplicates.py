"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact check, star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import discard, group_extreme, released, written
from .components import connected_components

BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: How many of a row's best candidates inside one block each pass verifies; the last pass leaves none out.
WAVES = (8, 1 << 30)


@dataclass(frozen=True)
class NearDuplicateConfig:
    """Documents link when percent * |union| <= 100 * |intersection| of their shingle sets.

    bands * rows minima: a pair at similarity s shares a band with probability 1 - (1 - s**rows)**bands; at 0.8 the
    defaults miss one pair in 2.7 million, and components rest on more than one pair. slack: pairs whose signatures
    agree in fewer than percent / 100 - slack of all places (over four standard deviations) skip the exact check.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    slack: float = 0.16
    seed: int = 17

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.Generator(np.random.PCG64(self.seed))
        n = self.bands * self.rows
        return r.integers(0, 1 << 63, n, dtype=np.uint64) * T.U(2) + T.U(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest (a * x + b) mod 2**64 >> 32 over the set for each of the universal hash functions."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048]
        for j in range(0, len(a), 36):
            h = a[j : j + 36, None] * x[None, :] + b[j : j + 36, None]
            np.minimum(out[j : j + 36], h.min(axis=1) >> T.U(32), out=out[j : j + 36])
    return out.astype(np.uint32)


def shingles_of(text: str | bytes | None, k: int) -> np.ndarray:
    return T.shingle_set(T.word_hashes(T.LOWER[T.as_bytes(text)]), k)


def _sketches(conf: NearDuplicateConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = conf.coefficients()
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sizes, prints, sigs, bands = [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles_of(text, conf.shingle_words)
                    m = T.mix(s ^ T.U(0xA0761D6478BD642F))
                    key = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(m) if len(m) else 0, len(s)], np.uint64).tobytes()
                    if key not in memo:
                        if len(memo) > 5000:
                            memo.clear()
                        if len(s):
                            sig = minima(s, a, b)
                            low = sig.astype(np.uint16)  # signatures and bands rest on the same bits
                            memo[key] = (low.tobytes(), T.windows(low.astype(np.uint64), conf.rows)[:: conf.rows].astype(np.int64))
                        else:
                            memo[key] = (b"", np.empty(0, np.int64))
                    sizes.append(len(s))
                    prints.append(key)
                    sigs.append(memo[key][0])
                    bands.append(memo[key][1])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
                values = np.concatenate(bands) if bands else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    ["id", "n_shingles", "print", "sig", "bands"],
                )

    return run


def _agreeing(conf: NearDuplicateConfig):
    """Keeps the pairs whose signatures agree often enough."""
    floor = (conf.percent / 100 - conf.slack) * conf.bands * conf.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            same = [int((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).sum()) >= floor for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(same, pa.bool_()))

    return run


def _linked(conf: NearDuplicateConfig):
    """Keeps the pairs whose full shingle sets overlap enough: the exact condition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in known:
                if len(known) >= 64:
                    known.clear()
                known[text] = shingles_of(text, conf.shingle_words)
            return known[text]

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ok = []
                for x, y in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).cast(pa.binary()).to_pylist()):
                    p, q = of(x), of(y)
                    both = T.overlap(p, q)
                    ok.append(100 * both >= conf.percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, conf: NearDuplicateConfig) -> DataFrame:
    """Those of the pairs (u, v) that link: first by signatures, then on the full sets of both texts."""
    left = pairs.join(sketches.select(F.col("id").alias("u"), F.col("sig").alias("x")), "u")
    both = left.join(sketches.select(F.col("id").alias("v"), F.col("sig").alias("y")), "v")
    pairs = both.select("u", "v", "x", "y").mapInArrow(released(_agreeing(conf)), "u long, v long")
    left = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("y")), "v")
    both = left.join(texts.select(F.col("id").alias("u"), F.col("text").alias("x")), "u")
    return both.select("u", "v", "x", "y").mapInArrow(released(_linked(conf)), "u long, v long")


def _cross_candidates(conf: NearDuplicateConfig, most: int):
    """Of one block pair of a bucket: visiting rows against resident rows of other components, by signatures.

    A pair is found once: in the first band its rows share, by the one outside the commonest component, or by the larger
    id if both are. One row per document that has or is a candidate: mates lists a visitor's best ones, most similar
    first, and more tells that it has others besides. No row per pair is made.
    """
    width = conf.bands * conf.rows
    floor = (conf.percent / 100 - conf.slack) * width

    def run(table: pa.Table) -> pa.Table:
        ids, comps, here, minor = (table.column(c).to_numpy() for c in ("id", "comp", "resident", "minor"))
        band = table.column("band")[0].as_py()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), width)
        rest = np.flatnonzero(here)
        mates: dict[int, list[int]] = {}
        known, full = dict(zip(ids.tolist(), comps.tolist())), set()
        for i in np.flatnonzero(~here):
            equal = sigs[rest] == sigs[i]
            same = equal.sum(axis=1)
            open_ = np.flatnonzero((same >= floor) & (comps[rest] != comps[i]) & (~minor[rest] | (ids[rest] < ids[i])))
            shares = equal[open_].reshape(len(open_), conf.bands, conf.rows).all(axis=2)
            open_ = open_[shares[:, band] & ~shares[:, :band].any(axis=1)]
            if not len(open_):
                continue
            own = int(ids[i])
            if len(open_) > most:
                full.add(own)
            near = ids[rest[open_[np.lexsort((ids[rest[open_]], -same[open_]))][:most]]].tolist()
            mates.setdefault(own, []).extend(near)
            for j in near:
                mates.setdefault(j, [])
        out = list(mates)
        cell = {c: pa.array([table.column(c)[0].as_py()] * len(out), t) for c, t in (("band", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))}
        return pa.table(cell | {"id": pa.array(out, pa.int64()), "comp": pa.array([known[k] for k in out], pa.int64()), "mates": pa.array([mates[k] for k in out], pa.list_(pa.int64())), "more": pa.array([k in full for k in out], pa.bool_())})

    return run


CELL = "band int, key long, i int, j int, id long, comp long, mates array<long>, more boolean"


def _cell_links(conf: NearDuplicateConfig):
    """Of one block pair with its texts: the exact check of every listed pair not yet tied, and the links that tie."""

    def run(table: pa.Table) -> pa.Table:
        texts, mates, tie = {}, {}, {}
        for own, comp, near, text in zip(*(table.column(c).to_pylist() for c in ("id", "comp", "mates")), table.column("text").cast(pa.binary()).to_pylist()):
            texts.setdefault(own, []).append(text)  # an id may hold several texts; any of them links
            mates[own] = near
            tie[own] = comp
        root: dict[int, int] = {}
        sets: dict[int, list[np.ndarray]] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        def of(own: int) -> list[np.ndarray]:
            if own not in sets:
                sets[own] = [shingles_of(t, conf.shingle_words) for t in texts.pop(own)]
            return sets[own]

        def linked(p: np.ndarray, q: np.ndarray) -> bool:
            if 100 * min(len(p), len(q)) < conf.percent * max(len(p), len(q)):
                return False
            both = T.overlap(p, q)
            return 100 * both >= conf.percent * (len(p) + len(q) - both)

        us, vs = [], []
        for rank in range(max(map(len, mates.values()), default=0)):
            for own, near in mates.items():
                if rank >= len(near):
                    continue
                mate = near[rank]
                x, y = top(tie[own]), top(tie[mate])
                if x != y and any(linked(p, q) for p in of(own) for q in of(mate)):
                    root[max(x, y)] = min(x, y)
                    us.append(min(own, mate))
                    vs.append(max(own, mate))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still hold rows of several components, cut into block pairs.

    A bucket's residents are all its rows; its visitors are the rows outside its commonest component (smallest id on
    ties). Both sides are cut by hash into blocks of about BLOCK rows and at most about BLOCK_SHINGLES shingles, so no
    task holds a whole bucket.
    """
    now = members.join(labels, members["id"] == labels["node"], "left").select("band", "key", "id", "size", F.coalesce("component", "id").alias("comp"))
    sizes = now.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    buckets = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("total"), F.sum("s").alias("shingles"), F.max(F.struct("n", (-F.col("comp")).alias("least"), "s")).alias("main"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.where("comps > 1 and total > 2").select(F.col("band").alias("_b"), F.col("key").alias("_k"), blocks(F.col("total"), F.col("shingles")).alias("_i"), blocks(F.col("total") - F.col("main.n"), F.col("shingles") - F.col("main.s")).alias("_j"), (-F.col("main.least")).alias("main"))
    rows = now.join(buckets, (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k")))
    spot = F.xxhash64("id")
    cells = "band", "key", "id", "comp"
    resident = rows.select(*cells, F.pmod(spot, F.col("_i")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("j"), F.lit(True).alias("resident"), (F.col("comp") != F.col("main")).alias("minor"))
    visitor = rows.where("comp <> main").select(*cells, F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("i"), F.pmod(spot, F.col("_j")).cast("int").alias("j"), F.lit(False).alias("resident"), F.lit(True).alias("minor"))
    return resident.unionAll(visitor)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: NearDuplicateConfig = NearDuplicateConfig()) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds the distinct runs of conf.shingle_words words.

    1. Rows with equal sets form a class; its smallest id stands for it (salted, so a class may hold any share of rows).
    2. In each bucket of each band, every representative is paired with the bucket's smallest id only; pairs pass a
       signature check and then the exact check on full sets; verified links give components.
    3. Buckets that still hold several components are searched for links between components, block by block against
       their minority rows, most similar candidates first, until no pass has an unchecked candidate left. Candidates
       stay lists inside their block, which checks them on full sets and returns only the links that tie components;
       rows already in one component are never paired again.

    Defined cases: null, empty or blank text: n_shingles 0, linked with nothing, kept. A null id: component_id null,
    kept, linked with nothing. Rows that repeat an id are one node: linked if any of their texts is. Other columns are
    ignored. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(base.mapInArrow(released(_sketches(conf)), "id long, n_shingles long, print binary, sig binary, bands array<long>"), "sketch")
    real = sketch.where("n_shingles > 0 and id is not null")
    classes = written(group_extreme(real.select("id", "n_shingles", "print"), ["print"], "id", "rep"), "classes")
    heads = classes.where("id = rep").select("id", "print").distinct()
    reps = written(real.join(heads, ["id", "print"]).dropDuplicates(["id", "print"]).select("id", F.col("n_shingles").alias("size"), "sig", "bands"), "reps")
    single = written(sketch.where("n_shingles = 0 or id is null").select("id", "n_shingles"), "single")
    discard(sketch)
    members = reps.select("id", "size", F.posexplode("bands").alias("band", "key"))
    slots = written(group_extreme(members, ["band", "key"], "id", "u", count="n").where("n > 1").select("band", "key", "id", "size", "u"), "slots")
    light = reps.select("id", "sig")
    texts = written(base.join(slots.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    stars = written(slots.where("u < id").select("u", F.col("id").alias("v")).distinct(), "stars")
    # an id whose rows hold different texts stands in several classes, which it ties together
    several = classes.groupBy("id").agg(F.countDistinct("print").alias("_c")).where("_c > 1").select("id")
    twins = classes.where("id <> rep").join(several, "id").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    links = written(_verify(stars, light, texts, conf).unionAll(twins).distinct(), "links")
    labels = connected_components(links)
    for most in WAVES:
        cells = _open_buckets(slots, labels).join(light, "id").groupBy("band", "key", "i", "j")
        listed = written(cells.applyInArrow(_cross_candidates(conf, most), CELL), "listed")
        fresh = written(listed.join(texts, "id").groupBy("band", "key", "i", "j").applyInArrow(_cell_links(conf), "u long, v long").distinct(), "fresh")
        if not fresh.isEmpty():
            # the labels are a finished star forest, so only what the new links tie is stepped again
            labels = connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(fresh))
        over = listed.where("more").isEmpty()
        discard(listed)
        if over:
            break
    labels = written(labels, "labels")
    discard(slots, texts, reps, stars, links)
    placed = classes.join(labels, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    whole = placed.unionAll(single.select("id", "n_shingles", F.col("id").alias("component_id")))
    return whole.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
