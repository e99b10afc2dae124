"""Local image descriptors: find images of which a query is a cropped or edited copy.

Corners at several scales, binary tests turned to each corner's orientation (256 bits), Hamming tables joined by Spark,
and a similarity transform on which the matched corners of two pictures must agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import checked, discard, group_extreme, written


@dataclass(frozen=True)
class DescriptorConfig:
    #: The strongest corners of each scale are described; a picture's weaker ones are not, at any size of the tables.
    corners: int = 30
    scales: tuple[float, ...] = (1.0, 1.25, 1.6)
    radius: int = 16
    angles: int = 72
    #: Each table is keyed by 32 // tables bytes of the 32.
    tables: int = 6
    #: Corners of a query that must meet corners of an image in some table before the two pictures are compared whole.
    min_meets: int = 2
    #: A corner matches the nearest corner of the other picture, if at most so many bits differ.
    max_distance: int = 48
    #: Corners that must agree on one rotation, scale and shift, within so many pixels.
    min_inliers: int = 8
    tolerance: float = 3.0
    seed: int = 5


def _box(img: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1)**2 pixels, edges repeated."""
    c = np.cumsum(np.cumsum(np.pad(img, ((r + 1, r), (r + 1, r)), mode="edge"), axis=0), axis=1)
    n = 2 * r + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)


def _resized(img: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1.0:
        return img
    h, w = max(1, int(img.shape[0] / factor)), max(1, int(img.shape[1] / factor))
    y, x = (np.arange(h) + 0.5) * factor - 0.5, (np.arange(w) + 0.5) * factor - 0.5
    y0, x0 = np.clip(y.astype(int), 0, img.shape[0] - 1), np.clip(x.astype(int), 0, img.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    return (img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx) * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy


class Describer:
    """Descriptors of one grey image: rows of (x, y, turn in radians, scale) and 256-bit strings."""

    def __init__(self, conf: DescriptorConfig):
        self.conf = conf
        r = np.random.Generator(np.random.PCG64(conf.seed))
        pairs = r.normal(0, conf.radius / 2, (256, 2, 2))
        pairs *= np.minimum(1, conf.radius / np.maximum(np.hypot(pairs[..., :1], pairs[..., 1:]), 1e-9))  # inside the disc, however it is turned
        turn = 2 * np.pi * np.arange(conf.angles) / conf.angles
        rot = np.stack((np.stack((np.cos(turn), -np.sin(turn)), -1), np.stack((np.sin(turn), np.cos(turn)), -1)), 1)
        self.tests = np.rint(np.einsum("aij,tpj->atpi", rot, pairs)).astype(int)  # angle, test, point, (x, y)
        g = np.arange(-conf.radius, conf.radius + 1)
        self.gx, self.gy = np.meshgrid(g, g)
        self.disc = self.gx**2 + self.gy**2 <= conf.radius**2

    def describe(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        conf, places, bits = self.conf, [], []
        for scale in conf.scales:
            img = _resized(image.astype(float), scale)
            pad = conf.radius + 1
            if min(img.shape) < 2 * pad + 3:
                continue
            gy, gx = np.gradient(_box(img, 1))
            a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
            response = a * b - c * c - 0.05 * (a + b) ** 2
            inner = response[pad:-pad, pad:-pad]
            peak = inner.copy()
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    np.maximum(peak, response[pad + dy : response.shape[0] - pad + dy, pad + dx : response.shape[1] - pad + dx], out=peak)
            ys, xs = np.nonzero((inner == peak) & (inner > 1e-3 * max(inner.max(), 1e-9)))
            best = np.argsort(-inner[ys, xs], kind="stable")[: conf.corners]
            ys, xs = ys[best] + pad, xs[best] + pad
            if not len(ys):
                continue
            smooth = _box(img, 2)
            patch = smooth[ys[:, None, None] + self.gy, xs[:, None, None] + self.gx] * self.disc
            turn = np.arctan2((patch * self.gy).sum((1, 2)), (patch * self.gx).sum((1, 2)))
            t = self.tests[np.rint(turn / (2 * np.pi) * conf.angles).astype(int) % conf.angles]
            at = lambda p: smooth[ys[:, None] + t[:, :, p, 1], xs[:, None] + t[:, :, p, 0]]  # noqa: B023,E731
            bits.append(np.packbits(at(0) < at(1), axis=1))
            places.append(np.stack((xs * scale, ys * scale, turn, np.full(len(xs), scale)), 1))
        if not bits:
            return np.empty((0, 4)), np.empty((0, 32), np.uint8)
        return np.concatenate(places), np.concatenate(bits)


def render_vector(vec: np.ndarray | None, cell: int = 10) -> np.ndarray:
    """A grey picture of a vector: a square grid of cells, as bright as the components' places in its range."""
    v = np.nan_to_num(np.asarray(vec if vec is not None else [], float))
    side = int(np.ceil(np.sqrt(len(v)))) if len(v) else 0
    if not side:
        return np.zeros((1, 1), np.uint8)
    grid = np.zeros(side * side)
    span = float(np.ptp(v)) or 1.0
    grid[: len(v)] = (v - v.min()) / span
    return np.kron(np.rint(grid.reshape(side, side) * 15) * 16, np.ones((cell, cell))).astype(np.uint8)


def edited_copy(image: np.ndarray, key: int) -> np.ndarray:
    """A copy that is cropped, turned by a quarter, brightened and noisy, all by the key."""
    r = np.random.Generator(np.random.PCG64(key))
    h, w = image.shape
    y, x = (int(r.integers(0, max(1, n // 5))) for n in (h, w))
    out = image[y : y + h - h // 6, x : x + w - w // 6].astype(float)
    out = np.rot90(out, int(r.integers(0, 4))) * r.uniform(0.75, 1.1) + r.uniform(-8, 20)
    return np.clip(out + r.normal(0, 3, out.shape), 0, 255).astype(np.uint8)


def consensus(places: np.ndarray, bits: np.ndarray, q_places: np.ndarray, q_bits: np.ndarray, conf: DescriptorConfig) -> int:
    """Query corners that agree on one similarity transform into the other picture: every match proposes the transform of
    its own place, turn and scale; the best is fitted anew to those that it explains."""
    if not len(bits) or not len(q_bits):
        return 0
    words, q_words = (np.ascontiguousarray(b).view(np.uint64) for b in (bits, q_bits))
    apart = np.bitwise_count(q_words[:, None] ^ words[None]).sum(axis=2, dtype=np.int32)
    near = apart.argmin(axis=1)
    q = np.flatnonzero(apart[np.arange(len(q_words)), near] <= conf.max_distance)
    if len(q) < conf.min_inliers:
        return 0
    here, there = q_places[q], places[near[q]]
    z, w = here[:, 0] + 1j * here[:, 1], there[:, 0] + 1j * there[:, 1]
    factor = there[:, 3] / here[:, 3] * np.exp(1j * (there[:, 2] - here[:, 2]))
    off = np.abs(factor[:, None] * (z[None] - z[:, None]) + w[:, None] - w[None]) <= 2 * conf.tolerance
    agree, most = off[off.sum(axis=1).argmax()], 0
    for _ in range(3):
        mz, mw = z[agree].mean(), w[agree].mean()
        spread = (np.abs(z[agree] - mz) ** 2).sum()
        if not spread:
            break
        f = (np.conj(z[agree] - mz) * (w[agree] - mw)).sum() / spread
        agree = np.abs(f * (z - mz) + mw - w) <= conf.tolerance
        if not agree.any():
            break
        # a corner found at several scales is one place
        most = max(most, len(np.unique(np.rint(np.stack((z[agree].real, z[agree].imag)) / 2), axis=1).T))
    return most


def _described(conf: DescriptorConfig, picture: Callable):
    """A row per picture: its corners' places (float32 x, y, turn, scale) and bits one after the other, and their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = Describer(conf), 32 // conf.tables
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                cols: list[list] = [[], [], [], []]
                for key, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    places, bits = own.describe(picture(source, key))
                    keys = np.zeros((len(bits), conf.tables, 8), np.uint8)
                    keys[:, :, :width] = bits[:, : conf.tables * width].reshape(len(bits), conf.tables, width)
                    for to, v in zip(cols, (key, places.astype("<f4").tobytes(), bits.tobytes(), keys.view("<i8").ravel())):
                        to.append(v)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "places", "bits", "keys"])

    return run


SCHEMA = "id long, places binary, bits binary, keys array<long>"


def _compared(conf: DescriptorConfig):
    read = lambda places, bits: (np.frombuffer(places, "<f4").reshape(-1, 4).astype(float), np.frombuffer(bits, np.uint8).reshape(-1, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n = [consensus(*read(a, b), *read(c, d), conf) for a, b, c, d in zip(*(part.column(i).to_pylist() for i in range(2, 6)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["query_id", "image_id", "inliers"])

    return run


def find_copies(images: DataFrame, queries: DataFrame, picture: Callable, query_picture: Callable, conf: DescriptorConfig = DescriptorConfig(), classes: DataFrame | None = None) -> DataFrame:
    """(query_id, image_id, inliers): the images of which a query picture shows an edited part.

    images, queries: columns id (long) and source; picture(source, id) gives a grey array. Images with equal pixels are
    one class and image_id is its smallest id, so copies cost one search; copies_and_members() gives the members too, classes is what image_classes() gave.
    Descriptors meet in conf.tables tables, each keyed by bits of its own; only keys are shuffled, and what meets is
    reduced to a bit mask of query corners per pair of pictures before the next shuffle. Pairs with conf.min_meets
    corners are compared whole (consensus()).

    Defined cases: pictures without corners (blank, tiny, null source) match nothing; null ids are ignored; of rows that
    repeat an id with different sources the least source (as an ordered value) is the image or query; empty tables give
    an empty table; other columns are ignored.
    """
    classes = image_classes(images, picture) if classes is None else classes
    one = lambda df: df.where("id is not null").groupBy("id").agg(F.min("source").alias("source"))
    index = written(one(images).join(classes.where("id = image_id").select("id").distinct(), "id", "left_semi").select("id", "source").mapInArrow(_described(conf, picture), SCHEMA), "index")
    asked = written(one(queries).select("id", "source").mapInArrow(_described(conf, query_picture), SCHEMA), "asked")
    tables = F.lit(conf.tables)
    spread = lambda df: df.select("id", F.posexplode("keys").alias("at", "key"))
    keys = spread(index).select(F.col("id").alias("image_id"), (F.col("at") % tables).cast("byte").alias("table"), "key")
    corner = F.floor(F.col("at") / tables).cast("int")
    wanted = spread(asked).select(F.col("id").alias("query_id"), (F.col("at") % tables).cast("byte").alias("table"), "key", (corner % 128).alias("bit"))
    low, high = F.when(F.col("bit") < 64, F.expr("shiftleft(1L, bit)")).otherwise(0), F.when(F.col("bit") >= 64, F.expr("shiftleft(1L, bit - 64)")).otherwise(0)
    met = keys.join(wanted, ["table", "key"]).groupBy("query_id", "image_id").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))
    pairs = written(met.where(F.bit_count("low") + F.bit_count("high") >= conf.min_meets).select("query_id", "image_id"), "pairs")
    full = pairs.join(index.select(F.col("id").alias("image_id"), "places", "bits"), "image_id")
    full = full.join(checked(asked.select(F.col("id").alias("query_id"), F.col("places").alias("q_places"), F.col("bits").alias("q_bits")), 10_000), "query_id")
    out = full.select("query_id", "image_id", "places", "bits", "q_places", "q_bits").mapInArrow(_compared(conf), "query_id long, image_id long, inliers long")
    found = written(out.where(F.col("inliers") >= conf.min_inliers), "found")
    for done in (index, asked, pairs):
        discard(done)
    return found


def copies_and_members(images: DataFrame, queries: DataFrame, picture: Callable, query_picture: Callable, conf: DescriptorConfig = DescriptorConfig()) -> DataFrame:
    """(query_id, image_id, inliers, member_id): the pairs of find_copies(), where member_id is null, and one row per
    image id with its class in image_id and query_id and inliers null. A query's images are the members of its image_ids;
    they are not multiplied out, as that grows with the square of a large class."""
    classes = image_classes(images, picture)
    pairs = find_copies(images, queries, picture, query_picture, conf, classes).withColumn("member_id", F.lit(None).cast("long"))
    members = classes.distinct().select(F.lit(None).cast("long").alias("query_id"), "image_id", F.lit(None).cast("long").alias("inliers"), F.col("id").alias("member_id"))
    return pairs.unionByName(members)


def image_classes(images: DataFrame, picture: Callable) -> DataFrame:
    """(id, image_id): image_id is the smallest id of those with equal pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                img = picture(source, key)
                prints.append(hashlib.sha1(repr(img.shape).encode() + img.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "print"])

    prints = images.where("id is not null").select("id", "source").mapInArrow(run, "id long, print binary")
    return written(group_extreme(prints, ["print"], "id", "image_id"), "classes").select("id", "image_id")
