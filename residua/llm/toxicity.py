"""Toxicity: gradient-boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import checked, discard, released, written

# Second-person words of English, German, French and Spanish; digits and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LETTER_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
#: Longer words are read whole each time they occur.
CACHED_BYTES = 256
_PRONOUN, _CAPS, _OBSCURED, _STRETCHED = (1 << b for b in (20, 21, 22, 23))

FEATURES = (
    "log_hits", "hits_per_100", "distinct_hits", "weight_max", "weight_per_100", "hits_near_second_person", "second_person_per_100",
    "upper_share", "caps_per_100", "exclaim_per_1000", "punctuation_per_1000", "obscured_per_100", "stretched_per_100", "log_words",
)


@dataclass(frozen=True)
class ToxicityConfig:
    #: At most about this many labelled rows are read for fitting, chosen by a hash of the id.
    max_train_docs: int = 20_000
    max_lexicon: int = 4_000
    #: Log-likelihood ratio and share of toxic texts that a term needs to enter the lexicon.
    min_ratio: float = 20.0
    min_share: float = 0.6
    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    near: int = 5


def plain(word: str) -> str:
    """A word without what is not a letter at its ends, in lower case."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, which stand for inflected forms."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]] if len(word) > 2 else []


class Codes(dict):
    """A number per raw word: the term it matches (its place in the lexicon plus 1) and flags."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.place = {t: i + 1 for i, t in enumerate(lexicon)}
        self.weights = np.array([0.0, *lexicon.values()])

    def match(self, word: str) -> int:
        return max((self.place.get(t, 0) for t in terms_of(word)), key=lambda i: self.weights[i], default=0)

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = raw.decode("utf-8", "replace")
        word = plain(text)
        code = self.match(word)
        if not word.isalpha():
            read = "".join(c for c in text.lower().translate(LETTER_SIGNS) if c.isalpha())
            if read != word and (hidden := self.match(read)) and not code:
                code = hidden | _OBSCURED
        if word in SECOND_PERSON:
            code |= _PRONOUN
        if len(word) > 2 and text.upper() == text:
            code |= _CAPS
        if any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            code |= _STRETCHED
        if len(raw) <= CACHED_BYTES:
            self[raw] = code
        return code


def features_of(text: bytes | None, codes: Codes, near: int) -> np.ndarray:
    """FEATURES of one whole text; zeros without words."""
    words = text.split() if text else []
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    term = code & (_PRONOUN - 1)
    at = np.flatnonzero(term)
    per = 100.0 / n
    you = np.flatnonzero(code & _PRONOUN)
    close = 0
    if len(at) and len(you):
        i = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - at), np.abs(at - you[np.maximum(i - 1, 0)]))
        close = int((gap <= near).sum())
    buf = np.frombuffer(text, np.uint8)
    upper = int(((buf >= 65) & (buf <= 90)).sum())
    letters = upper + int(((buf >= 97) & (buf <= 122)).sum())
    signs = ((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64))
    weights = codes.weights[term[at]]
    out[:] = (
        np.log1p(len(at)), len(at) * per, len(np.unique(term[at])), weights.max(initial=0.0), weights.sum() * per, close * per, len(you) * per,
        upper / max(letters, 1), int(((code & _CAPS) > 0).sum()) * per, int(((buf == 33) | (buf == 63)).sum()) * 1000 / len(buf), int(signs.sum()) * 1000 / len(buf),
        int(((code & _OBSCURED) > 0).sum()) * per, int(((code & _STRETCHED) > 0).sum()) * per, np.log1p(n),
    )
    return out


@dataclass
class Trees:
    """Depth-limited regression trees on logistic loss, over features cut at quantiles."""

    base: float = 0.0
    rate: float = 0.15
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, conf: ToxicityConfig) -> Trees:
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.rate = float(np.log(p / (1 - p))), conf.rate
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, conf.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [np.unique(np.concatenate((e, [x[x[:, j] > x[:, j].min(), j].min()] if (x[:, j] > x[:, j].min()).any() else []))) for j, e in enumerate(self.edges)]
        b, raw = self.binned(x), np.full(len(y), self.base)
        width = max(len(e) for e in self.edges) + 1
        for _ in range(conf.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(conf.depth):
                split = np.full((1 << level, 2), -1, np.int64)
                best = np.full(1 << level, 1e-6)
                for j in range(x.shape[1]):
                    cell = node * width + b[:, j]
                    gs, hs = (np.bincount(cell, w, minlength=(1 << level) * width).reshape(-1, width) for w in (g, h))
                    gl, hl = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    at = gain.argmax(axis=1)
                    win = gain[np.arange(len(at)), at] > best
                    best[win] = gain[np.arange(len(at)), at][win]
                    split[win] = np.stack((np.full(len(at), j), at), axis=1)[win]
                tree.append(split)
                node = self._down(node, b, split)
            value = np.bincount(node, g, minlength=1 << conf.depth) / (np.bincount(node, h, minlength=1 << conf.depth) + 1)
            self.trees.append((tree, value))
            raw = raw + conf.rate * value[node]
        return self

    @staticmethod
    def _down(node: np.ndarray, b: np.ndarray, split: np.ndarray) -> np.ndarray:
        j, cut = split[node, 0], split[node, 1]
        right = (j >= 0) & (b[np.arange(len(b)), np.maximum(j, 0)] > cut)
        return node * 2 + right

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in tree:
                node = self._down(node, b, split)
            out += self.rate * value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots and the calibrated probability at each."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of raw
    for r, label in zip(raw[order], y[order]):
        blocks.append([float(label), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    n = len(raw)
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 / n) / (b[1] + 1.0 / n) for b in blocks])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    near: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), float(self.values[0]))
        return np.interp(self.trees.raw(x), self.knots, self.values)


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, all_ = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            seen = {t for w in set((text or b"").split()) for t in terms_of(plain(w.decode("utf-8", "replace")))}
            all_.update(seen)
            if label:
                bad.update(seen)
    # terms of clean texts alone can never enter the lexicon, but may meet toxic ones in another task
    names = list(all_)
    for lo in range(0, len(names), 50_000):
        some = names[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([bad[t] for t in some], pa.int64()), pa.array([all_[t] for t in some], pa.int64())], ["term", "bad", "total"])


def learn_lexicon(sample: DataFrame, conf: ToxicityConfig) -> dict[str, float]:
    """Terms that set toxic texts apart: the max_lexicon best by log-likelihood ratio, with their log odds."""
    n = sample.agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("total")).first()
    bad, total = float(n["bad"] or 0), float(n["total"])
    if not 0 < bad < total:
        return {}
    counts = sample.select("text", "label").mapInArrow(released(_term_counts), "term string, bad long, total long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    share = F.col("bad") / F.col("total")
    ratio = 2 * (F.col("bad") * F.log(share / (bad / total)) + F.when(share < 1, (F.col("total") - F.col("bad")) * F.log((1 - share) / (1 - bad / total))).otherwise(0.0))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("total") - F.col("bad") + 0.5) / (total - bad + 1))
    best = counts.where((F.col("bad") >= 4) & (share >= conf.min_share)).select("term", ratio.alias("ratio"), odds.alias("odds")).where(F.col("ratio") >= conf.min_ratio)
    return {r["term"]: r["odds"] for r in best.orderBy(F.desc("ratio"), "term").limit(conf.max_lexicon).collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", conf: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fits on labelled rows outside fold 0, at most about conf.max_train_docs of them.

    The lexicon is learned from the sample; trees are fitted on all of it; isotonic calibration uses scores of trees
    fitted without the row's own fold. With one class only (or no label) the score is the share of toxic rows.

    Defined cases: null ids and null labels are not read; an id labelled twice is toxic if any label says so; of rows that
    repeat an id the least text is read (null before any text), so a sample has one row per id; null and empty texts have
    zero features; columns besides the three named are ignored, whatever their names; ties of terms go by the term.
    """
    rows = labels.select(F.col(id_col).alias("_l"), F.col(label_col).alias("_y")).where("_y is not null and _l is not null").where(fold_of("_l") != 0)
    chosen = rows.groupBy("_l").agg(F.max((F.col("_y") > 0).cast("int")).alias("label")).withColumn("fold", fold_of("_l").cast("int"))
    share = min(1.0, conf.max_train_docs / max(1, chosen.count()))
    chosen = written(chosen.where(F.pmod(F.xxhash64("_l"), F.lit(1_000_000)) < int(share * 1_000_000)), "labels")
    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_text"))
    joined = texts.join(checked(chosen), F.col("_d") == F.col("_l")).groupBy("_l", "label", "fold").agg(F.min(F.coalesce("_text", F.lit(""))).alias("text"))
    sample = written(joined.select("text", "label", "fold"), "sample")
    lexicon = learn_lexicon(sample, conf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lexicon)
        for batch in batches:
            x = [features_of(t, codes, conf.near).tolist() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "fold"])

    got = sample.mapInArrow(released(run), "x array<double>, label int, fold int").toArrow()  # bounded by max_train_docs
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y, fold = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy()
    discard(chosen, sample)
    # the rows come in no fixed order; sums of floats should not depend on it
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]), conf.near)
    raw = np.zeros(len(y))
    for k in np.unique(fold):
        other = fold != k
        raw[~other] = Trees().fit(x[other], y[other], conf).raw(x[~other]) if other.any() and 0 < y[other].sum() < other.sum() else 0.0
    return ToxicityModel(lexicon, Trees().fit(x, y, conf), *isotonic(raw, y), conf.near)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns in keep, and score: the calibrated probability that a whole text is toxic.

    Texts alone are read. Null, empty and blank texts have zero features and their score. Repeated rows get equal
    scores; an empty table gives an empty table.
    """
    base = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    width = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees are bounded by ToxicityConfig

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        codes = Codes(own.lexicon)
        for batch in batches:
            text, scores = batch.column(width), []
            for lo in range(0, batch.num_rows, 500):
                x = np.array([features_of(t, codes, own.near) for t in text.slice(lo, 500).cast(pa.binary()).to_pylist()])
                scores.append(own.scores(x.reshape(-1, len(FEATURES))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names[:width], "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[:width])
    return base.mapInArrow(released(run), f"{ddl}, score double")
