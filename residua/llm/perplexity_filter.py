"""Quality rules: basic text statistics and per-language perplexity bands of a cross-fitted n-gram model of labelled-good text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import ngram_lm as L
from ._cluster import checked, discard, row_key, written

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FACTS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_bytes", "long")]


@dataclass(frozen=True)
class PerplexityBands:
    """A text's log perplexity may lie reach times the distance of its language's quartiles beyond them (least nats at
    least); the width grows by sqrt(1 + short / bytes), as means over few bytes spread more. A language with fewer than
    min_good labelled-good texts in either half has all its texts as reference."""

    reach: float = 3.0
    least: float = 0.15
    short: int = 2000
    min_words: int = 10
    max_repeat_percent: int = 20
    min_good: int = 5


def repeated_words(words: np.ndarray, k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more."""
    h = T.windows(words, k)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def basic_facts(text: bytes) -> tuple[int, int, int, int, int, int]:
    buf = T.as_bytes(text)
    words = T.word_hashes(buf)
    inside = ~T.SEPARATOR[buf] & ((buf & 0xC0) != 0x80)
    seen: set[bytes] = set()
    again = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                again += 1
            elif line.strip():  # the bytes it strips are the word separators
                seen.add(line)
    return len(words), int(inside.sum()), int(_SYMBOL[buf].sum()), again, repeated_words(words), len(text)


def _referenced(base: DataFrame, min_good: int) -> DataFrame:
    """Adds reference, and the (language, half) that a text trains and the one that it is judged by.

    Halves are dealt by the text, so no text, nor an exact copy of it, is judged by a model that was trained on it.
    """
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    code = lambda h: F.concat(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.lit("\x1f"), h.cast("string"))
    halves = base.withColumns({"_train": code(half), "_ask": code(1 - half)})
    good = lambda h: F.sum((F.col("good") & (half == h)).cast("long"))
    rich = base.groupBy(F.col("lang").alias("_glang")).agg((F.least(good(0), good(1)) >= min_good).alias("_rich"))  # one row per language
    wide = halves.join(F.broadcast(rich), F.col("lang").eqNullSafe(F.col("_glang")), "left")
    return wide.withColumn("reference", F.col("good") | ~F.col("_rich")).drop("_glang", "_rich")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: PerplexityBands = PerplexityBands(), good: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, the basic counts, base_failed, log_ppl, lower, upper, kept; and _crc, _size of the text.

    good: a DataFrame whose id_col names labelled-good rows. Texts are dealt into two halves; the whole good texts of a
    half train the model that judges the other half's texts, and each language's band is set on its good texts' values
    (PerplexityBands says when all texts of a language stand in for them, as they do without good). Counts grow with
    the distinct byte n-grams. base_failed: fewer than 10 words, or over a fifth of the words in 5-word windows that the
    text repeats. kept: not base_failed, and log_ppl (mean over bytes, natural log) within the language's band.

    Defined cases: null text counts as empty: all counts 0, base_failed, log_ppl null. A null language is a language of
    its own. A null id is never labelled; null ids and repeated rows are judged like any row; other columns are ignored;
    an empty table gives an empty table.
    """
    marked = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if good is None:
        marked = marked.withColumn("good", F.lit(False))
    else:
        ids = written(good.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_g")).distinct(), "good")
        marked = marked.join(checked(ids), F.col("_id") == F.col("_g"), "left").withColumn("good", F.col("_g").isNotNull()).drop("_g")
    base = _referenced(marked, bands.min_good)
    table = L.resolved(base.where("reference"), base, "_train", "_ask")
    scored = written(L.score(base, table, ["_id", "_crc", "_size", "lang", "reference"], lang_col="_ask", facts=(FACTS, basic_facts)), "scored")
    discard(table)
    limits = L.fences(scored.where("reference"), "lang", "logp_mean", "n_bytes")  # one row per language
    wide = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    room = L.half_width("n_bytes", bands.reach, bands.least, bands.short)
    failed = (F.col("n_words") < bands.min_words) | (100 * F.col("n_repeat_words") > bands.max_repeat_percent * F.col("n_words"))
    log_ppl, lower, upper = -F.col("logp_mean"), -F.col("_hi") - room, -F.col("_lo") + room
    fits = F.coalesce((log_ppl >= lower) & (log_ppl <= upper), F.lit(False))
    return wide.select(
        F.col("_id").alias(id_col), *[n for n, _ in FACTS[:5]], failed.alias("base_failed"), (~failed & fits).alias("kept"),
        log_ppl.alias("log_ppl"), lower.alias("lower"), upper.alias("upper"), "_crc", "_size",
    )
