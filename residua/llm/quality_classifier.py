"""Quality classifier: perplexity under an n-gram model of trusted text, by sharded count joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_lm as L
from ._cluster import checked, discard, row_key, written


@dataclass(frozen=True)
class TrustedQuantiles:
    """The threshold of a language: its trusted texts' upper quantile of log perplexity plus reach times the distance of
    the two quantiles (least nats at least), wider for short texts by sqrt(1 + short / bytes)."""

    low: float = 0.25
    high: float = 0.75
    reach: float = 4.0
    least: float = 0.2
    short: int = 300


def trusted_perplexity(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", conf: TrustedQuantiles = TrustedQuantiles()) -> DataFrame:
    """One row per input row: id, trusted, log_ppl (mean over bytes), threshold, kept.

    trusted: a DataFrame whose id_col names the trusted rows. Their whole texts train the model; every text of docs is
    then scored: its n-grams, merged per chunk of texts, are joined with the sharded tables (with back-off for those
    the model lacks). A language without trusted texts uses the strictest quantiles seen over all languages together.

    Defined cases: a null, empty text has log_ppl null and is not kept. Without any trusted text every byte is equally
    likely and nothing has a threshold: all non-empty texts are kept. A null id is never trusted. Repeated rows get a
    row each; other columns are ignored; an empty table gives an empty table.
    """
    ids = written(trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_t")).distinct(), "trusted")
    own = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    base = own.join(checked(ids), F.col("_id") == F.col("_t"), "left").withColumn("trusted", F.col("_t").isNotNull()).drop("_t")
    table = L.resolved(base.where("trusted"), base)
    scored = written(L.score(base, table, ["_id", "_size", "lang", "trusted"]), "scored")
    discard(ids, table)
    known = scored.where("trusted")
    per_lang = L.fences(known, "lang", "logp_mean", "_size", 1 - conf.high, 1 - conf.low)
    everywhere = L.fences(known.withColumn("lang", F.lit("")), "lang", "logp_mean", "_size", 1 - conf.high, 1 - conf.low).select(F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"))
    wide = scored.join(F.broadcast(per_lang), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(everywhere), F.lit(True), "left")  # one row per language; one row
    wide = wide.withColumn("_lo", F.coalesce("_lo", "_lo0")).withColumn("_hi", F.coalesce("_hi", "_hi0"))
    threshold = -F.col("_lo") + L.half_width("_size", conf.reach, conf.least, conf.short)
    log_ppl = -F.col("logp_mean")
    kept = F.when(log_ppl.isNull(), False).otherwise(F.coalesce(log_ppl <= threshold, F.lit(True)))
    return wide.select(F.col("_id").alias(id_col), "trusted", log_ppl.alias("log_ppl"), threshold.alias("threshold"), kept.alias("kept"))
