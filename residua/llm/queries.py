"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; RESIDUA_TOKENIZERS overrides the installed folder."""
    import os

    folder = os.environ.get("RESIDUA_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licence_rules import licence_scan

    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, fold_of, score_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_zip_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import archive_folder, read_archives, write_archives

    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), archive_folder(spark))
    return read_archives(archives, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_local_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .local_descriptors import copies_and_members, edited_copy, render_vector

    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("source"))
    queries = images.where("id % 20 = 0")  # the stated query set: an edited copy of each of these, against all rows
    return copies_and_members(images, queries, lambda v, key: render_vector(v), lambda v, key: edited_copy(render_vector(v), key))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import NearDuplicateConfig, near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), conf=NearDuplicateConfig(shingle_words=4))


def op6_perplexity_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity_filter import quality_verdicts

    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), good=good).drop("_crc", "_size")


def op7_trusted_ngram_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import trusted_perplexity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return trusted_perplexity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rendezvous import rendezvous_shards

    return rendezvous_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import PackingConfig, pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), PackingConfig(tokenizer_path("word_bpe_49k.json")), keep_ids=False)


def op10_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_transducer import encode_documents

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op11_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_digests, format_chats, with_probe

    return chat_digests(format_chats(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where it passes 64 bits


def op13_bucket_queue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_repair import repair_conversations

    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .chat_format import chat_sql
    from .chat_repair import repair_sql
    from .licence_rules import licence_sql
    from .rendezvous import rendezvous_sql

    return {"op1_licence_sentence_rules": licence_sql(), "op8_rendezvous_sharding": rendezvous_sql(), "op11_grammar_round_trip": chat_sql(), "op13_bucket_queue_repair": repair_sql()}
