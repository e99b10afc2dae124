"""A training-data pipeline: quality rules, toxicity, near-duplicates, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm._cluster import checked, only, row_key, unused, without, written
from residua.llm.near_duplicates import near_duplicates
from residua.llm.packing import PackingConfig, pack_documents
from residua.llm.perplexity_filter import quality_verdicts
from residua.llm.queries import tokenizer_path
from residua.llm.toxicity import fit_toxicity, score_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band, with their columns as they were.

    Null, empty and blank texts fail the base rules and go. A null id is never labelled but judged like any; rows are told
    apart by id and text, so repeated rows stay or go together; extra columns pass through whatever their names; an empty
    table stays empty.
    """
    verdicts = quality_verdicts(docs, good=spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
    rejected = written(verdicts.where("not kept").select(F.col("doc_id").alias("_id"), "_crc", "_size"), "rejected")
    return without(docs, rejected, "doc_id", "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by trees fitted on the labelled ones among docs.

    Null and empty texts have a score too. Null ids are never labelled but scored; rows with one id and text stay or go
    together; extra columns pass through; without labelled rows the score is 0 and all stay; an empty table stays empty.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, row_key("doc_id", "text"))
    rejected = written(scored.where("score >= 0.5").select("_id", "_crc", "_size"), "rejected")
    return without(docs, rejected, "doc_id", "text")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked at 0.8 on five-word shingles.

    Of rows that repeat an id and text one stays, also where the id is null; a null id is linked with no other row. Null,
    empty and blank texts are linked with nothing and stay. Rows of one id with different texts stay or go together; extra
    columns pass through; an empty table stays empty.
    """
    [gone] = unused(docs, "_gone")
    removed = written(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "removed")
    left = docs.join(checked(removed), F.col("doc_id") == F.col(gone), "left_anti")
    repeated = written(left.select(*row_key("doc_id", "text")).groupBy("_id", "_crc", "_size").count().where("count > 1").drop("count"), "repeated")
    if repeated.isEmpty():  # ids are unique, as a rule
        return left
    return without(left, repeated, "doc_id", "text").unionByName(only(left, repeated, "doc_id", "text").dropDuplicates(["doc_id", "text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; a null id is kept as null; repeated rows are packed one by one; ties between
    pieces of one length go by id, piece and checksum; extra columns are left out; an empty table gives an empty table.
    """
    return pack_documents(docs, PackingConfig(tokenizer_path("word_bpe_49k.json")), keep_ids=False)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicate", near_duplicate), ("packing", packing)]

#: No SQL form: a corpus n-gram model, fitted trees and packing by dynamic programming; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
