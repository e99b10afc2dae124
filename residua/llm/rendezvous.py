"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import written

#: Hex digits of an MD5 that fit a double exactly.
DIGITS = 13


def _best(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(s, i): the least -ln(u) / weight over the shards first, first + 1, ... and its shard; u hashes (key, i)."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])

    def score(x: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit(":"), x["i"].cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / x["w"]).alias("s"), x["i"].alias("i"))

    return F.array_min(F.transform(shards, score))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of least score; ties go to the lower number. A shard that is added can only win keys."""
    return _best(key, weights)["i"]


def rendezvous_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, shards: int = 40, bucket_digits: int = 2) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The shard depends on the id and the weights alone. slot numbers a shard's records from 0 without gaps, in the order
    of (bucket, id, size, text_crc32), bucket being the first digits of md5(id:crc). Equal records are counted before
    they are shuffled and buckets are summed before they are numbered, so neither a shard nor a repeated record is
    sorted in one task. grown_shard is the shard after one more of mean weight is added.

    Defined cases: null or empty text: size 16 and CRC 0; a null id hashes as the empty key; repeated rows each get a
    slot; other columns are ignored; an empty table gives an empty table.
    """
    weights = [float(w) for w in weights] if weights else [1.0] * shards
    more = [*weights, sum(weights) / len(weights)]
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the text is reduced to its size and CRC, and equal records to a count, before any hash over shards is taken
    facts = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("crc"))
    records = facts.groupBy("id", "key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    best = records.withColumn("_old", _best(F.col("key"), weights)).withColumn("_new", _best(F.col("key"), more[-1:], len(weights)))
    placed = best.withColumn("shard", F.col("_old.i")).withColumn("grown", F.least("_old", "_new")["i"])
    placed = placed.withColumn("bucket", F.substring(F.md5(F.concat_ws(":", "key", F.col("crc").cast("string")).cast("binary")), 1, bucket_digits))
    placed = written(placed.drop("_old", "_new"), "placed")  # hashed once, read twice below
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("_n"))  # at most shards * 16**bucket_digits rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("shard").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = ranked.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_b")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_in") + F.col("_copy")).cast("long").alias("slot"), F.col("grown").cast("int").alias("grown_shard"),
    )


def rendezvous_sql(shards: int = 40) -> str:
    """DuckDB SQL of the query: CRC-32 by nibbles, scores by MD5."""
    score = f"-ln((('0x' || substr(md5(key || ':' || s), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)!r})"
    return f"""
WITH nib AS (
  SELECT list_transform(range(16), lambda k: list_reduce([k, 0, 1, 2, 3], lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), raw AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT) AS xs
  FROM documents
), facts AS (
  SELECT doc_id, key, size, CASE WHEN size = 16 THEN 0 ELSE
    xor(list_reduce(list_concat([4294967295::BIGINT], xs), lambda c, x: xor(c // 16, t[(xor(c, x) % 16 + 1)::INT])), 4294967295::BIGINT) END AS crc
  FROM raw, nib
), scored AS (
  SELECT doc_id, key, size, crc, s, {score} AS v FROM facts, range({shards + 1}) r(s)
), chosen AS (
  SELECT doc_id, key, size, crc, rn, arg_min(s, v) FILTER (WHERE s < {shards}) AS shard, arg_min(s, v) AS grown
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc, s) AS rn FROM scored) GROUP BY ALL
)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', key, crc::VARCHAR)), 1, 2), doc_id NULLS FIRST, size, crc) - 1 AS slot,
       (CASE WHEN grown = {shards} THEN {shards} ELSE shard END)::INT AS grown_shard
FROM chosen"""
