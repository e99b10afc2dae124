from pyspark.sql import functions as F

import corpus_pipeline
from residua.llm.perplexity_filter import basic_facts


def test_stages_keep_the_columns_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert out.schema.simpleString() == docs.schema.simpleString()
        m = out.count()
        assert 0 < m <= n
        docs, n = out, m
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_one_of_repeated_rows_stays(spark, edge):
    from corpus_pipeline import near_duplicate

    got = sorted((str(r.doc_id), r.text or "") for r in near_duplicate(spark, edge.unionAll(edge), "").collect())
    assert len(got) == len(set(got)) and {i for i, _ in got} == {"1", "3", "4", "5", "6", "7", "None"}


def test_what_each_stage_drops(spark):
    """Planted rows among clean ones: each stage takes its own and leaves the rest."""
    sf = "/root/testdata/sf0.1"
    base, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = base.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").dropDuplicates(["text"])
    toxic = base.join(labels.where("quality = 1 and toxic = 1"), "doc_id", "left_semi").dropDuplicates(["text"])
    texts = [r.text for r in clean.where("lang = 'en' and length(text) > 900 and not text rlike '\\n'").orderBy("doc_id").limit(4).collect()]
    words = texts[0].split(" ")
    planted = [
        (10**9 + 1, texts[0]), (10**9 + 2, " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])), (10**9 + 3, texts[1] + " "),  # copies and near copies
        (10**9 + 4, "spam " * 60), (10**9 + 5, None), (10**9 + 6, "too few words here"), (10**9 + 7, "qzx#" * 50 + " kjw vvxq zzkp qqwz xxjk wwvz zqkx jjqz kxzv"),
    ]
    extra = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) AS n_chars").select(*[F.col(f.name).cast(f.dataType) for f in base.schema])
    docs = clean.unionByName(toxic).unionByName(extra).cache()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    facts = {r.doc_id: basic_facts((r.text or "").encode()) for r in docs.collect()}
    failed = {i for i, f in facts.items() if f[0] < 10 or 100 * f[4] > 20 * f[0]}  # labelled good, yet short or repeating
    before, bad = ids(docs), {10**9 + 7} | failed
    assert {10**9 + k for k in (4, 5, 6)} <= failed
    kept = ids(corpus_pipeline.quality(spark, docs, sf))
    assert not kept & bad and {10**9 + k for k in (1, 2, 3)} <= kept and len((before - bad) - kept) < 0.01 * len(before)
    harmful = ids(toxic)
    kept = ids(corpus_pipeline.toxicity(spark, docs, sf))
    assert len(kept & harmful) < 0.15 * len(harmful) and len((before - harmful) - kept) < 0.005 * len(before)
    few = docs.where(F.col("doc_id") > 10**8).unionByName(clean.where(F.col("text").isin(texts)))
    original = {r.text: r.doc_id for r in clean.where(F.col("text").isin(texts)).collect()}
    kept = ids(corpus_pipeline.near_duplicate(spark, few, sf))
    assert kept == (ids(few) - {10**9 + k for k in (1, 2, 3)}) and set(original.values()) <= kept
