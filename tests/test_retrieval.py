"""Nearest vectors in blocks against all pairs."""

import numpy as np
import pytest

from residua.operators import retrieval
from residua.operators.retrieval import block_nearest
from residua.plans.relations import relation

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_in_blocks(spark, monkeypatch, odd):
    monkeypatch.setattr(retrieval, "ASKED", 4)
    monkeypatch.setattr(retrieval, "ROWS", 37)
    r = np.random.default_rng(4)
    rows = [(k, [float(v) for v in r.normal(size=8).astype(np.float32)]) for k in range(200)]
    rows += [(200 + k, rows[k % 7][1]) for k in range(60)]  # copies: ties go by id
    if odd:
        rows += [(260, None), (261, rows[3][1][:5]), (262, [float("nan")] * 8), (280, [1.0] * 7 + [None]), (263, [1e200] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>" if not odd else "vec_id long, embedding array<double>")
    want = relation(spark, SMALLEST, "embedding_topk", embeddings=frame).collect()
    near = block_nearest(frame)
    near.createOrReplaceTempView("near_pairs_of_test")
    got = spark.sql("SELECT q, vec_id, round(score, 5) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 7) DESC, vec_id) AS rk FROM near_pairs_of_test) x WHERE rk <= 10").collect()
    assert len(want) >= 130 and sorted(map(str, got)) == sorted(map(str, want))


def test_pairs_of_vectors_are_no_rows(spark):
    plan = relation(spark, SMALLEST, "embedding_topk")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan  # 838 GB of pairs were projected for 6 GB
