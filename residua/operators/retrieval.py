"""TF-IDF retrieval over documents, embedding search, and audits of research logs."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.plans.relations import MADE, _dialect, lean, step

step("tokens", "SELECT doc_id, <<unnest <<tokens text>>>> AS term FROM documents")
step("tf", "SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term")
step("corpus_size", "SELECT count(*) AS n FROM documents")
step("idf", "SELECT term, df, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x CROSS JOIN corpus_size")
step("weights", "SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON idf.term = tf.term")
step("norms", "SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id")
step("asked", "SELECT 1 AS q, 'the thing and the tion of mean reversion' AS text UNION ALL SELECT 2, 'licensed under the apache license' UNION ALL SELECT 3, 'la de les dans que' UNION ALL SELECT 4, 'und der die das nicht' UNION ALL SELECT 5, 'email contact token transaction cost'")
step("asked_tf", "SELECT q, term, count(*) AS tf FROM (SELECT q, <<unnest <<tokens text>>>> AS term FROM asked) x GROUP BY q, term")
step("asked_w", "SELECT a.q, a.term, a.tf * coalesce(i.idf, 1.0) AS w FROM asked_tf a LEFT JOIN idf i ON i.term = a.term")
step("asked_norm", "SELECT q, sqrt(sum(w * w)) AS norm FROM asked_w GROUP BY q")
step("cosine", "SELECT a.q, w.doc_id, sum(a.w * w.w) AS dot FROM asked_w a JOIN weights w ON w.term = a.term GROUP BY a.q, w.doc_id")
step("hits", "SELECT c.q, c.doc_id, c.dot / (a.norm * n.norm) AS score, row_number() OVER (PARTITION BY c.q ORDER BY round(c.dot / (a.norm * n.norm), 9) DESC, c.doc_id) AS rk FROM cosine c JOIN asked_norm a ON a.q = c.q JOIN norms n ON n.doc_id = c.doc_id WHERE c.dot > 0")
step("tfidf_terms", "SELECT term, df, round(idf, 6) AS idf FROM idf")
step("tfidf_norms", "SELECT doc_id, round(norm, 5) AS norm FROM norms")
step("tfidf_search", "SELECT q, doc_id, round(score, 6) AS score, rk FROM hits WHERE rk <= 5")
step("evidence_collect", "SELECT doc_id, q, rk FROM (SELECT *, row_number() OVER (ORDER BY q, rk) AS pos FROM (SELECT doc_id, q, rk, row_number() OVER (PARTITION BY doc_id ORDER BY q, rk) AS first FROM hits WHERE rk <= 3) x WHERE first = 1) y WHERE pos <= 10")
# What a text says of its method, by words. The words, and the metrics that are always asked for
_SPEC = """<<has {0} ;; 'statistical arbitrage'>> AS names_statistical_arbitrage, CASE WHEN <<has {0} ;; 'transaction'>> OR <<has {0} ;; 'cost'>> THEN 'Sharpe ratio,annual return,maximum drawdown,turnover,transaction cost sensitivity' ELSE 'Sharpe ratio,annual return,maximum drawdown,turnover' END AS metrics,
  CASE WHEN <<has {0} ;; 'transformer'>> OR <<has {0} ;; 'cnn'>> THEN 'deep_learning_with_baseline_fallback' ELSE 'mean_reversion_baseline' END AS signal_method"""
step("rule_spec", f"SELECT doc_id, {_SPEC.format('lower(text)')}, CASE WHEN length(trim(<<flat text>>)) > 220 THEN substring(trim(<<flat text>>), 1, 220) || '...' ELSE trim(<<flat text>>) END AS claim FROM documents")
step("evidence_spec", """SELECT max(names_statistical_arbitrage) AS names_statistical_arbitrage, max(metrics) AS metrics, min(signal_method) AS signal_method, count(*) AS documents FROM rule_spec s JOIN evidence_collect e ON e.doc_id = s.doc_id""")
step("embedding_topk", "SELECT q, vec_id, round(score, 5) AS score, rk FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 7) DESC, vec_id) AS rk FROM (SELECT a.vec_id AS q, b.vec_id, <<dot a.embedding ;; b.embedding>> AS score FROM embeddings b JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) a ON a.vec_id <> b.vec_id) y) x WHERE rk <= 10")


#: Asked vectors and rows of a block: two blocks meet as one product.
ASKED, ROWS = 2048, 4096


def _nearest(q: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, top: int) -> pd.DataFrame:
    """(q, vec_id, score): of each asked vector at least its `top` nearest of these rows, without itself. A product finds those
    that can be among them; their scores are then summed in the order of the entries, as the SQL does."""
    near = a @ b.T
    near[q[:, None] == ids[None, :]] = -np.inf
    k = min(top, len(ids))
    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    slack = 2e-7 + 1e-12 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()  # rounded scores that tie stay together
    i, j = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
    score = np.zeros(len(i))
    for d in range(a.shape[1]):
        score += a[i, d] * b[j, d]
    # places are those of the scores rounded; one that may be rounded either way counts as rounded down, and is kept
    units = score * 1e7
    either = np.abs(units - np.floor(units) - 0.5) < 1e-3
    out = pd.DataFrame({"q": q[i], "vec_id": ids[j], "score": score, "units": np.where(either, np.floor(units), np.rint(units)), "either": either})
    out = out.sort_values(["q", "units", "vec_id"], ascending=[True, False, True])
    return out.loc[(out.groupby("q").cumcount() < top) | out["either"], ["q", "vec_id", "score"]]


def block_nearest(embeddings: DataFrame, top: int = 10) -> DataFrame:
    """(q, vec_id, score): each block of rows' nearest to each asked vector (ids divisible by 20), exactly. Asked vectors and
    rows meet in blocks; what a pair of blocks gives is some rows an asked vector, not one a pair of vectors. Vectors of
    another length than most, null ones and those with entries that are null or beyond 1e150 meet all others pair by pair."""
    sizes = {r.n: r.rows for r in embeddings.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # one row a length
    most, n = max(sizes, key=lambda k: (sizes[k], k), default=0), sum(sizes.values())
    marked = embeddings.select("vec_id", "embedding", F.coalesce((F.size("embedding") == most) & F.forall("embedding", lambda x: F.coalesce(x.between(-1e150, 1e150), F.lit(False))), F.lit(False)).alias("plain"))
    plain, wanted = marked.where("plain"), F.col("vec_id") % 20 == 0
    blocks, asked = max(1, -(-n // ROWS)), max(1, -(-n // (20 * ASKED)))
    left = plain.where(wanted).select(F.pmod(F.xxhash64("vec_id"), F.lit(asked)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), "vec_id", "embedding")
    right = plain.select(F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("i_b"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("j_b"), F.col("vec_id").alias("id_b"), F.col("embedding").alias("embedding_b"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty or not most:
            return pd.DataFrame(columns=["q", "vec_id", "score"])
        return _nearest(a["vec_id"].to_numpy(), np.stack(a["embedding"].to_numpy()).astype(float), b["id_b"].to_numpy(), np.stack(b["embedding_b"].to_numpy()).astype(float), top)

    met = left.groupBy("i", "j").cogroup(right.groupBy("i_b", "j_b")).applyInPandas(meet, "q long, vec_id long, score double")
    for one, two in ((marked.where(wanted & ~F.col("plain")), marked), (marked.where(wanted & F.col("plain")), marked.where(~F.col("plain")))):
        rest = one.alias("a").join(two.alias("b"), F.expr("a.vec_id <> b.vec_id"))
        met = met.unionByName(rest.select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("vec_id"), F.expr(_dialect("<<dot a.embedding ;; b.embedding>>", "spark")).alias("score")))
    return met


MADE["near_pairs"] = ("vectors", block_nearest)
step("vectors", "SELECT vec_id, embedding FROM embeddings")
lean("embedding_topk", "SELECT q, vec_id, round(score, 5) AS score, rk FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 7) DESC, vec_id) AS rk FROM near_pairs) x WHERE rk <= 10")

# Research logs, read from events: a user's events in order are the steps of one run. Phases by event type
# and the seven method foundations; every ninth event names a method that is none of them, and every ninth names none.
step("foundations", """SELECT 0 AS n, 'rag-2020' AS method, 'retrieval' AS phase UNION ALL SELECT 1, 'react-2023', 'planning' UNION ALL SELECT 2, 'self-rag-2024', 'retrieval' UNION ALL SELECT 3, 'finqa-2021', 'quant_execution'
  UNION ALL SELECT 4, 'reflexion-2023', 'reflection' UNION ALL SELECT 5, 'external-feedback-2024', 'reflection' UNION ALL SELECT 6, 'dsr-2014', 'reporting'""")
step("trace", """SELECT e.user_id AS run, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS step_no, e.event_id, e.value,
  CASE e.event_type WHEN 'signup' THEN 'planning' WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'quant_execution' WHEN 'error' THEN 'reflection' ELSE 'reporting' END AS phase,
  CASE WHEN e.event_id % 9 = 7 THEN 'unlisted' ELSE f.method END AS method FROM events e LEFT JOIN foundations f ON f.n = e.event_id % 9""")
step("active_foundations", "SELECT t.run, t.method, min(t.step_no) AS first_step, count(*) AS steps FROM trace t JOIN foundations f ON f.method = t.method GROUP BY t.run, t.method")
step("invalid_methods", "SELECT t.run, t.method, count(*) AS steps FROM trace t LEFT JOIN foundations f ON f.method = t.method WHERE t.method IS NOT NULL AND f.method IS NULL GROUP BY t.run, t.method")
step("hypotheses", "SELECT run, event_id AS id, value > 5 AS has_claim, value > 10 AS has_evidence, CASE WHEN value > 40 THEN 'supported' WHEN value > 15 THEN 'open' ELSE '' END AS state FROM trace WHERE phase = 'planning'")
step("hypothesis_ledger", "SELECT run, id, state, has_claim AND has_evidence AND state <> '' AS complete FROM hypotheses")
step("run_facts", """SELECT run, sum(CASE WHEN method IS NULL THEN 1 ELSE 0 END) AS without_method, sum(CASE WHEN phase = 'retrieval' THEN 1 ELSE 0 END) AS evidence, sum(CASE WHEN phase = 'retrieval' AND value > 1 THEN 1 ELSE 0 END) AS grounded,
  min(CASE WHEN phase = 'planning' THEN step_no END) AS plan_step, min(CASE WHEN phase = 'quant_execution' THEN step_no END) AS act_step, min(CASE WHEN phase = 'reflection' THEN step_no END) AS reflect_step,
  max(CASE WHEN phase = 'quant_execution' AND value IS NOT NULL THEN 1 ELSE 0 END) AS result, sum(CASE WHEN phase = 'reflection' THEN 1 ELSE 0 END) AS validations, sum(CASE WHEN phase = 'reflection' AND coalesce(value, 0) <= 0 THEN 1 ELSE 0 END) AS empty_validations,
  max(CASE WHEN phase = 'reporting' AND value > 1 THEN 1 ELSE 0 END) AS decision, max(CASE WHEN phase = 'reporting' AND value > 400 THEN 1 ELSE 0 END) AS unsafe FROM trace GROUP BY run""")
step("protocol_checks", """SELECT f.run, coalesce(i.bad, 0) = 0 AND f.without_method = 0 AS method_provenance, f.evidence > 0 AND f.grounded = f.evidence AS retrieval_grounding,
  coalesce(f.plan_step < f.act_step AND f.act_step < f.reflect_step, false) AS reason_action_observation_loop, f.result = 1 AS executable_numerical_reasoning,
  f.validations > 0 AND f.empty_validations = 0 AND f.reflect_step IS NOT NULL AS external_feedback_before_reflection, coalesce(h.whole, 1) = 1 AS hypothesis_evidence_ledger, f.decision = 1 AS evidence_bounded_decision, f.decision = 1 AND f.unsafe = 0 AS selection_bias_controls
  FROM run_facts f LEFT JOIN (SELECT run, count(*) AS bad FROM invalid_methods GROUP BY run) i ON i.run = f.run LEFT JOIN (SELECT run, min(CASE WHEN complete THEN 1 ELSE 0 END) AS whole FROM hypothesis_ledger GROUP BY run) h ON h.run = f.run""")
step("protocol_audit", """SELECT *, method_provenance AND retrieval_grounding AND reason_action_observation_loop AND executable_numerical_reasoning AND external_feedback_before_reflection AND hypothesis_evidence_ledger AND evidence_bounded_decision AND selection_bias_controls AS passed,
  CAST(CASE WHEN method_provenance THEN 0 ELSE 1 END + CASE WHEN retrieval_grounding THEN 0 ELSE 1 END + CASE WHEN reason_action_observation_loop THEN 0 ELSE 1 END + CASE WHEN executable_numerical_reasoning THEN 0 ELSE 1 END
  + CASE WHEN external_feedback_before_reflection THEN 0 ELSE 1 END + CASE WHEN hypothesis_evidence_ledger THEN 0 ELSE 1 END + CASE WHEN evidence_bounded_decision THEN 0 ELSE 1 END + CASE WHEN selection_bias_controls THEN 0 ELSE 1 END AS INT) AS critical_failures FROM protocol_checks""")
step("event_props", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
