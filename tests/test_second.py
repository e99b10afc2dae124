"""Retrieval, costs, period figures, gates, continuity and protocol audits derived a second time, by plain loops."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pytest

import residua.catalog  # noqa: F401  registers all steps
from residua.plans.relations import relation

SF = "/root/testdata/sf0.001"


def test_retrieval(spark):
    docs = {
        1: "Mean reversion of the thing: mean reversion again, and cost.", 2: "The apache license is a license; licensed under it.", 3: "la maison de la rue dans les champs que", 4: "und der Hund, der und die Katze nicht das",
        5: "email contact of a transaction token", 6: "", 7: "nothing_matches-here 42 x", 8: "mean mean mean thing", 9: "of of under the",
    }
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    asked = {r.q: r.text for r in relation(spark, SF, "asked").collect()}
    terms = lambda s: Counter(re.findall("[a-z][a-z0-9_-]+", s.lower()))
    tf = {d: terms(s) for d, s in docs.items()}
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in c for c in tf.values()))) + 1 for c in tf.values() for w in c}
    norm = {d: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) for d, c in tf.items()}
    got = {r.doc_id: r.norm for r in relation(spark, SF, "norms", documents=frame).collect()}
    assert got == pytest.approx({d: n for d, n in norm.items() if n})
    hits = {}
    for q, s in asked.items():
        weights = {w: n * idf.get(w, 1.0) for w, n in terms(s).items()}
        size = math.sqrt(sum(v * v for v in weights.values()))
        scores = {d: sum(v * tf[d][w] * idf.get(w, 1.0) for w, v in weights.items()) / (size * norm[d]) for d in docs if norm[d]}
        hits[q] = sorted(((round(v, 9), d) for d, v in scores.items() if v > 0), key=lambda x: (-x[0], x[1]))
    found = {(r.q, r.rk): (r.doc_id, r.score) for r in relation(spark, SF, "hits", documents=frame).collect()}
    assert {k: v[0] for k, v in found.items()} == {(q, i + 1): d for q, ranked in hits.items() for i, (_, d) in enumerate(ranked)}
    assert all(found[q, i + 1][1] == pytest.approx(v, abs=1e-8) for q, ranked in hits.items() for i, (v, _) in enumerate(ranked))
    order = [d for q in sorted(hits) for _, d in hits[q][:3]]
    evidence = list(dict.fromkeys(order))[:10]
    assert {r.doc_id for r in relation(spark, SF, "evidence_collect", documents=frame).collect()} == set(evidence)


def test_fees_and_weight_execution(spark):
    orders = [(1, dt.datetime(1998, 8, 27), 10_000.0, "F"), (2, dt.datetime(1998, 8, 28), 10_000.0, "F"), (3, dt.datetime(1997, 1, 1), 100_000.0, "O"), (4, dt.datetime(1997, 1, 1), 0.0, "F")]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string")
    got = {r.o_orderkey: r.fee for r in relation(spark, SF, "fee_schedule", orders=frame).collect()}
    assert got == pytest.approx({1: 5 + 0.1 + 10, 2: 5 + 0.1 + 5, 3: 25 + 1, 4: 0})
    r = np.random.default_rng(1)
    days = [dt.date(1998, 8, 26) + dt.timedelta(k) for k in range(4)]
    cells = [(t, f"s{j}", float(r.normal()), float(w), bool(r.random() < 0.2), bool(r.random() < 0.2)) for t in range(4) for j, w in enumerate(r.dirichlet(np.ones(6)) * 0.9)]
    alpha = spark.createDataFrame([(t, s, a) for t, s, a, *_ in cells], "t int, symbol string, alpha double")
    panel = spark.createDataFrame([(t, s, w, p, st) for t, s, _, w, p, st in cells], "t int, symbol string, benchmark_weight double, paused boolean, is_st boolean")
    done = {(x.t, x.symbol): x for x in relation(spark, SF, "weight_execution", alpha=alpha, panel=panel).collect()}
    calendar = spark.createDataFrame([(t, d) for t, d in enumerate(days)], "t int, d date")
    costs = {x.t: x.cost for x in relation(spark, SF, "trade_costs", alpha=alpha, panel=panel, calendar=calendar).collect()}
    for t in range(4):
        day = [c for c in cells if c[0] == t]
        size = sum(max(c[2], 0) for c in day)
        sells = [0 if c[4] else max(c[3] - max(c[2], 0) / size, 0) for c in day]
        wants = [0 if c[4] or c[5] else max(max(c[2], 0) / size - c[3], 0) for c in day]
        cash = max(0, 1 - sum(c[3] for c in day) + sum(sells))
        share = min(1, cash / sum(wants)) if sum(wants) else 0
        for c, s, w in zip(day, sells, wants):
            x = done[t, c[1]]
            assert (x.weight, x.sold, x.bought) == pytest.approx((c[3] - s + w * share, s, w * share), abs=1e-6)
        assert costs[t] == pytest.approx(sum(wants) * share * 0.00126 + sum(sells) * (0.00126 + (0.001 if days[t] < dt.date(1998, 8, 28) else 0.0005)), abs=1e-9)


def figures(gross, strategy, bench, cost, year=52):
    ratio = lambda x: x.mean() / x.std() * math.sqrt(year) if x.std() > 0 else 0.0
    active = strategy - bench
    wealth = np.cumprod(1 + active)
    windows = [np.prod(1 + strategy[i - year + 1 : i + 1]) / np.prod(1 + bench[i - year + 1 : i + 1]) - 1 for i in range(year - 1, len(active))]
    return {
        "gross_excess": (gross - bench).mean() * year, "net_excess": active.mean() * year, "gross_ir": ratio(gross - bench), "net_ir": ratio(active), "cost_drag": cost.mean() * year,
        "cost_share": cost.mean() / (gross - bench).mean() if (gross - bench).mean() > 0 else None, "drawdown": (wealth / np.maximum.accumulate(wealth) - 1).min(), "rolling_share": np.mean([w > 0 for w in windows]) if windows else None,
    }


@pytest.mark.parametrize("drift", [0.004, -0.002])
def test_period_figures_and_gates(spark, drift):
    r = np.random.default_rng(3)
    days = [dt.date(1996, 1, 1) + dt.timedelta(7 * k) for k in range(260)]
    bench, cost = r.normal(0.001, 0.01, 260), np.abs(r.normal(0, 0.0004, 260))
    gross = bench + drift + r.normal(0, 0.006, 260)
    strategy = gross - cost
    scaled = spark.createDataFrame([(t, float(g), float(s), float(b), float(c)) for t, (g, s, b, c) in enumerate(zip(gross, strategy, bench, cost))], "t int, gross double, strategy double, bench double, cost double")
    calendar = spark.createDataFrame([(t, d) for t, d in enumerate(days)], "t int, d date")
    got = {x.period: x for x in relation(spark, SF, "period_metrics", scaled=scaled, calendar=calendar).collect()}
    late = np.array([d >= dt.date(1999, 4, 1) for d in days])
    want = {p: figures(*(x[keep] for x in (gross, strategy, bench, cost))) for p, keep in (("overall", late | True), ("development", ~late), ("validation", late))}
    for p, row in want.items():
        for k, v in row.items():
            assert getattr(got[p], k) == (pytest.approx(v, abs=2e-5) if v is not None else None), (p, k)
    failed = [f"{p}:{g}" for p in ("development", "validation") for g, ok in (("gross excess", want[p]["gross_excess"] > 0), ("net excess", want[p]["net_excess"] > 0), ("net IR", want[p]["net_ir"] >= 1)) if not ok]
    whole = want["overall"]
    failed += [f"overall:{g}" for g, ok in (("active drawdown", whole["drawdown"] >= -0.12), ("cost share", (whole["cost_share"] or 9) <= 0.5), ("rolling share", (whole["rolling_share"] or 0) >= 0.6)) if not ok]
    decided = relation(spark, SF, "admission_decision", scaled=scaled, calendar=calendar).first()
    assert decided.failed_gates == ",".join(sorted(failed)) and decided.admitted == (not failed) and decided.holdout_action == ("keep_holdout_sealed" if failed else "run_holdout_once")
    figure = relation(spark, SF, "performance_metrics", scaled=scaled).first()
    wealth = np.cumprod(1 + strategy)
    assert figure.accepted and (figure.annual_mean, figure.sharpe, figure.cumulative) == pytest.approx((strategy.mean() * 52, strategy.mean() / strategy.std() * math.sqrt(52), wealth[-1] - 1), abs=1e-5)
    ruined = scaled.selectExpr("t", "gross", "CASE WHEN t = 9 THEN -1.0 ELSE strategy END AS strategy", "bench", "cost")
    refused = relation(spark, SF, "performance_metrics", scaled=ruined).first()
    assert not refused.accepted and refused.sharpe is None and refused.days == 260


def test_continuity(spark):
    r = np.random.default_rng(5)
    n, names, first = 90, [f"s{j}" for j in range(5)], 20
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(n)]
    refits = [20, 45, 70]
    value = r.normal(0, 0.01, (n, 5))
    value[:first] = value[33] = np.nan
    value[50:60, 2] = np.nan
    member = r.random((n, 5)) < 0.9
    alpha = {(t, j): float(r.normal()) for t in range(n) for j in range(5) if member[t, j]}
    cell = lambda t, j: None if np.isnan(value[t, j]) else float(value[t, j])
    frames = {
        "calendar": spark.createDataFrame([(d, t, d.year * 12 + d.month) for t, d in enumerate(days)], "d date, t int, mi int"),
        "mapped": spark.createDataFrame([(t, s) for t in refits for s in names], "refit_t int, symbol string"),
        "residual": spark.createDataFrame([(t, names[j], cell(t, j)) for t in range(n) for j in range(5) if cell(t, j) is not None], "t int, symbol string, r double"),
        "resid": spark.createDataFrame([(t, names[j], bool(member[t, j]), cell(t, j)) for t in range(n) for j in range(5)], "t int, symbol string, member boolean, r double"),
        "ou": spark.createDataFrame([(t, "s0", 30 if t >= 60 else 3, True) for t in range(n)], "t int, symbol string, nv int, member boolean"),
        "alpha": spark.createDataFrame([(t, names[j], a) for (t, j), a in alpha.items()], "t int, symbol string, alpha double"),
    }
    got = relation(spark, SF, "continuity_audit", **frames).first()
    version = [sum(t >= f for f in refits) - 1 for t in range(n)]
    seen = [t for t in range(n) if version[t] >= 0]
    model = [t for t in seen if np.isfinite(value[t]).any()]
    assert (got.calendar_days, got.model_days, got.days_without_model, got.refits) == (len(seen), len(model), len(seen) - len(model), 3)
    shares = [np.isfinite(value[t])[member[t]].mean() for t in model if member[t].any()]
    assert got.member_coverage == pytest.approx(sum(np.isfinite(value[t])[member[t]].sum() for t in model) / sum(member[t].sum() for t in model), abs=1e-6)
    assert (got.median_coverage, got.minimum_coverage, got.minimum_active) == (pytest.approx(np.median(shares), abs=1e-6), pytest.approx(min(shares), abs=1e-6), min(np.isfinite(value[t]).sum() for t in model))
    spans = [version[t] - max(min(version[t - 29 : t + 1]), 0) + 1 for t in range(60, n)]
    assert (got.ou_windows, got.single_model_rate, got.models_per_window, got.most_models) == (30, pytest.approx(np.mean([s == 1 for s in spans]), abs=1e-6), pytest.approx(np.mean(spans), abs=1e-6), max(spans))
    held = lambda t: {j for j in range(5) if member[t, j] and np.isfinite(value[t, j])}
    assert got.median_jaccard == pytest.approx(np.median([len(held(t) & held(t - 1)) / len(held(t) | held(t - 1)) for t in refits[1:]]), abs=1e-6)
    size = {t: np.abs(value[t][member[t] & np.isfinite(value[t])]).mean() for t in model}
    at, other = np.mean([size[t] for t in model if t in refits]), np.mean([size[t] for t in model if t not in refits])
    moved = {t: np.mean([abs(alpha[t, j] - alpha[t - 1, j]) for j in range(5) if (t, j) in alpha and (t - 1, j) in alpha]) for t in model}
    assert (got.residual_ratio, got.alpha_ratio) == (pytest.approx(at / other, rel=1e-4), pytest.approx(np.mean([moved[t] for t in model if t in refits]) / np.mean([moved[t] for t in model if t not in refits]), rel=1e-4))


def test_protocol(spark):
    r = np.random.default_rng(7)
    kinds, methods = ["signup", "view", "click", "error", "purchase"], {x.n: (x.method, x.phase) for x in relation(spark, SF, "foundations").collect()}
    rows = [(i, int(u), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(r.integers(0, 40))), kinds[int(r.integers(0, 5))], round(float(r.choice([0.5, 3, 12, 20, 50, 500])), 2)) for i, u in enumerate(r.integers(0, 25, 300))]
    whole = [(1000 + k, 99, dt.datetime(2024, 1, 2, 0, 0, k), kinds[k], 20.0) for k in range(5)]  # a run in order; its methods depend on the ids
    rows += whole
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    got = {x.run: x for x in relation(spark, SF, "protocol_audit", events=events).collect()}
    phases = dict(zip(kinds, ("planning", "retrieval", "quant_execution", "reflection", "reporting")))
    for run in {x[1] for x in rows}:
        steps = [(phases[k], v, "unlisted" if i % 9 == 7 else methods.get(i % 9, (None,))[0]) for i, u, _, k, v in sorted((x for x in rows if x[1] == run), key=lambda x: (x[2], x[0]))]
        first = {p: next((k for k, s in enumerate(steps) if s[0] == p), None) for p in phases.values()}
        of = lambda p: [v for q, v, _ in steps if q == p]  # noqa: B023,E731
        ordered = None not in (first["planning"], first["quant_execution"], first["reflection"]) and first["planning"] < first["quant_execution"] < first["reflection"]
        ledger = [v > 15 for v in of("planning")]  # claim above 5, evidence above 10, a state above 15
        decision = any(v > 1 for v in of("reporting"))
        want = {
            "method_provenance": all(m is not None and m != "unlisted" for *_, m in steps), "retrieval_grounding": bool(of("retrieval")) and all(v > 1 for v in of("retrieval")), "reason_action_observation_loop": ordered,
            "executable_numerical_reasoning": bool(of("quant_execution")), "external_feedback_before_reflection": bool(of("reflection")), "hypothesis_evidence_ledger": all(ledger), "evidence_bounded_decision": decision,
            "selection_bias_controls": decision and not any(v > 400 for v in of("reporting")),
        }
        assert {k: getattr(got[run], k) for k in want} == want and got[run].critical_failures == sum(not v for v in want.values()) and got[run].passed == all(want.values())
