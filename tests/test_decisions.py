"""Decisions from evidence, a case for each branch; lots that cash affords; pairs against a plain loop."""

import math

import numpy as np
import pytest

import residua.catalog  # noqa: F401  registers all steps
from residua.plans.relations import relation

SF = "/root/testdata/sf0.001"
PLAIN = dict(sign_flip=False, costly=False, mechanism_sharpe=0.1, mechanism_mean=0.02, reversed_mean=-0.02, refit_spike=False, all_cross=False, current_gate=True, rescued=False, cross_sectional=False, broad=False)
DDL = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean'}" for k, v in PLAIN.items())

CASES = [
    ({}, {"H1": "rejected", "H3": "unresolved"}, {"H2": "inconclusive", "H4": "rejected", "H5": "rejected", "H6": "rejected", "H7": "rejected"}, ("inconclusive", "audit_coverage", "low", False)),
    ({"sign_flip": True, "costly": True}, {"H1": "supported", "H3": "supported"}, {}, None),
    ({"mechanism_sharpe": 0.5}, {}, {"H2": "supported"}, ("mechanism_supported", "test_slower_mapping", "medium", False)),
    ({"rescued": True, "reversed_mean": 1.0}, {}, {"H2": "supported", "H5": "supported"}, ("current_composition_rescues", "replicate_on_broader_universe", "medium", False)),
    ({"reversed_mean": 0.03, "current_gate": False}, {}, {"H2": "rejected"}, ("reversal_performs_better", "resolve_residual_definition", "medium", False)),
    ({"current_gate": False}, {}, {"H2": "not_supported_in_current_pilot"}, ("no_stable_predictability", "stop_residual_branch", "medium", False)),
    ({"refit_spike": True, "all_cross": True}, {}, {"H4": "supported"}, None),
    ({"all_cross": True}, {}, {"H4": "structural_confounder_not_confirmed_causal"}, None),
    ({"cross_sectional": True, "mechanism_sharpe": 0.9}, {}, {"H2": "supported", "H6": "supported", "H7": "rejected"}, ("narrow_ranking_effect", "preregister_rank_mapping", "medium", False)),
    ({"cross_sectional": True, "broad": True}, {}, {"H6": "supported", "H7": "supported"}, ("broad_reversal", "preregister_learned_signal", "low", True)),
]


@pytest.mark.parametrize("change, before, after, verdict", CASES)
def test_hypotheses_and_verdict(spark, change, before, after, verdict):
    evidence = spark.createDataFrame([tuple((PLAIN | change).values())], DDL)
    rows = {r.id: r for r in relation(spark, SF, "hypothesis_states", evidence=evidence).collect()}
    assert sorted(rows) == [f"H{i}" for i in range(1, 8)] and all(rows[h].status_before == "unresolved" for h in ("H2", "H4", "H5", "H6", "H7"))
    assert all(rows[h].status_before == s for h, s in before.items()) and all(rows[h].status_after == s for h, s in after.items())
    got = relation(spark, SF, "diagnostic_verdict", evidence=evidence).first()
    assert not got.parameter_search_authorized and (verdict is None or (got.verdict, got.next_action, got.confidence, got.learned_model_authorized) == verdict)


def test_direction_from_facts(spark):
    def decided(who, ics):
        frames = {
            "book_facts": spark.createDataFrame([(w, float(e), float(c)) for w, e, c in who], "who string, excess double, cost double"),
            "ic_days": spark.createDataFrame(ics, "h int, ic double"), "signal_coverage": spark.createDataFrame([(0.4,)], "nonzero_rate double"),
        }
        r = relation(spark, SF, "direction_tool", **frames).first()
        return r.simple_sign_flip_supported, r.rank_ic_gate_passed, r.cost_problem_is_signal_induced

    assert decided([("original", -0.02, 0.06), ("reversed", 0.01, 0.05), ("neutral", 0.02, 0.01)], [(1, 0.0), (5, 0.01), (5, 0.03), (10, 0.0), (20, 0.0)]) == (False, True, True)
    assert decided([("original", -0.02, 0.05), ("reversed", 0.03, 0.05), ("neutral", 0.02, 0.01)], [(1, 0.014), (5, 0.01), (10, 0.0), (20, 0.0)]) == (True, False, False)


def test_interpretation_and_plan(spark):
    tested = spark.createDataFrame([(1, 1.2), (2, 0.4), (3, -0.1), (4, 2.0), (5, 3.0)], "pair long, sharpe double")
    costs = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "pair long, survives_highest boolean")
    periods = spark.createDataFrame([(1, True, True), (2, True, False), (3, True, True), (4, True, True), (5, True, True)], "pair long, both_positive boolean, stable boolean")
    rows = relation(spark, SF, "result_interpretation", pair_backtest=tested, pair_costs=costs, pair_period_stability=periods).collect()
    assert {r.pair: (r.performance, r.verdict, r.confidence) for r in rows} == {
        1: ("positive", "supported", "medium"), 2: ("positive_not_strong", "incomplete_or_mixed", "low"), 3: ("not_positive", "not_supported", "low"),
        4: ("positive", "incomplete_or_mixed", "low"), 5: ("positive", "incomplete_or_mixed", "low"),
    }
    asked = spark.createDataFrame([(1, 1, "Signal-module replacement"), (1, 2, " rolling-period ANALYSIS"), (1, 3, "Cost sensitivity test"), (1, 4, "cost sensitivity test"), (2, 1, "unknown")], "pair long, place int, experiment string")
    plan = relation(spark, SF, "tool_plan", recommended=asked).collect()
    assert {(r.pair, r.tool, r.priority) for r in plan} == {(1, "run_period_stability_experiment", 1), (1, "run_cost_sensitivity_experiment", 2)}


def test_lots_of_the_query_are_the_ledgers(spark):
    from residua.operators.grouped import execution_ledger

    lines = [(i, 1, 1, float(q), q * p) for i, (q, p) in enumerate([(1, 901.82), (7, 1204.05), (50, 2099.0), (30, 1000.0), (2, 0.4), (3, 13.37)])]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double")
    got = {r.l_orderkey: r for r in relation(spark, SF, "lot_rounding", lineitem=frame).collect()}
    for i, _, _, q, x in lines:
        target = spark.createDataFrame([("p", 0, "A", int(q * 37), x / q, False, False, False)], "portfolio string, t int, symbol string, target long, price double, suspended boolean, at_upper boolean, at_lower boolean")
        fill = execution_ledger(target, cash=x * 30).first()
        assert got[i].affordable == fill.filled and got[i].shares == fill.requested and got[i].lots == fill.requested // 100 * 100


def test_pairs_equal_a_plain_loop(spark):
    r = np.random.default_rng(2)
    n, rows, prices = 170, [], {}
    for pair in (4, 9):
        b = 50 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
        a = 10 + 1.3 * b + 4 * np.sin(np.arange(n) / 6) + r.normal(0, 0.5, n)
        prices[pair] = a, b
        rows += [(f"600{pair * 3 + c:09d}", t, float(x[t])) for c, x in ((0, a), (1, b), (2, a)) for t in range(n)]
    panel = spark.createDataFrame(rows, "symbol string, t int, close_price double").selectExpr("*", "date_add(DATE '2020-01-06', 7 * t) AS d")
    got = {(x.pair, x.part, x.bp): x for x in relation(spark, SF, "pair_metrics", panel=panel).collect()}
    assert len(got) == 2 * (4 + 2)
    for (pair, part, bp), x in got.items():
        a, b = (p if part == "full" else p[: n // 2] if part == "first" else p[n // 2 :] for p in prices[pair])
        beta, alpha = np.polyfit(b[:60], a[:60], 1)
        spread, position, out, moved = a - alpha - beta * b, 0, [], 0
        for i in range(len(a)):
            z = None
            if i >= 30:
                z = (spread[i] - spread[i - 30 : i].mean()) / spread[i - 30 : i].std(ddof=1)
            new = 0 if i < 60 or z is None else -1 if z > 1.5 else 1 if z < -1.5 else 0 if abs(z) < 0.1 else position
            ra, rb = (0, 0) if i == 0 else (a[i] / a[i - 1] - 1, b[i] / b[i - 1] - 1)
            out.append(position * (ra - beta * rb) / (1 + abs(beta)) - abs(new - position) * bp / 1e4)
            moved += abs(new - position)
            position = new
        wealth = np.cumprod(1 + np.array(out))
        annual, vol = wealth[-1] ** (52 / len(out)) - 1, np.std(out, ddof=1) * math.sqrt(52)
        drawdown = (1 - wealth / np.maximum.accumulate(np.maximum(wealth, 1))).max()
        assert x.days == len(out) and x.traded == moved
        assert (x.annual_return, x.annual_vol, x.sharpe, x.max_drawdown) == pytest.approx((annual, vol, annual / vol if vol else 0, drawdown), abs=1e-5)
