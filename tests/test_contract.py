"""Contracts, bounded tools, salvaged answers and compared runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.plans import contract as C
from residua.sources.markets import index_panel
from residua.sources.panels import fingerprint, save_panel


def diagnostic(digest, **change):
    side = lambda excess, drag: {"annualized_gross_excess_return": excess, "annualized_cost_drag": drag}
    return {
        "label": C.LABEL, "data_fingerprint": digest, "forward_rank_ic": {"1": {"mean_rank_ic": 0.004}, "5": {"mean_rank_ic": 0.02}},
        "portfolio_results": {"original": side(-0.02, 0.06), "reversed": side(0.01, 0.05), "neutral": side(0.02, 0.01)}, "signal_coverage": {"nonzero_signal_rate": 0.4},
    } | change


@pytest.fixture(scope="module")
def frozen(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("contract")
    digest = save_panel(index_panel(spark, 170, 70), f"file://{folder}/panel")["audit"]["fingerprint"]
    (folder / "d.json").write_text(json.dumps(diagnostic(digest)))
    return folder, digest


def test_contract_and_tools(spark, frozen):
    folder, digest = frozen
    made = C.freeze(spark, f"file://{folder}/panel", f"file://{folder}/d.json")
    assert made.data_fingerprint == digest and made.last_date == "2018-08-27" and made.to_dict()["parameters"]["residual_lookback"] == 30
    tools = C.BoundedTools(spark, made)
    row = tools.invoke("inspect_direction_diagnostic").first()
    assert (row.simple_sign_flip_supported, row.rank_ic_gate_passed, row.cost_problem_is_signal_induced) == (False, True, True) and row.rank_ic == {"1": 0.004, "5": 0.02}
    with pytest.raises(KeyError, match="not a tool"):
        tools.invoke("search_parameters")
    mechanism = {x.dir: x for x in tools.invoke("test_residual_mechanism").collect()}
    assert set(mechanism) == {1, -1} and mechanism[1].sharpe == pytest.approx(-mechanism[-1].sharpe)
    known = dict.fromkeys(("audit_residual_continuity", "audit_residual_predictability"))
    for name in known:
        known[name] = tools.invoke(name).first()
    held = known["audit_residual_continuity"]
    assert held.end_date == "2018-08-27" and held.model_days == held.calendar_days == np.busday_count(held.start_date, held.end_date) + 1 and known["audit_residual_predictability"]
    assert "delta_sharpe" in tools.invoke("compare_residual_definitions").columns
    (folder / "d.json").write_text(json.dumps(diagnostic("another")))
    with pytest.raises(ValueError, match="this panel"):
        tools.invoke("inspect_direction_diagnostic")
    (folder / "d.json").write_text(json.dumps(diagnostic(digest, label="x")))
    with pytest.raises(ValueError, match="label"):
        C.freeze(spark, f"file://{folder}/panel", f"file://{folder}/d.json")
    with pytest.raises(ValueError, match="holdout"):
        C.BoundedTools(spark, C.Contract("", "", "", "", (), holdout_allowed=True))


def test_a_diagnostic_without_facts_decides_nothing(spark):
    row = C.direction_decisions(spark.createDataFrame([("{}",)], "value string")).first()
    assert row.simple_sign_flip_supported is None and row.rank_ic_gate_passed is None


def test_salvaged_json(spark):
    texts = ['{"a": 1}', 'Sure:\n{"a": {"b": 2}}\nDone.', "none", "{broken", None, ""]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.to_json(C.salvaged_json(F.col("t")))).collect()]
    assert got == ['{"a":1}', '{"a":{"b":2}}', None, None, None, None]
    assert [x.tool for x in C.baseline_plan(spark).orderBy("step").collect()][::4] == ["load_price_data", "run_stat_arb_backtest"]


def test_compared_runs(spark):
    measures = "sharpe double, {0}_mean double, {0}_volatility double"
    ddl = "run string, factor_model string, status string, config map<string,string>, origins array<int>, days long, observed_" + measures.format("observed") + ", target_" + measures.format("target")
    row = lambda name, model, observed, target, **c: (name, model, C.APPROXIMATION, {"seed": "0", "model": "ffn"} | c, [1, 2], 2, *observed, *target)
    rows = [row("a", "FamaFrench", (1.0, 2.0, 4.0), (2.0, 2.0, 2.0)), row("b", "PCA", (1.0, 1.0, 1.0), (1.0, 1.0, 2.0)), row("c", "IPCA", (3.0, 0.0, 1.0), (4.0, 1.0, 1.0))]
    daily = spark.createDataFrame([(n, r) for n in "abc" for r in (0.1, 0.2)], "run string, ret double")
    got = {x.run: x for x in C.compare_runs(spark.createDataFrame(rows, ddl), daily).collect()}
    assert [got[n].error for n in "abc"] == pytest.approx([0.5, 0.5 / 3, 1.25 / 3]) and [n for n in "abc" if got[n].closest] == ["b"]
    assert [(got[n].observed_rank, got[n].target_rank) for n in "abc"] == [(2, 2), (3, 3), (1, 1)] and got["a"].ranking_preserved
    with pytest.raises(ValueError, match="configuration"):
        C.compare_runs(spark.createDataFrame([*rows[:2], row("c", "IPCA", (3.0, 0.0, 1.0), (4.0, 1.0, 1.0), seed="1")], ddl), daily)
    with pytest.raises(ValueError, match="days"):
        C.compare_runs(spark.createDataFrame(rows, ddl), daily.where("ret < 0.2"))
    with pytest.raises(ValueError, match="finished"):
        C.compare_runs(spark.createDataFrame([(*rows[0][:2], "partial", *rows[0][3:])], ddl), daily)


def test_fingerprints_agree(spark, frozen):
    assert fingerprint(index_panel(spark, 170, 70)) == frozen[1]
