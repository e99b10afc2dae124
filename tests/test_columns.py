import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import residua.catalog  # noqa: F401  registers all steps
from residua.functions.columns import clip_day, finite, isclose, number_in_name, one_to_one, ranking, rounded, start_index
from residua.plans.relations import relation
from residua.sources.reports import diagnostic_report, pair_report, read_text, report

SF = "/root/testdata/sf0.001"


def test_isclose_and_finite(spark):
    inf, nan = float("inf"), float("nan")
    pairs = [(1.0, 1.0 + 9e-6), (1.0, 1.00002), (0.0, 5e-9), (0.0, 5e-8), (inf, inf), (inf, -inf), (1.0, inf), (nan, nan), (nan, 1.0), (1e9, 1e9 + 1)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, 1.0)])], "i int, a double, b double")
    got = {r.i: (r.c, r.z) for r in rows.select("i", isclose(F.col("a"), F.col("b")).alias("c"), finite(F.col("a")).alias("z")).collect()}
    assert [got[i][0] for i in range(len(pairs))] == [bool(np.isclose(a, b)) for a, b in pairs] and got[len(pairs)][0] is None
    assert [got[i][1] for i in range(len(pairs) + 1)] == [float(np.nan_to_num(a, nan=0, posinf=0, neginf=0)) for a, _ in pairs] + [0.0]


def test_days(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, d), t) for t, d in enumerate((2, 3, 6, 7))], "d date, t int")
    assert [r.c for r in days.orderBy("t").select(clip_day(F.col("d"), "2020-01-03", dt.date(2020, 1, 6)).alias("c")).collect()] == [dt.date(2020, 1, d) for d in (3, 3, 6, 6)]
    assert [start_index(days, d, 1) for d in ("2019-12-31", "2020-01-04", "2020-01-07", "2020-02-01")] == [1, 2, 3, 4]


def test_names_and_rounding(spark):
    names = ["a/origin-10.npz", "origin_2.npy", "/x9/none", "run3/origin0007-final.json"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", number_in_name(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == dict(zip(names, (10, 2, None, 7)))
    deep = spark.sql("SELECT 1.23456789D AS a, struct(2.000000049D AS x, 'k' AS y) AS s, array(0.12345678D, null) AS l, map('m', 9.87654321D) AS m, CAST(null AS struct<z: double>) AS e, 7 AS i")
    assert rounded(deep, 6).first().asDict(True) == {"a": 1.234568, "s": {"x": 2.0, "y": "k"}, "l": [0.123457, None], "m": {"m": 9.876543}, "e": None, "i": 7}


def test_pairing_and_ranking(spark):
    a, b = (spark.createDataFrame([(k, v) for k in ks], f"origin int, {c} int") for ks, v, c in (((1, 2, 3), 5, "x"), ((1, 2, 3), 6, "y")))
    assert one_to_one(a, b, "origin").count() == 3
    for other in (b.where("origin > 1"), b.union(b.limit(1)), b.union(spark.createDataFrame([(9, 9)], b.schema))):
        with pytest.raises(ValueError, match="times on the"):
            one_to_one(a, other, "origin")
    runs = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.5)], "m string, v double")
    assert ranking(runs, "m", "v").first().ranking == ["c", "a", "b"]


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5)], "a int, b double")
    assert report("T", {"One": table}, {"One": ["a note"]}) == "# T\n\n## One\n\n- a note\n\n| a | b |\n|---|---|\n| 1 | 0.5 |\n"
    text = pair_report(spark, SF, f"file://{tmp_path}/pairs.md")
    assert read_text(spark, f"file://{tmp_path}/pairs.md") == text and text.count("\n## ") == 5 and "run_cost_sensitivity_experiment" in text
    assert "| H7 |" in diagnostic_report(spark, SF)


def test_relation_checks_what_it_is_given(spark):
    with pytest.raises(KeyError, match="no step"):
        relation(spark, SF, "unknown_step")
    with pytest.raises(ValueError, match="neither"):
        relation(spark, SF, "event_props", event=spark.range(1))
    with pytest.raises(TypeError, match="DataFrame"):
        relation(spark, SF, "event_props", events=[1])


def test_rewritten_tables_give_new_answers(spark, tmp_path):
    def write(n):
        import duckdb

        duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' LIMIT {n}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")

    write(500)
    first = relation(spark, str(tmp_path), "panel_build").count()
    assert first == relation(spark, str(tmp_path), "panel_build").count()
    write(50)
    assert relation(spark, str(tmp_path), "panel_build").count() < first
