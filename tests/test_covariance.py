from residua import catalog

SMALLEST = "/root/testdata/sf0.001"


def test_every_pair_of_names_has_its_covariance(spark):
    got = catalog.queries()["shrunk_covariance"](spark, SMALLEST)
    names, dates = catalog.queries()["panel_build"](spark, SMALLEST).select("symbol").distinct().count(), got.select("on_t").distinct().count()
    assert dates > 0 and got.count() == got.select("on_t", "symbol_a", "symbol_b").distinct().count() == dates * names * (names + 1) // 2


def test_blocks_make_no_difference(spark):
    from residua.operators.evaluation import covariance_pairs

    lists = spark.createDataFrame([(t, s, [float(hash((t, k, j)) % 97) for j in range(6)]) for t in (1, 2) for k, s in enumerate("abcdefg")], "on_t int, symbol string, rets array<double>")
    one, many = ({(r.on_t, r.symbol_a, r.symbol_b): round(r.v, 9) for r in covariance_pairs(lists, b).collect()} for b in (100, 2))
    assert one == many and len(one) == 2 * 28 and all(a <= b for _, a, b in one)


def test_series_are_dealt_once_whatever_the_blocks(spark):
    """Whole series and a window against a list a date, missing values at a window's mean; no row is copied for the blocks it meets."""
    from pyspark.sql import functions as F

    from residua.operators.evaluation import covariance_pairs

    series = {s: [None if (t * k) % 11 == 5 or (s == "c" and t < 6) else float(hash((t, k)) % 89) for t in range(12)] for k, s in enumerate("abcdefg", 1)}
    filled = lambda x: [sum(v for v in x if v is not None) / max(1, sum(v is not None for v in x)) if y is None else y for y in x]
    lists = spark.createDataFrame([(t, s, filled(x[t - 6 : t])) for t in (6, 9, 12) for s, x in series.items()], "on_t int, symbol string, rets array<double>")
    whole = spark.createDataFrame([([6, 9, 12], s, x, 0) for s, x in series.items()], "on_t array<int>, symbol string, rets array<double>, since int")
    by_date = {(r.on_t, r.symbol_a, r.symbol_b): round(r.v, 9) for r in covariance_pairs(lists, 100).collect()}
    for block in (100, 2):
        assert {(r.on_t, r.symbol_a, r.symbol_b): round(r.v, 9) for r in covariance_pairs(whole, block, 6).collect()} == by_date and len(by_date) == 3 * 28
    plan = covariance_pairs(whole, 2, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    with_gap = whole.withColumn("rets", F.when(F.col("symbol") == "b", F.slice("rets", 1, 11)).otherwise(F.col("rets")))
    try:
        covariance_pairs(with_gap, 100, 6).collect()
    except Exception as e:
        assert "one row of every t" in str(e)
    else:
        raise AssertionError("a series that is too short was taken")
