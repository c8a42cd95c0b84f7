"""Bucketed prefix sums, ranks, quantiles and top-n against brute force, with one hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import ordered as od
from slidegrid.operators.skew import copies_join, spread_join


@pytest.fixture(scope="module")
def hot_frame(spark):
    rng = np.random.default_rng(5)
    n = 3000
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
    v = np.round(rng.normal(0, 5, n), 1)
    v[rng.random(n) < 0.3] = 1.5
    pdf = pd.DataFrame({"g": g, "i": np.arange(n), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_running_totals_match_cumsum(hot_frame):
    pdf, df = hot_frame
    got = od.running_totals(
        df.withColumn(od.BUCKET, od.index_bucket(F.col("i"), 97)), ["g"], ["i"], {"s": F.col("v")}, with_total=True
    ).toPandas().sort_values("i")
    want = pdf.sort_values("i").groupby("g")["v"]
    assert np.allclose(got["s"], want.cumsum())
    assert np.allclose(got["total_s"], want.transform("sum"))


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_quantiles_match_numpy_for_any_bucket_count(hot_frame, buckets):
    pdf, df = hot_frame
    splits = od.split_points(df, "v", buckets)
    got = od.group_quantiles(df, ["g"], "v", {"a": 0.01, "m": 0.5, "z": 0.99}, splits=splits).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "m", "z"]].astype(float), np.percentile(part["v"], [1, 50, 99]))


@pytest.mark.parametrize("most", [9, 20_000])
def test_selected_quantiles_are_exact(spark, hot_frame, most):
    """Several rounds of selection, ties at the points, far outliers, infinities, and no group at all."""
    rng = np.random.default_rng(9)
    n = 30_000
    v = np.where(rng.random(n) < 0.35, 2.0, rng.normal(0, 3, n) * 10.0 ** rng.integers(-30, 30, n))
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, 1, rng.integers(2, 40, n)), "v": v})
    df = spark.createDataFrame(pdf).repartition(6)
    probs = {"a": 0.01, "m": 0.5, "z": 0.99, "top": 1.0, "least": 0.0}
    q = [1, 50, 99, 100, 0]
    got = od.group_quantiles(df, ["g"], "v", probs, most=most).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, list(probs)].astype(float), np.percentile(part["v"], q))
    one = od.group_quantiles(df, [], "v", probs, most=most).first()
    assert np.allclose([one[k] for k in probs], np.percentile(v, q)) and one["n"] == n
    far = spark.createDataFrame([(x,) for x in [float("inf")] * 30 + [float("-inf")] * 30 + [1.5] * 9 + [float("nan")]] + [(None,)], "v double")
    row = od.group_quantiles(far, [], "v", {"lo": 0.0, "m": 34 / 68, "hi": 1.0}, most=most).first()
    assert row["n"] == 69 and row["lo"] == float("-inf") and row["m"] == 1.5 and row["hi"] == float("inf")


def test_selection_orders_few_rows(spark):
    """Over a million distinct values the rows that are left to order are under one percent, and the median is exact."""
    df = spark.range(1_000_000, numPartitions=8).selectExpr("cast(pmod(xxhash64(id), 1000000007) as double) AS v")
    row = od.group_quantiles(df, [], "v", {"m": 0.5}).first()
    v = np.sort(df.toPandas()["v"].to_numpy())
    assert row["m"] == np.median(v) and od.ORDERED_ROWS <= 0.02 * len(v)
    assert od.group_quantiles(df, [], "v", {"m": 0.5}, most=2000).first()["m"] == np.median(v)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert od.group_quantiles(none, ["g"], "v", {"m": 0.5}).count() == 0
    row = od.group_quantiles(none, [], "v", {"m": 0.5}).first()
    assert row["n"] == 0 and row["m"] is None


def test_quantiles_with_weights_and_bounded_domain(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 10, 1), (1, 20, 1)], "g int, v int, w int")
    got = od.group_quantiles(df, ["g"], "v", {"m": 0.5, "h": 0.75}, bounded=True, weight="w").first()
    assert (got["m"], got["h"], got["n"]) == (0.0, 10.0, 5)


def test_dense_positions_and_sample_cap(hot_frame):
    pdf, df = hot_frame
    pos = od.dense_positions(df, ["g"], ["i"], od.index_bucket(F.col("i"), 50)).toPandas().sort_values("i")
    assert (pos["pos"].to_numpy() == pdf.groupby("g").cumcount().to_numpy()).all()
    capped = od.sample_cap(df, ["g"], ["i"], 25, seed=4).toPandas()
    sizes = capped.groupby("g").size()
    assert (sizes == np.minimum(pdf.groupby("g").size(), 25)).all()
    again = od.sample_cap(df.repartition(2), ["g"], ["i"], 25, seed=4).toPandas()
    assert set(capped["i"]) == set(again["i"])
    for digits in (1, 4):
        assert set(capped["i"]) == set(od.sample_cap(df, ["g"], ["i"], 25, seed=4, digits=digits).toPandas()["i"])
    assert [od.hash_digits(n) for n in (0, 16 * 4096, 16 * 4096 + 1, 10**12)] == [1, 1, 2, 7]
    assert set(capped["i"]) != set(od.sample_cap(df, ["g"], ["i"], 25, seed=5).toPandas()["i"])


def test_top_n_has_the_right_rows(hot_frame):
    pdf, df = hot_frame
    got = od.top_n(df, ["g"], [F.col("v").desc(), F.col("i").asc()], 7, ["i"]).toPandas()
    want = pdf.sort_values(["v", "i"], ascending=[False, True]).groupby("g").head(7)
    assert set(got["i"]) == set(want["i"])


def test_first_per_and_read_positions(hot_frame, spark, tmp_path):
    pdf, df = hot_frame
    got = od.first_per(df, ["g"], ["i"]).toPandas().set_index("g")["i"]
    assert (got.sort_index() == pdf.groupby("g")["i"].min()).all()
    spark.range(1000, numPartitions=7).write.parquet(str(tmp_path / "t"))
    pos = od.read_positions(spark.read.parquet(str(tmp_path / "t"))).toPandas()
    assert sorted(pos["pos"]) == list(range(1000))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_join(spark, hot, how):
    big = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(200)], "k int, i int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z")], "k int, s string")
    want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
    for join in (spread_join, copies_join):
        assert sorted(map(tuple, join(big, small, ["k"], how).collect()), key=str) == want
