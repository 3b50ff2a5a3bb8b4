import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.operators import rank as RK
from foldwise.operators import metrics as M


def skewed(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))     # one group holds ~70%
    x = np.round(rng.normal(size=n), 2)                              # many ties
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "g": g, "x": x}))


def test_two_level_row_number_equals_window(spark):
    df = RK.with_order_key(skewed(spark), "id", 42, "k", "b", bits=4)
    two = RK.two_level_row_number(df, ["g"], [F.col("k"), F.col("id")], F.col("b"), "rn", 4, 16)
    one = df.withColumn("rn1", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    j = two.join(one.select("id", "rn1"), "id")
    assert j.where(F.col("rn") != F.col("rn1")).count() == 0
    assert j.count() == 4000


def test_range_prefix_sums_equal_pandas(spark):
    df = skewed(spark).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    got = RK.range_prefix_sums(df, ["g"], "x", ["c"]).toPandas()
    got = got.sort_values(["g", "x"])
    exp = got.groupby("g")["c"].cumsum() - got["c"]
    assert (got["c_before"].to_numpy() == exp.to_numpy()).all()


def test_exact_quantiles_equal_numpy(spark):
    pdf = skewed(spark).toPandas()
    cnt = skewed(spark).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    probs = [k / 16 for k in range(1, 16)] + [0.5]
    q = RK.exact_quantiles(cnt, ["g"], "x", "c", probs, max_groups=4).toPandas()
    for g, sub in pdf.groupby("g"):
        exp = np.quantile(sub["x"].to_numpy(), probs)
        got = q[q.g == g].sort_values("q_idx")["q_value"].to_numpy()
        np.testing.assert_allclose(got, exp, rtol=0, atol=1e-12)


def test_exact_quantile_single_value_group(spark):
    df = spark.createDataFrame([(1, 3.0, 5)], "g int, x double, c long")
    q = RK.exact_quantiles(df, ["g"], "x", "c", [0.1, 0.5, 0.9]).collect()
    assert sorted(r["q_value"] for r in q) == [3.0, 3.0, 3.0]


def test_stratified_folds_balanced(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(5003) < 0.2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(5003), "y": y}))
    f = RK.stratified_folds(df, "id", "y", 5, 42, bits=3).toPandas()
    c = f.groupby(["y", "fold"]).size().unstack()
    assert (c.max(axis=1) - c.min(axis=1) <= 1).all()
    assert len(f) == 5003 and set(f.fold) == set(range(5))


def test_stratified_folds_fallback_on_odd_labels(spark):
    df = spark.createDataFrame([(i, 2 if i == 0 else i % 2) for i in range(100)], "id long, y int")
    f = RK.stratified_folds(df, "id", "y", 4, 1).toPandas()
    assert f.groupby("fold").size().tolist() == [25, 25, 25, 25]


def test_sample_n_exact_and_reproducible(spark):
    df = spark.range(3000)
    a = sorted(r.id for r in RK.sample_n(df, 500, "id", 9).collect())
    b = sorted(r.id for r in RK.sample_n(df, 500, "id", 9).collect())
    assert a == b and len(a) == 500
    c = sorted(r.id for r in RK.sample_n(df, 500, "id", 9, bits=4).collect())
    assert c == a
    import numpy as np
    from foldwise.functions.hashing import GOLDEN
    from tests_helpers import mix_order
    exp = mix_order(list(range(3000)), 9)[:500]
    assert a == sorted(exp)
    assert RK.sample_n(df, 10**6, "id", 9).count() == 3000


def test_auc_exact_with_ties_matches_pairs(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(600), 1)
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    got = M.auc(df, "y", "p").first()["auc"]
    pos, neg = p[y == 1], p[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert M.auc(df, "y", "p").first()["auc"] is None


def test_weighted_logloss_zero_weights_fall_back(spark):
    df = spark.createDataFrame([(1, 0.9, 0.0), (0, 0.2, 0.0)], "y int, p double, w double")
    got = M.logloss(df, "y", "p", "w").first()["logloss"]
    exp = -(np.log(0.9) + np.log(0.8)) / 2
    assert abs(got - exp) < 1e-12
