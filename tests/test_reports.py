"""Sketched distinct counts, profiles, sorted metrics, the stack's report and the network with patience."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldwise.operators import counts as C
from foldwise.operators import roles as R
from foldwise.plans import crossfit as CF
from foldwise.sources import sinks as SK


def test_sketched_roles_equal_the_exact_ones(spark):
    n = 3000
    cols = {f"c{k}": (lambda i, k=k: None if i % 97 == 0 and k % 2 else i % k) for k in (1, 2, 15, 16, 17, 31, 32, 33, 64, 900)}
    df = spark.createDataFrame([tuple(f(i) for f in cols.values()) for i in range(n)], ", ".join(f"{c} int" for c in cols))
    exact = df.agg(*[R.distinct_with_null(c).alias(c) for c in cols]).first()
    for threshold in (16, 32):
        got = R.distinct_counts(df, list(cols), threshold)
        assert {c: got[c] <= threshold for c in cols} == {c: exact[c] <= threshold for c in cols}
        assert all(got[c] == exact[c] for c in cols if exact[c] <= threshold)
        num, cat = R.split_low_card(df, df, list(cols), threshold)
        assert cat == [c for c in cols if exact[c] <= threshold] and num == [c for c in cols if exact[c] > threshold]
    assert R.distinct_counts(df.limit(0), ["c2"], 16) == {"c2": 0} and R.distinct_counts(df, [], 16) == {}


def test_bool_columns_count_like_integers(spark):
    df = spark.createDataFrame([(True, "x"), (False, None), (None, "y")], "b boolean, s string")
    assert {r.feature: (r.kind, r.n_unique) for r in R.low_card_profile(df, df, ["b", "s"]).collect()} == {"b": ("int", 3), "s": ("string", None)}
    assert R.split_types(df, ["b", "s"], bool_numeric=False) == ([], ["b", "s"])


def test_profile_without_copies_of_rows(spark):
    df = spark.createDataFrame([("a", 1, "x", "p", "k"), ("a", 1, "y", "p", None), ("a", 2, None, "p", "l"), (None, 3, "x", "q", "m")],
                               "part string, id int, c1 string, c2 string, c3 string")
    out = C.dataset_profile(df, "part", "id", ["c1", "c2", "c3"])
    got = {r.part: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (3, 2, 2, 1, 2, 1, 2.0, 2), None: (1, 1, 1, 1, 1, 1, 1.0, 1)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_sorted_metrics_have_their_places(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(s), int(f), int(e), m, float(rng.random())) for s in (1, 2) for f in range(3) for e in range(20) for m in ("b", "a")]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "seed int, fold int, epoch int, metric string, value double")
    SK.write_metrics_sorted(df, str(tmp_path / "m"))
    got = sorted(spark.read.parquet(str(tmp_path / "m")).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(rows)))
    assert [(r.metric, r.seed, r.fold, r.epoch) for r in got] == sorted((m, s, f, e) for s, f, e, m, _ in rows)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 0), float(a + b > 0)) for i, (a, b) in enumerate(x)],
                               "id int, a double, b double, y int, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


def test_network_keeps_its_best_round(points):
    train, valid = points.where("id % 5 > 0"), points.where("id % 5 = 0")
    model, best, losses = CF.mlp_patient(train, valid, 3, 2, (4,), rounds=6, round_iter=3, patience=2)
    assert losses[best - 1] == min(losses[:best]) and best <= len(losses) <= 6 and losses[best - 1] < 0.4
    from foldwise.operators.metrics import logloss_expr
    again = model.transform(valid).select("y", CF.prob1().alias("p")).agg(logloss_expr("y", "p")).first()[0]
    assert again == pytest.approx(losses[best - 1])


def test_stack_reports_loss_auc_and_both_penalties(spark, points):
    wide = points.select("id", "y", (F.col("a") * 2).alias("m1"), F.col("b").alias("m2"))
    _, test, small = CF.stack(wide, wide, ["m1", "m2"])
    _, _, strong = CF.stack(wide, wide, ["m1", "m2"], mean_loss=True)
    assert small["logloss"] < strong["logloss"] and small["auc"] > 0.95 and small["n"] == 600 == test.count()
    assert sum(np.abs(strong["coef"])) < sum(np.abs(small["coef"]))
