"""Early stopping, resumable fits, several seeds, fold-aware preprocessing and cross-fitted distribution features."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldwise.operators import fold_dist as FD
from foldwise.operators import metrics as M
from foldwise.operators.rank import range_prefix_sums
from foldwise.plans import crossfit as CF
from foldwise.plans.fold_preprocess import FoldPreprocessor, FoldPreprocessorModel
from foldwise.plans.resume import FitStore, learner_config, rows_digest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)).round(2)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), float(c), i % 3, (i * 7) % 3) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))],
                               "id long, a double, b double, y int, label double, fold int, other int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


def test_first_rounds_score_like_a_prefix(rows):
    m = CF.gbt(1, max_iter=6, max_depth=2).fit(rows)
    cut = CF.first_rounds(m, 2)
    assert len(cut.trees) == 2 and cut.treeWeights == m.treeWeights[:2] and CF.first_rounds(m, 9) is m
    margin = sum(w * t.transform(rows).orderBy("id").toPandas()["prediction"] for t, w in zip(m.trees[:2], m.treeWeights, strict=False))
    got = cut.transform(rows).orderBy("id").select(CF.prob1().alias("p")).toPandas()["p"]
    assert np.allclose(got, 1 / (1 + np.exp(-2 * margin)))


def test_early_stopped_models_give_the_scores(rows):
    make = lambda s: CF.gbt(s, max_iter=12, max_depth=4)
    res = CF.cross_fit(rows, make, n_folds=3, early=CF.EarlyStop(12), test=rows, keep_models=True)
    for m in res.fold_metrics:
        assert len(res.models[m["seed"], m["fold"]].trees) == m["rounds"] <= m["full_rounds"] == 12
        assert m["loss"] <= m["full_loss"]
        own = res.scored.where(F.col("fold") == m["fold"]).agg(M.logloss_expr("y", "p")).first()[0]
        assert own == pytest.approx(m["loss"], abs=1e-9)
    assert any(m["rounds"] < 12 for m in res.fold_metrics)
    assert res.test.count() == 400 and res.oof.select("id").distinct().count() == 400
    assert CF.best_rounds([3, 2, 2.5, 2.4, 1], 2) == 2 and CF.best_rounds([3, 2, 2.5, 1], 2) == 4 and CF.best_rounds([1], 1) == 1


def test_seeds_have_folds_of_their_own_and_are_averaged(rows):
    make = lambda s: LogisticRegression(regParam=0.1 if s == 1 else 10.0)
    res = CF.cross_fit(rows, make, n_folds=3, seeds=(1, 2), fold={1: "fold", 2: "other"})
    by = {(r.id, r.seed): r for r in res.scored.collect()}
    assert all(by[i, 1].fold == i % 3 and by[i, 2].fold == (i * 7) % 3 for i in range(400))
    for r in res.oof.collect():
        assert r.oof_pred == pytest.approx((by[r.id, 1].p + by[r.id, 2].p) / 2)
    report = {(r.seed, r.fold): r for r in M.cv_metrics_seeds(res.scored, "y", "p", "fold", "seed", "id").collect()}
    assert set(report) == {(-1, -1), *((s, k) for s in (1, 2) for k in (-1, 0, 1, 2))}
    whole = M.score_metrics(res.oof, "y", "oof_pred").first()
    assert report[-1, -1].logloss == pytest.approx(whole.logloss) and report[-1, -1].auc == pytest.approx(whole.auc)
    assert report[1, -1].n == 400 and sum(report[2, k].n for k in range(3)) == 400


class Dies(LogisticRegression):
    """A learner that fails after so many fits."""

    left = 99

    def fit(self, dataset, params=None):
        if Dies.left == 0:
            raise RuntimeError("lost")
        Dies.left -= 1
        return super().fit(dataset, params)


def test_a_dead_run_refits_only_what_is_missing(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(CF, "FIT_THREADS", 1)
    config = {"learner": learner_config(LogisticRegression(regParam=0.1)), "rows": rows_digest(rows.drop("features")), "folds": 3}
    make = lambda s: Dies(regParam=0.1)
    run = lambda store: CF.cross_fit(rows, make, n_folds=3, seeds=(1, 2), store=store)
    Dies.left = 4
    with pytest.raises(RuntimeError, match="lost"):
        run(FitStore.open(spark, str(tmp_path), config))
    store = FitStore.open(spark, str(tmp_path), config)
    assert sorted(store.committed()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    Dies.left = 99
    again = run(store)
    assert again.refitted == [(2, 1), (2, 2)]
    whole = CF.cross_fit(rows, make, n_folds=3, seeds=(1, 2))
    a, b = ({r.id: r.oof_pred for r in x.oof.collect()} for x in (again, whole))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i]) for i in a) and len(whole.refitted) == 6
    assert run(FitStore.open(spark, str(tmp_path), config)).refitted == []
    assert len(run(FitStore.open(spark, str(tmp_path), {**config, "folds": 4})).refitted) == 6  # another run's name


def test_saved_models_keep_their_rounds(spark, rows, tmp_path):
    store = FitStore.open(spark, str(tmp_path), {"x": 1})
    make = lambda s: CF.gbt(s, max_iter=8, max_depth=4)
    a = CF.cross_fit(rows, make, n_folds=3, early=CF.EarlyStop(2), store=store)
    b = CF.cross_fit(rows, make, n_folds=3, early=CF.EarlyStop(2), store=store)
    assert b.refitted == [] and b.fold_metrics == a.fold_metrics
    assert sorted(a.oof.collect()) == sorted(b.oof.collect())


def test_rows_digest_sees_changes_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert rows_digest(a) == rows_digest(a.orderBy(F.desc("i")).repartition(3))
    assert len({rows_digest(a), rows_digest(a.where("i = 1")), rows_digest(a.withColumn("i", F.col("i") + 1)), rows_digest(a.limit(0))}) == 4


# ---- preprocessing by fold

def test_every_row_is_filled_and_coded_by_its_own_fold(spark, tmp_path):
    data = [(0, 0, "1", "only0"), (1, 0, "3", "b"), (2, 1, "10", "a"), (3, 1, None, "b"), (4, 1, "x", None), (5, None, None, "only0"),
            (6, None, "inf", "new"), (7, -1, "4", "c")]
    df = spark.createDataFrame(data, "id int, fold int, v string, c string")
    train = df.where("id not in (5, 6)")
    model = FoldPreprocessor(numCols=["v"], catCols=["c"], numFolds=2).fit(train)
    model.write().save(str(tmp_path / "m"))
    for m in (model, FoldPreprocessorModel.load(str(tmp_path / "m"))):
        got = {r.id: (r.v_filled, r.c_code) for r in m.transform(df).collect()}
        # fold 0 is filled from rows 2 to 4 and 7 (median 7, codes a b c), fold 1 from rows 0, 1 and 7 (median 3, codes b c only0)
        assert got[0] == (1.0, -1) and got[1] == (3.0, 1)  # a value only the held fold has: -1
        assert got[2] == (10.0, -1) and got[3] == (3.0, 0) and got[4] == (3.0, 0)  # ties of the mode: the smallest value
        assert got[5] == (3.5, 3) and got[6] == (3.5, -1) and got[7] == (4.0, 2)  # without a fold: all training rows
        held = {r.id: (r.v_filled, r.c_code) for r in m.frame(df, 0).collect()}
        assert held[3] == (7.0, 1) and held[5] == (7.0, -1)
        assert m.outputs() == ["v_filled", "c_code"]
    none = FoldPreprocessor(numCols=["v"], catCols=["c"], numFolds=2).fit(df.limit(0))
    assert {(r.v_filled, r.c_code) for r in none.transform(df.where("id = 6")).collect()} == {(None, -1)}


# ---- distribution features

def plain_llr(values, labels, on, x, bins, alpha):
    """Log ratios of every x by loops."""
    train, y = values[on], labels[on]
    edges = np.quantile(train, [j / bins for j in range(1, bins)])
    cell = lambda v: np.searchsorted(edges, v, side="right")
    at = cell(train)
    out = []
    for b in cell(x):
        c1, c0 = ((at == b) & (y == 1)).sum(), ((at == b) & (y == 0)).sum()
        out.append(math.log((c1 + alpha) / ((y == 1).sum() + alpha * bins)) - math.log((c0 + alpha) / ((y == 0).sum() + alpha * bins)))
    return out


@pytest.mark.parametrize("kind", ["ties", "spread", "few"])
def test_fold_ratios_equal_plain_loops(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 9 if kind == "few" else 300
    v = rng.integers(0, 12, n).astype(float) if kind == "ties" else rng.normal(size=n).round(3)
    y, fold = rng.integers(0, 2, n), np.arange(n) % 4
    part = np.where(np.arange(n) % 9 == 8, "test", "train")
    df = spark.createDataFrame([(i, float(v[i]), "ab"[i % 2] if i % 5 else None, int(y[i]), int(fold[i]), str(part[i])) for i in range(n)],
                               "id int, v double, c string, y int, fold int, part string")
    model = FD.fit_fold_dist(df, ["v"], ["c"], n_folds=4, num_bins=8)
    for k in range(4):
        got = {r.id: r for r in model.fold_frame(df, "part", "fold", k, shift=True).collect()}
        want = plain_llr(v, y, (fold != k) & (part == "train"), v, 8, 0.5)
        assert all(got[i].llr_v == pytest.approx(want[i]) for i in range(n))
        assert all(got[i].nb_logit == pytest.approx(got[i].llr_v + got[i].llr_c) for i in range(n))
        assert all(got[i].kind == ("test" if part[i] == "test" else "held" if fold[i] == k else "in_sample") for i in range(n))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_folds_frame_moves_no_rows(spark):
    df = spark.createDataFrame([(i, float(i), str(i % 3), i % 2, i % 4, "train") for i in range(100)],
                               "id int, v double, c string, y int, fold int, part string")
    model = FD.fit_fold_dist(df, ["v"], ["c"], n_folds=4, num_bins=8)
    text = plan(model.fold_frame(df, "part", "fold", 1, shift=True))
    assert "Generate" not in text and "Expand" not in text and "SortMergeJoin" not in text
    assert "Exchange" not in text.replace("BroadcastExchange", "")


def test_prefix_sums_over_ranges(spark):
    df = spark.createDataFrame([(g, f"{k:03}", k) for g in "ab" for k in range(50)], "g string, k string, v long")
    for r in range_prefix_sums(df, ["g"], "k", ["v"]).collect():
        assert r.v_before == sum(range(r.v))


class _Spied:
    """An estimator that notes the partitions of what it is fitted on."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def fit(self, df):
        self.seen.append(df.rdd.getNumPartitions())
        return self.inner.fit(df)


def test_learners_get_as_many_partitions_as_cores(spark, rows, monkeypatch):
    cores, seen, real = spark.sparkContext.defaultParallelism, [], CF.linear
    many = rows.repartition(50, "id")
    CF.cross_fit(many, lambda s: _Spied(real(s, max_iter=2), seen), n_folds=3)
    monkeypatch.setattr(CF, "linear", lambda *a, **k: _Spied(real(*a, **k), seen))
    CF.tune_linear(many.where("fold < 2"), many.where("fold = 2"), CF.linear_grid()[:2])
    assert seen == [cores] * 5


def test_a_fitting_frame_grows_by_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(CF, "PART_ROWS", 20)
    got = CF.fit_frame(rows, "id")
    assert got.rdd.getNumPartitions() == 20
    assert sorted(got.select("id", "a").collect()) == sorted(rows.select("id", "a").collect())


def test_encoded_frames_do_not_join_the_customers_again(spark):
    from foldwise.plans import tabular as TB
    assert not [f for f in TB.encode_frame(spark, "/root/testdata/sf0.001").train.inputFiles() if "customer" in f]


def test_as_many_fits_at_once_as_memory_holds(rows, monkeypatch):
    import threading
    import time

    running, most, lock = [0], [0], threading.Lock()

    class Counted(LogisticRegression):
        def fit(self, dataset, params=None):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.5)
            try:
                return super().fit(dataset, params)
            finally:
                with lock:
                    running[0] -= 1

    scores = []
    for room, at_once in ((400 * CF.FIT_ROW_BYTES, 1), (10**9, 3)):
        monkeypatch.setattr(CF, "storage_bytes", lambda spark, room=room: room)
        most[0] = 0
        res = CF.cross_fit(rows, lambda s: Counted(regParam=0.1), n_folds=3)
        scores.append({r.id: r.oof_pred for r in res.oof.collect()})
        assert most[0] == at_once
    assert scores[0] == scores[1]


def test_a_frame_leaves_the_learner_its_memory(spark):
    assert CF.fit_memory(1000, 10**9, 5) == (CF.FIT_THREADS, CF.StorageLevel.MEMORY_AND_DISK)
    assert CF.fit_memory(1000, 2 * 1000 * CF.FIT_ROW_BYTES, 5) == (2, CF.StorageLevel.DISK_ONLY)
    assert CF.fit_memory(10**9, 10**9, 5) == (1, CF.StorageLevel.DISK_ONLY)
    assert CF.fit_memory(0, 10**9, 2)[0] == 2
    assert CF.storage_bytes(spark) > 10**8
