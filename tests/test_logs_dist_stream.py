import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foldwise.operators import dist as D
from foldwise.operators import logs as LG
from foldwise.streaming import stream_ops as SO

LINES = [
    "[seed=42 fold=0] epoch=31 val_logloss=0.605384",
    "[seed=42 fold=0] epoch=31 train_bce=0.523100 val_logloss=0.605384 lr=0.001",
    "  [seed=43 fold=1] epoch=2 train_bce=0.5, val_auc=nan foo bar=baz =3 x=1_000 y=inf z=1.5d",
    "noise line",
    "[seed=x fold=0] epoch=1 a=1",
]


def test_parse_lines(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "value string")
    got = sorted((r.seed, r.fold, r.epoch, r.metric, None if r.value != r.value else r.value)
                 for r in LG.parse_metric_lines(df).collect())
    assert got == sorted([
        (42, 0, 31, "val_logloss", 0.605384),
        (42, 0, 31, "train_bce", 0.5231), (42, 0, 31, "val_logloss", 0.605384), (42, 0, 31, "lr", 0.001),
        (43, 1, 2, "train_bce", 0.5), (43, 1, 2, "val_auc", None), (43, 1, 2, "x", 1000.0),
        (43, 1, 2, "y", float("inf")),
    ])


def test_best_metric_direction(spark):
    df = spark.createDataFrame([(1, 0, 1, "val_auc", 0.7), (1, 0, 2, "val_auc", 0.8), (1, 1, 1, "loss", 0.3),
                                (1, 1, 2, "loss", 0.3)], "seed long, fold long, epoch long, metric string, value double")
    b = {r.metric: (r.direction, r.best_value, r.best_epoch) for r in LG.best_metric(df).collect()}
    assert b == {"val_auc": ("max", 0.8, 2), "loss": ("min", 0.3, 1)}


def py_patience(vals, patience, min_delta):
    best, be, bad, stop = None, None, 0, None
    for e, v in vals:
        if best is None or v < best - min_delta:
            best, be, bad = v, e, 0
        else:
            bad += 1
            if bad >= patience:
                stop = e
                break
    return be, best, stop if stop is not None else vals[-1][0], vals.index((stop, v)) + 1 if stop else len(vals)


def test_patience_matches_python_loop(spark):
    rng = np.random.default_rng(8)
    rows, exp = [], {}
    for f in range(4):
        vals = [(e, float(np.round(1 / (e + 1) + rng.normal(0, 0.05), 3))) for e in range(1, 60)]
        rows += [(1, f, e, "val_logloss", v) for e, v in vals]
        exp[f] = py_patience(vals, 5, 1e-6)
    df = spark.createDataFrame(rows, "seed long, fold long, epoch long, metric string, value double")
    got = {r.fold: (r.best_epoch, r.best_value, r.stop_epoch, r.n_evals)
           for r in LG.patience_pick(df, "val_logloss", 5, 1e-6).collect()}
    assert got == exp


def test_patience_carries_its_state_over_blocks(spark):
    rng = np.random.default_rng(11)
    rows, exp = [], {}
    for f in range(4):  # run 0 improves to its end, the others stop in different blocks
        n = 40 + 7 * f
        vals = [(e, 1 / e if f == 0 or e < 10 * f else 1.0 + float(rng.random())) for e in range(1, n)]
        rows += [(1, f, e, "val_logloss", v) for e, v in vals]
        exp[f] = py_patience(vals, 5, 1e-6)
    rng.shuffle(rows := [tuple(r) for r in rows])
    df = spark.createDataFrame([(int(a), int(b), int(c), m, float(v)) for a, b, c, m, v in rows],
                               "seed long, fold long, epoch long, metric string, value double")
    for block in (4, 1000):
        got = {r.fold: (r.best_epoch, r.best_value, r.stop_epoch, r.n_evals)
               for r in LG.patience_pick(df, "val_logloss", 5, 1e-6, block=block).collect()}
        assert got == exp


def test_digitize_matches_searchsorted(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=2000), 2)
    long = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "feature": "f", "x": x}))
    e = D.fit_edges(long, 16, n_features=1)
    edges = np.array(e.first()["edges"])
    np.testing.assert_allclose(edges, np.quantile(x, [k / 16 for k in range(1, 16)]), atol=1e-12)
    got = D.digitize(long, e, 16, max_rows=1).orderBy("id").select("cell").toPandas().cell.to_numpy()
    assert (got == np.searchsorted(edges, x, side="right")).all()


def test_fold_counts_by_subtraction_equal_refit(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(900), "fold": rng.integers(0, 3, 900), "y": rng.integers(0, 2, 900),
                        "feature": "c", "cell": rng.choice(list("abcd"), 900)})
    cells = spark.createDataFrame(pdf)
    one_pass = D.fold_train_counts(cells, "y", "fold", 3).toPandas().set_index(["fold", "cell"]).sort_index()
    for k in range(3):
        refit = D.cell_counts(cells.where(F.col("fold") != k), "y").toPandas().set_index("cell").sort_index()
        sub = one_pass.loc[k]
        assert (sub.loc[refit.index, "c0"].to_numpy() == refit.c0.to_numpy()).all()
        assert (sub.loc[refit.index, "c1"].to_numpy() == refit.c1.to_numpy()).all()


def test_stream_scaler_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = SO.run_to_table(SO.stream_scaler(SO.file_stream(spark, f"{d}/events*.parquet", schema), ["value"]),
                        "test-scaler").first()
    b = spark.read.parquet(f"{d}/events.parquet").agg(F.count(F.lit(1)), F.avg("value"), F.stddev_pop("value")).first()
    assert s["n"] == b[0] and abs(s["mean_value"] - b[1]) < 1e-9 and abs(s["std_value"] - b[2]) < 1e-9


def test_nan_is_left_out_of_means_and_never_better(spark):
    from foldwise.operators import logs as L
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 1, "l", nan), (2, 0, 1, "l", 2.0), (1, 0, 2, "l", 3.0)],
                               "seed int, fold int, epoch long, metric string, value double")
    means = {r.epoch: r.mean_value for r in L.epoch_mean(df).collect()}
    assert means == {1: 2.0, 2: 3.0}
    pick = {r.seed: (r.best_epoch, r.best_value) for r in L.patience_pick(df, "l", 3).collect()}
    assert pick == {1: (2, 3.0), 2: (1, 2.0)}
