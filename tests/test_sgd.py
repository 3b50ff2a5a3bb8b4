"""Averaged proximal SGD against a plain loop, chunks and byte-bounded streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.plans import sgd as SG
from foldwise.sources import readers as RD
from foldwise.streaming import stream_ops as SO

DIM = 16


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(240):
        idx = [int(x) for x in rng.integers(0, DIM, rng.integers(0, 4))]
        num = [float(x) for x in rng.normal(size=2).round(3)]
        data.append((i, int(num[0] + (3 in idx) + rng.normal() > 0.5), idx, num))
    return spark.createDataFrame(data, "id int, y int, idx array<int>, num array<double>").cache()


def plain(chunks, config, curvature, weights, passes):
    """The same steps on dense rows."""
    w, b = np.zeros(DIM + 2), 0.0
    mean_w, mean_b, steps, seen = np.zeros(DIM + 2), 0.0, 0, 0
    for _ in range(passes):
        for chunk in chunks:
            g, gb = np.zeros(DIM + 2), 0.0
            for y, idx, num in chunk:
                x = np.zeros(DIM + 2)
                for t in idx:
                    x[t] += 1
                x[DIM:] = num
                err = 1 / (1 + math.exp(-(w @ x + b))) - y
                if config.balanced:
                    err *= weights[y]
                g, gb = g + err * x, gb + err
            n = len(chunk)
            eta = config.eta0 if config.schedule == "constant" else 1 / (curvature + config.alpha * seen)
            w = w - eta * (g / n + config.alpha * (1 - config.l1_ratio) * w)
            w = np.sign(w) * np.maximum(np.abs(w) - eta * config.alpha * config.l1_ratio, 0)
            b -= eta * gb / n
            steps, seen = steps + 1, seen + n
            mean_w, mean_b = mean_w + (w - mean_w) / steps, mean_b + (b - mean_b) / steps
    return mean_w, mean_b


def test_coefficients_equal_a_plain_loop(spark, rows):
    configs = [SG.SgdConfig(1e-3), SG.SgdConfig(0.5, 0.5, balanced=True), SG.SgdConfig(1e-2, 0.15), SG.SgdConfig(1e-5, schedule="constant", eta0=0.05, balanced=True)]
    state = SG.fit_sgd(rows, configs, passes=2, dim=DIM, chunk_rows=50)
    chunks = [[(r.y, r.idx, r.num) for r in c.collect()] for c in SG.write_chunks(rows, "id", 50)]
    assert len(chunks) == 5 and sum(map(len, chunks)) == 240 and state.steps == 10 and state.rows_seen == 480
    n1 = sum(y for c in chunks for y, *_ in c)
    weights = {0: 240 / (2 * (240 - n1)), 1: 240 / (2 * n1)}
    zeros = 0
    for config, model in zip(configs, state.models(), strict=True):
        w, b = plain(chunks, config, state.curvature, weights, 2)
        got = np.zeros(DIM + 2)
        got[model.at] = model.coef
        assert np.allclose(got, w, atol=1e-10) and model.intercept == pytest.approx(b)
        zeros += int((state.coef[:, configs.index(config)] == 0).sum())
    assert zeros  # the l1 part shrinks coefficients to 0
    # losses and scores of the averaged model
    model = state.models()[0]
    p = {r.id: r.p for r in SG.sgd_scores(rows, model, dim=DIM).collect()}
    dense = np.zeros(DIM + 2)
    dense[model.at] = model.coef
    loss = 0.0
    for r in rows.collect():
        z = model.intercept + sum(dense[t] for t in r.idx) + float(np.dot(dense[DIM:], r.num))
        assert p[r.id] == pytest.approx(1 / (1 + math.exp(-z)))
        loss -= math.log(p[r.id] if r.y else 1 - p[r.id]) / 240
    assert SG.sgd_losses(rows, state.models(), DIM)[0] == pytest.approx(loss)


def test_tuning_keeps_the_least_loss(spark, rows):
    grid = [SG.SgdConfig(1e-5), SG.SgdConfig(1.0, 0.5), SG.SgdConfig(1e-5)]
    best, trials = SG.tune_sgd(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), grid, dim=DIM, chunk_rows=60)
    got = trials.orderBy("trial").collect()
    assert best == grid[0] and [r.best for r in got] == [True, False, False] and got[0].val_logloss == got[2].val_logloss < got[1].val_logloss
    assert len(SG.sgd_grid()) == 24 == len(set(SG.sgd_grid()))


def test_empty_chunks_and_unseen_features(spark, rows):
    state = SG.AveragedSgd([SG.SgdConfig()], DIM, 1.0)
    assert state.step(rows.where("id < 0")) == 0 and state.steps == 0
    assert state.step(rows.where("id < 10")) == 10
    unseen = spark.createDataFrame([(1, [DIM - 1] * 3, [0.0, 0.0]), (2, [], [0.0, 0.0])], "id int, idx array<int>, num array<double>")
    state.at, state.coef, state.mean = state.at[state.at != DIM - 1], state.coef[state.at != DIM - 1], state.mean[state.at != DIM - 1]
    p = [r.p for r in SG.sgd_scores(unseen, state.models()[0], dim=DIM).collect()]
    assert p[0] == p[1]
    assert SG.fit_sgd(rows.where("id < 0"), [SG.SgdConfig()], dim=DIM).steps == 0


def test_micro_batches_follow_the_bytes(spark, rows, tmp_path):
    path = str(tmp_path / "files")
    rows.repartition(6, "id").write.parquet(path)
    size = max(r.length for r in spark.read.format("binaryFile").load(path).select("length").collect())
    wide = RD.chunk_scan(spark, path, ["id", "y", "idx", "num"], rows.schema, 100 * size, "parquet")
    seen = []
    assert SO.stream_passes(lambda: wide, lambda b: seen.append(b.count())) == 1 and seen == [240]
    narrow = lambda: RD.chunk_scan(spark, path, ["id", "y", "idx", "num"], rows.schema, 2 * size, "parquet")
    state = SG.AveragedSgd([SG.SgdConfig()], DIM, 1.0)
    batches = SO.stream_passes(narrow, state.step, passes=2)
    assert 6 <= batches <= 12 and state.steps == batches and state.rows_seen == 480  # two to three files a batch, twice


def test_class_counts_by_side(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(0, "train"), (1, "train"), (1, "valid"), (1, "train")], "y int, side string").write.parquet(path)
    s = SO.file_stream(spark, path, "y int, side string")
    got = {(r.side, r.y): r.n for r in SO.run_to_table(SO.stream_class_counts(s, F.col("y"), "side"), "sides").collect()}
    assert got == {("train", 0): 1, ("train", 1): 2, ("valid", 1): 1}


def test_log_lines_of_a_folder(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"[seed=1 fold=0] epoch=1 loss=0.5,\r\nnoise \xff\xfe\n[seed=1 fold=0] epoch=2 loss=nan x=\xc3\n")
    (tmp_path / "b.log").write_bytes(b"[seed=2 fold=0] epoch=1 loss=1_0.5\n")
    from foldwise.operators.logs import parse_metric_lines
    got = {(r.seed, r.epoch): r.value for r in parse_metric_lines(RD.read_log_lines(spark, str(tmp_path))).collect()}
    assert got[1, 1] == 0.5 and math.isnan(got[1, 2]) and got[2, 1] == 10.5 and len(got) == 3
    assert "�" in "".join(r.value for r in RD.read_log_lines(spark, str(tmp_path)).collect())


def test_a_chunk_is_one_file_however_many_tasks_the_rows_come_from(spark, rows):
    chunks = SG.write_chunks(rows.repartition(30).select("id", "y", "idx", "num"), "id", chunk_rows=60)
    files = {f for c in chunks for f in c.inputFiles()}
    assert len(files) == len(chunks) == 4
    assert sorted(r["id"] for c in chunks for r in c.collect()) == list(range(240))


def test_small_chunks_share_jobs_and_larger_ones_give_the_same(spark, rows, monkeypatch):
    sc, configs = spark.sparkContext, [SG.SgdConfig(1e-3), SG.SgdConfig(1e-2, 0.15, balanced=True)]
    fits = {}
    for name, file_rows, most in (("one file", 100, 32), ("files", 5, 32), ("query", 5, 0)):
        monkeypatch.setattr(SG, "FILE_ROWS", file_rows)
        monkeypatch.setattr(SG, "MOST_PIECES", most)
        sc.setJobGroup(name, name)
        fits[name] = SG.fit_sgd(rows, configs, passes=1, dim=DIM, chunk_rows=12), len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(state.steps == 20 and state.rows_seen == 240 for state, _ in fits.values())
    for state, _ in fits.values():
        for a, b in zip(state.models(), fits["query"][0].models(), strict=True):
            assert np.array_equal(a.at, b.at) and np.allclose(a.coef, b.coef, atol=1e-10) and a.intercept == pytest.approx(b.intercept)
    assert fits["one file"][1] < 20 <= fits["files"][1] < fits["query"][1]
