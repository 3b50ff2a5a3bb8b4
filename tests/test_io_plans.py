import pytest
from pyspark.sql import functions as F

from foldwise.catalog import QUERIES
from foldwise.plans import preprocess as PP
from foldwise.session import scratch_path
from foldwise.sources import readers as RD
from foldwise.sources import sinks as SK
from conftest import SF001


def test_csv_schema_sampling_and_strict_readers(spark):
    path = scratch_path(spark, "csv-sample")
    df = spark.createDataFrame([(1, 0.5, "a", "true"), (2, 1.5, None, "false")], "id long, x double, s string, b string")
    df.write.option("header", True).csv(path)
    sch = RD.infer_schema_sample(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in sch.fields] == \
        [("id", "int"), ("x", "double"), ("s", "string"), ("b", "boolean")]
    with pytest.raises(ValueError):
        RD.read_weights(spark, path, fmt="csv")          # needs exactly {id, weight}


def test_csv_rows_after_the_first_ones_keep_their_values(spark):
    path = scratch_path(spark, "csv-late")
    rows = [(i, "1" if i < 600 else "2.5") for i in range(3000)]
    spark.createDataFrame(rows, "id long, weight string").coalesce(1).write.option("header", True).csv(path)
    w = RD.read_weights(spark, path, fmt="csv")
    assert w.where("weight = 2.5").count() == 2400
    x = RD.read_extra_train(spark, path, ["weight"], "id", fmt="csv")
    assert x.where("weight = 2.5").count() == 2400
    t = spark.createDataFrame([(i, "0.5" if i else "x") for i in range(3)], "id long, oof_pred string")
    p = scratch_path(spark, "csv-teacher")
    t.write.option("header", True).csv(p)
    assert RD.read_teacher(spark, p, fmt="csv").count() == 3


def test_oof_and_weights_roundtrip(spark):
    oof = spark.createDataFrame([(1, 1, 0.7), (2, 0, 1.3), (3, 2, None)], "id long, y int, oof_pred double")
    p = scratch_path(spark, "oof")
    SK.write_oof(oof.fillna({"oof_pred": 0.5}), p, compression="gzip")
    back = {r.id: (r.y, r.oof_pred) for r in RD.read_oof(spark, p, fmt="csv").collect()}
    assert back == {1: (1, 0.7), 2: (0, 1.0), 3: (1, 0.5)}
    w = spark.createDataFrame([(1, 2.0), (2, 0.5)], "id long, weight double")
    q = scratch_path(spark, "w")
    SK.write_weights(w, q, fmt="parquet")
    assert {r.id: r.weight for r in RD.read_weights(spark, q).collect()} == {1: 2.0, 2: 0.5}


def test_preprocessor_save_load_roundtrip(spark):
    tr = spark.createDataFrame([(1, 1, "a", 1.0), (2, 0, "b", 3.0), (3, 1, "a", None)], "id long, y int, c string, x double")
    te = spark.createDataFrame([(4, 0, "z", 2.0)], "id long, y int, c string, x double")
    pp = PP.fit_preprocessor(tr, te, "id", "y", 10)
    path = scratch_path(spark, "pp")
    pp.save(path)
    back = PP.load_preprocessor(spark, path)
    a = sorted(pp.transform(tr.unionByName(te)).collect())
    b = sorted(back.transform(tr.unionByName(te)).collect())
    assert a == b
    got = {r.id: (r.x, r.c_code) for r in b}
    assert got[3][0] == 0.0 and got[1][1] == 2 and got[4][1] in (3, 4)


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = QUERIES["holdout_split_counts"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    orders_scan = [line for line in plan.splitlines() if "orders.parquet" in line][0]
    assert "o_totalprice" not in orders_scan and "o_orderpriority" not in orders_scan
    assert "o_orderdate" in orders_scan


def test_extra_train_and_teacher_readers_are_strict(spark):
    p = scratch_path(spark, "extra")
    spark.createDataFrame([(1, 0.5, 1)], "a long, b double, tgt int").write.parquet(p)
    got = RD.read_extra_train(spark, p, ["a", "b"], "tgt", "y").columns
    assert got == ["a", "b", "y"]
    with pytest.raises(ValueError):
        RD.read_extra_train(spark, p, ["a", "c"], "tgt")
    t = scratch_path(spark, "teacher")
    spark.createDataFrame([(1, 0.9)], "id long, oof_pred double").write.parquet(t)
    assert RD.read_teacher(spark, t).first()["oof_pred"] == 0.9
    with pytest.raises(ValueError):
        RD.read_teacher(spark, t, strict=True)           # strict needs y as well


def test_stream_sgd_beats_constant_prior(spark):
    import math
    from foldwise.streaming import stream_ops as SO
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    ev = spark.read.parquet(f"{d}/events.parquet")
    mean, std = ev.agg(F.avg("value"), F.stddev_pop("value")).first()

    def src():
        s = SO.file_stream(spark, f"{d}/events*.parquet", schema)
        # a learnable label: large values
        return s.select(((F.col("value") - F.lit(mean)) / F.lit(std)).alias("z"),
                        (F.col("value") > F.lit(mean)).cast("int").alias("y"))
    w, b = SO.stream_sgd_logistic(spark, src, ["z"], "y", passes=3, lr=1.0)
    scored = SO.score_linear(ev.select(((F.col("value") - F.lit(mean)) / F.lit(std)).alias("z"),
                                       (F.col("value") > F.lit(mean)).cast("int").alias("y")), ["z"], w, b)
    from foldwise.operators.metrics import logloss
    loss = logloss(scored, "y", "p").first()["logloss"]
    rate = ev.where(F.col("value") > F.lit(mean)).count() / ev.count()
    prior = -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    assert w[0] > 0 and loss < prior


def test_no_cross_joins_in_plans(spark):
    # One-row statistics are applied as literals or through grouped passes; the
    # optimizer must not be left with a nested-loop (cross) join anywhere.
    for name in ("odds_weights", "cv_metrics", "extra_union_weights", "auc_exact", "stratified_folds"):
        df = QUERIES[name](spark, SF001)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_extra_rows_are_in_every_training_fold_of_the_stage_graph(spark, monkeypatch):
    from foldwise.plans import tabular as TB
    fits = []

    def fake(train, make, test=None, **_):
        fits.append((train, make(1).getWeightCol()))
        held = train.where("fold >= 0")
        return TB.CF.CrossFitResult(held.select("id", "y", (F.lit(0.4) + 0.2 * F.col("y")).alias("oof_pred")),
                                    test.select("id", F.lit(0.5).alias("pred")))

    monkeypatch.setattr(TB.CF, "cross_fit", fake)
    monkeypatch.setattr(TB.CF, "adversarial_weights", lambda tr, *_, **__: tr.select("id", F.lit(2.0).alias("weight")))
    sf = "/root/testdata/sf0.001"
    want = TB.encode_frame(spark, sf).extra.count()
    got = TB.base_to_stack(spark, sf)
    assert got.stack.count() == got.blend.count() > 0 and want > 0 and len(fits) == 4
    assert got.report["logloss"] < 0.7 and got.oof.columns == ["id", "y", *TB.BLEND]
    for train, weight_col in fits:
        extra = train.where("fold = -1").select("weight", "features", "label").collect()
        assert weight_col == "weight" and len(extra) == want
        assert {r.weight for r in extra} == {0.3} and all(r.features is not None and r.label is not None for r in extra)
    assert all(r.y_soft == r.label for r in fits[3][0].where("fold = -1").select("y_soft", "label").collect())
