"""Encoded model frames and the stage graph over them (ML18).

``encode_frame`` is the Spark version of the reference's per-script
preparation: roles, numeric coercion with train statistics (N3), reserved-slot
category codes over train + test + extra (C4), a stratified fold column, and
one assembled feature vector. Every later stage reads DataFrames; only stage
outputs that are read more than once are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import d
from ..operators import encode as E
from ..operators.rank import stratified_folds
from ..session import materialise
from ..sources import fixtures as fx
from . import crossfit as CF

NUM = ["price_txt", "acctbal", "nation"]
CAT = ["priority", "segment"]
MAX_CATS = 2000


@dataclass
class Frames:
    train: DataFrame     # id, label, y, fold, <std numeric>, <codes>, features
    test: DataFrame      # id, <std numeric>, <codes>, features
    extra: DataFrame     # id, label, ..., features
    inputs: list[str]    # assembled input columns, in vector order


def signal_label(t1: DataFrame) -> DataFrame:
    """The learnable label of FIXTURES T1 (``acctbal`` predicts it)."""
    return t1.withColumn("y_sig", ((F.col("acctbal") + d(100.0) * (F.col("id") % 37).cast("double")) > d(6000.0)).cast("int"))


def encode_frame(spark, sf_dir: str, label: str = "y_sig", n_folds: int = CF.FOLDS,
                 seed: int = CF.SEED, write: bool = False) -> Frames:
    t = materialise(signal_label(fx.labelled_orders(spark, sf_dir)), "labelled")  # read by every fit below and by what comes after
    tr = t.where(F.col("part") == "train")
    stats = E.fit_numeric_stats(tr, NUM, "nan")
    vocab = E.vocab_freq(E.value_counts([t], CAT), MAX_CATS)

    def enc(df: DataFrame) -> DataFrame:
        x = df.select("id", "part", F.col(label).cast("double").alias("label"), F.col(label).alias("y"),
                      *[E.numeric_policy(c, stats[c], "impute_mean").alias(f"{c}_z") for c in NUM], *CAT)
        return E.lookup_codes(x, vocab, CAT, 1, MAX_CATS).drop(*CAT)

    inputs = [f"{c}_z" for c in NUM] + [f"{c}_code" for c in CAT]
    va = VectorAssembler(inputCols=inputs, outputCol="features")
    all_rows = va.transform(enc(t))
    train = stratified_folds(all_rows.where(F.col("part") == "train"), "id", "y", n_folds, seed)
    test = all_rows.where(F.col("part") == "test")
    extra = all_rows.where(F.col("part") == "extra")
    if write:
        train, test = materialise(train, "train-enc"), materialise(test, "test-enc")
        extra = materialise(extra, "extra-enc")
    return Frames(train, test, extra, inputs)


#: Members and weights of the logit blend, members of the stack.
BLEND = {"base": 0.25, "weighted": 0.35, "second": 0.25, "student": 0.15}
STACKED = ("base", "weighted", "second")
STUDENT_ALPHA, STUDENT_SMOOTHING = 0.7, 0.02


@dataclass
class Stages:
    """Aligned OOF (id, y, a column a model) and test scores (id, ...) of the members, and the two submissions."""

    oof: DataFrame
    test: DataFrame
    stack: DataFrame
    blend: DataFrame
    report: dict


def base_to_stack(spark, sf_dir: str, gbt_iter: int = 8, seed: int = CF.SEED) -> Stages:
    """ML18: base GBT (OOF + test) -> second family -> adversarial weights -> weighted GBT -> student distilled from
    the weighted teacher (hard and soft) -> logit blend of the four, and a stack of the first three's logits.

    Extra rows (ST2) are in the training side of every fold of the four cross-fits, with
    fold -1 and weight ``CF.EXTRA_WEIGHT``; the student learns their hard labels, as they
    have no out-of-fold teacher score."""
    from pyspark.ml.regression import GBTRegressor

    from ..operators import ensemble as EN
    from ..operators import joins as J
    fr = encode_frame(spark, sf_dir, write=True)
    mk = lambda s: CF.gbt(s, max_iter=gbt_iter, max_depth=4, weight="weight")
    other = lambda s: CF.gbt(s + 7, max_iter=gbt_iter, max_depth=3, subsample=0.7, weight="weight")

    def fit_rows(train: DataFrame, extra: DataFrame = fr.extra) -> DataFrame:
        return J.union_extra(train, extra, weight="weight", extra_weight=CF.EXTRA_WEIGHT)

    unweighted = fr.train.withColumn("weight", d(1.0))
    got = {"base": CF.cross_fit(fit_rows(unweighted), mk, test=fr.test, seeds=(seed,)),
           "second": CF.cross_fit(fit_rows(unweighted), other, test=fr.test, seeds=(seed,))}
    w = CF.adversarial_weights(fr.train, fr.test, fr.inputs, make=lambda s: CF.gbt(s, max_iter=gbt_iter, max_depth=3,
                                                                                       label="label"),
                               assemble=lambda u: VectorAssembler(inputCols=fr.inputs, outputCol="features").transform(u))
    w = materialise(w, "adv-weights")
    wtrain = J.attach_strict(fr.train, w, "id", "weight", "adversarial weights")
    got["weighted"] = CF.cross_fit(fit_rows(wtrain), mk, test=fr.test, seeds=(seed,))
    teacher = got["weighted"].oof.select("id", "y", "oof_pred")
    st_rows = J.distill_targets(unweighted, teacher, "id", "y", STUDENT_ALPHA, STUDENT_SMOOTHING)
    st_rows = fit_rows(st_rows, fr.extra.withColumn("y_soft", F.col("label")))
    got["student"] = CF.cross_fit(st_rows, lambda s: GBTRegressor(labelCol="y_soft", weightCol="weight", maxIter=gbt_iter,
                                                                  maxDepth=4, seed=s),
                                  test=fr.test, seeds=(seed,),
                                  score=lambda df: F.least(d(1.0), F.greatest(d(0.0), F.col("prediction"))))
    names = list(BLEND)
    oof = materialise(EN.align_predictions({k: got[k].oof.select("id", "y", "oof_pred") for k in names}, "oof_pred", "y"), "stage-oof")
    test = materialise(EN.align_predictions({k: got[k].test.withColumnRenamed("pred", "diagnosed_diabetes") for k in names},
                                            "diagnosed_diabetes"), "stage-test")
    meta_oof, cols = EN.meta_features(oof.select("id", "y", *STACKED), list(STACKED), ["logit"])
    meta_test, _ = EN.meta_features(test.select("id", *STACKED), list(STACKED), ["logit"])
    _, stacked, report = CF.stack(meta_oof, meta_test, cols)
    return Stages(oof, test, stacked, EN.blend(test, names, list(BLEND.values()), "logit"), report)
