"""Cross-fitting Spark ML learners into out-of-fold tables (ML1-ML10, ML16, ML17).

The encoded training frame is persisted once; each (seed, fold) fit is an
ordinary distributed ``Estimator.fit`` over ``fold != k`` and a ``transform``
of the held fold and of the test rows. Held-fold scores are unioned into the
OOF table (averaged by id only when there are several seeds); all fold models
score the test rows in one pass, each into its own column, and the columns are
averaged, so test scoring needs no shuffle. Both score tables are written to the
shared folder. Only fitted models and per-fold metrics live on the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark import StorageLevel

from ..functions.scalar import clip, d, odds_weight
from ..operators import counts as C
from ..operators.joins import union_domains
from ..operators.rank import stratified_folds
from ..session import materialise
from .resume import FitStore

# Fixed defaults of the reference's runners.
FOLDS, SEED = 5, 42
# Independent fits (folds, seeds, grid points) submitted at once, at most; each is an
# ordinary distributed job, so this only overlaps their driver-side gaps.
FIT_THREADS = 4
# Memory that a tree learner takes for a row while it fits (binned points, margins, sampling counts as objects), and a row of its frame.
FIT_ROW_BYTES, FRAME_ROW_BYTES = 400, 150
# Rows in a partition of a fitting frame, where the cores do not ask for more partitions.
PART_ROWS = 1_000_000
EXTRA_WEIGHT = 0.3
ADV_CLIP = (0.1, 10.0)


def prob1(col: str = "probability"):
    """P(class 1) from a Spark ML probability vector."""
    return vector_to_array(F.col(col))[1]


def fit_frame(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, written, in as many partitions as there are cores, or more of ``PART_ROWS`` rows; dealt and sorted by ``keys``.

    A learner makes many passes and sends its statistics once a partition and pass, so a frame left in the partitions
    of a shuffle costs more by tasks and statistics than by rows."""
    df = materialise(df, "fit-frame")
    n = df.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    out = df.repartition(parts, *keys).sortWithinPartitions(*keys) if keys else df.repartition(parts)
    out._foldwise_rows = n  # for `fit_memory`
    return out


def storage_bytes(spark: SparkSession) -> int:
    """Memory of all executors (a local master's own) for persisted data and execution."""
    status, local = spark.sparkContext._jsc.sc().getExecutorMemoryStatus(), spark.sparkContext.master.startswith("local[")
    sizes, each = [], status.valuesIterator()
    while each.hasNext():
        sizes.append(int(each.next()._1()))
    return sum(sizes) if local or len(sizes) < 2 else sum(sizes) * (len(sizes) - 1) // len(sizes)  # without the driver's


def fit_memory(rows: int, room: int, jobs: int) -> tuple[int, StorageLevel]:
    """(fits to run at once, where their frame is kept).

    Learners persist their rows as objects. What does not fit into ``room`` bytes goes to disk by Java's
    serialisation, again at every pass, which costs several times the pass itself. So only as many fits run at once as there is room
    for, and the frame, which a fit reads a few times only, goes to disk where it would take the learner's room."""
    own = max(1, rows * FIT_ROW_BYTES)
    at_once = max(1, min(FIT_THREADS, jobs, room // own))
    return at_once, StorageLevel.MEMORY_AND_DISK if at_once * own + rows * FRAME_ROW_BYTES <= room else StorageLevel.DISK_ONLY


@dataclass
class CrossFitResult:
    oof: DataFrame                 # id, y, oof_pred (seed-averaged)
    test: DataFrame | None         # id, pred (fold- and seed-averaged)
    fold_metrics: list[dict] = field(default_factory=list)  # seed, fold and, with early stopping, rounds and losses
    models: dict = field(default_factory=dict)
    scored: DataFrame | None = None  # id, y, seed, fold, p: a row per id and seed
    refitted: list = field(default_factory=list)  # (seed, fold) fitted now, the others were loaded


@dataclass(frozen=True)
class EarlyStop:
    """ML17: keep the rounds up to the held fold's best loss, found with this patience (WN3's rule).

    All rounds are fitted and their losses known, so a patience of all rounds finds the least loss of all."""

    patience: int
    min_delta: float = 0.0


_ML_OUTPUTS = ("prediction", "probability", "rawPrediction")


def cross_fit(train: DataFrame, make: Callable[[int], Estimator], id_col: str = "id", label: str = "label",
              fold: str | dict[int, str] = "fold", n_folds: int = FOLDS, seeds: tuple[int, ...] = (SEED,),
              test: DataFrame | None = None, score: Callable[[DataFrame], object] | None = None,
              hard_label: str | None = None, keep_models: bool = False, keep: list[str] | None = None,
              early: EarlyStop | None = None, frame: Callable[[DataFrame, int, int], DataFrame] | None = None,
              store: FitStore | None = None) -> CrossFitResult:
    """ML1/ML16: for every seed and fold, fit ``make(seed)`` on the other folds (extra rows of
    :func:`union_extra` have fold -1 and so train every fold), score the held fold (OOF) and the test rows.

    ``score`` maps a transformed frame to the prediction column (default
    P(class 1)); ``hard_label`` names the 0/1 column reported in the OOF table
    when the training label is soft; ``keep`` carries more columns into it. ``fold`` is
    a column or, for seeds with folds of their own, a column by seed. ``frame(df, seed, fold)`` adds
    what is fitted per fold (``features``) to training, held and test rows. ``early`` cuts every boosted model
    to its best rounds on the held fold. ``store`` keeps each fitted model as soon as it is
    there; a later run with the same store loads it instead.

    Held folds are disjoint, so with one seed their union already has one row
    per id (no aggregation); several seeds are averaged by id. Test rows are
    scored by all fold models in one pass -- each model adds its own score
    column -- and averaged across columns, so test scoring needs no shuffle.
    """
    score = score or (lambda df: prob1())
    frame = frame or (lambda df, s, k: df)
    y_out = hard_label or label
    keep = keep or []
    jobs = [(s, k) for s in seeds for k in range(n_folds)]
    tr = fit_frame(train, id_col)
    threads, level = fit_memory(tr._foldwise_rows, storage_bytes(tr.sparkSession), len(jobs))
    tr = tr.persist(level)
    te = test.persist(StorageLevel.MEMORY_AND_DISK) if test is not None else None
    by_seed = {s: fold[s] if isinstance(fold, dict) else fold for s in seeds}
    done = store.committed() if store else {}
    refitted = []

    def fit(s: int, k: int) -> tuple:
        refitted.append((s, k))
        model = make(s).fit(frame(tr.where(F.col(by_seed[s]) != k), s, k))
        if early is None:
            return model, {}
        return stop_early(model, frame(tr.where(F.col(by_seed[s]) == k), s, k), early)

    def one(sk):
        s, k = sk
        return sk, store.fit(s, k, lambda: fit(s, k), done) if store else fit(s, k)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        fitted = list(pool.map(one, jobs))
    oofs, metrics, models = [], [], {}
    tt = te
    for i, ((s, k), (model, info)) in enumerate(fitted):
        if keep_models:
            models[(s, k)] = model
        held = model.transform(frame(tr.where(F.col(by_seed[s]) == k), s, k))
        oofs.append(held.select(id_col, F.col(y_out).alias("y"), *keep, F.lit(s).alias("seed"), F.lit(k).alias("fold"),
                                score(held).cast("double").alias("p")))
        if tt is not None:
            seen = tt.columns
            tt = model.transform(frame(tt, s, k))
            own = score(tt).cast("double").alias(f"__p{i}")
            # what the model and the fold's frame added goes again, a column they replaced comes back with the next frame
            tt = tt.select(*[c for c in seen if c not in _ML_OUTPUTS], own)
        metrics.append({"seed": s, "fold": k, **info})
    scored = oofs[0]
    for o in oofs[1:]:
        scored = scored.unionByName(o)
    scored = materialise(scored, "oof-scores")  # no reader scores the rows again, and the frames can go
    if len(seeds) == 1:
        oof = scored.select(id_col, F.col("y").cast("int").alias("y"), *keep, F.col("p").alias("oof_pred"))
    else:
        oof = scored.groupBy(id_col).agg(F.first("y").cast("int").alias("y"), *[F.first(c).alias(c) for c in keep],
                                         F.avg("p").alias("oof_pred"))
    tpred = None
    if tt is not None:
        cols = [F.col(f"__p{i}") for i in range(len(fitted))]
        tpred = materialise(tt.select(id_col, (sum(cols[1:], cols[0]) / F.lit(float(len(cols)))).alias("pred")), "test-scores")
        te.unpersist()
    tr.unpersist()
    return CrossFitResult(oof, tpred, metrics, models, scored, sorted(refitted))


# ------------------------------------------------------------------ learners
def gbt(seed: int, max_iter: int = 20, max_depth: int = 5, step: float = 0.1, subsample: float = 0.8,
        feature_subset: str = "all", weight: str | None = None, features: str = "features",
        label: str = "label", max_bins: int = 255, valid: str | None = None) -> GBTClassifier:
    """ML2/ML3/ML6: histogram-binned gradient-boosted trees. With ``valid``, a boolean column, fitting itself ends
    at the first round that does not lower the loss of those rows."""
    g = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                      stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=feature_subset,
                      seed=seed, maxBins=max_bins)
    if weight:
        g.setWeightCol(weight)
    if valid:
        g._set(validationIndicatorCol=valid, validationTol=0.0)
    return g


def random_forest(seed: int, trees: int = 600, min_leaf: int = 2, weight: str | None = None,
                  features: str = "features", label: str = "label", max_depth: int = 12) -> RandomForestClassifier:
    """ML5: random forest, sqrt feature sampling, leaves of at least 2 rows."""
    r = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees,
                               featureSubsetStrategy="sqrt", minInstancesPerNode=min_leaf, seed=seed,
                               maxDepth=max_depth)
    if weight:
        r.setWeightCol(weight)
    return r


def linear(seed: int, alpha: float = 1e-5, l1_ratio: float = 0.0, weight: str | None = None,
           features: str = "features", label: str = "label", max_iter: int = 100) -> LogisticRegression:
    """ML7: L2 / elastic-net logistic regression (no internal standardisation)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=alpha, elasticNetParam=l1_ratio,
                            standardization=False, maxIter=max_iter)
    if weight:
        lr.setWeightCol(weight)
    return lr


def mlp(seed: int, n_inputs: int, hidden: tuple[int, ...] = (32, 16), features: str = "features",
        label: str = "label", max_iter: int = 100) -> MultilayerPerceptronClassifier:
    """ML9: dense network on one-hot + standardised features (no dropout, no weights)."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_inputs, *hidden, 2], maxIter=max_iter, seed=seed)


def mlp_patient(train: DataFrame, valid: DataFrame, seed: int, n_inputs: int, hidden: tuple[int, ...] = (32, 16), rounds: int = 20,
                round_iter: int = 5, patience: int = 3, min_delta: float = 0.0, features: str = "features", label: str = "label") -> tuple:
    """ML9 with patience: the network is fitted in rounds of ``round_iter`` iterations, each from the weights of the one before,
    until ``patience`` rounds bring no better hold-out loss (WN3's rule). Returns (best model, its round, the losses)."""
    from ..operators.metrics import logloss_expr
    train, valid = train.persist(StorageLevel.MEMORY_AND_DISK), valid.persist(StorageLevel.MEMORY_AND_DISK)
    model, best, losses = None, None, []
    for i in range(rounds):
        net = mlp(seed, n_inputs, hidden, features, label, round_iter)
        if model is not None:
            net.setInitialWeights(model.weights)
        model = net.fit(train)
        scored = model.transform(valid).select(F.col(label).alias("y"), prob1().alias("p"))
        losses.append(float(scored.agg(logloss_expr("y", "p")).first()[0]))
        n = best_rounds(losses, patience, min_delta)
        if n == i + 1:
            best = model
        elif i + 1 - n >= patience:
            break
    train.unpersist()
    valid.unpersist()
    return best, best_rounds(losses, patience, min_delta), losses


# ------------------------------------------------------------------ early stopping
def best_rounds(losses: list[float], patience: int, min_delta: float = 0.0) -> int:
    """Rounds up to the best loss when evaluation ends after ``patience`` rounds without improvement (WN3's rule)."""
    best, best_i, bad = None, 0, 0
    for i, v in enumerate(losses):
        if best is None or v < best - min_delta:
            best, best_i, bad = v, i, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best_i + 1


def first_rounds(model, n: int):
    """A boosted model of the first ``n`` trees of ``model``, by its class's constructor from trees and weights."""
    if n >= len(model.trees):
        return model
    gateway = SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = model._java_obj.trees(), model.treeWeights
    some, numbers = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        some[i], numbers[i] = trees[i], float(weights[i])
    kind = ml.classification.GBTClassificationModel if isinstance(model, GBTClassificationModel) else ml.regression.GBTRegressionModel
    return model._copyValues(type(model)(kind(model.uid, some, numbers)))


def stop_early(model, held: DataFrame, early: EarlyStop) -> tuple:
    """ML17: (the model cut to its best rounds on the held fold, rounds and mean losses).

    ``evaluateEachIteration`` is one distributed pass over the held rows. Spark's classification loss is
    twice the log-loss; regression losses are squared errors. Held rows count alike, whatever their weight.
    """
    if model.hasParam("weightCol") and model.isSet("weightCol"):
        held = held.withColumn(model.getOrDefault("weightCol"), F.lit(1.0))
    losses = [v / 2 if isinstance(model, GBTClassificationModel) else v for v in model.evaluateEachIteration(held)]
    n = best_rounds(losses, early.patience, early.min_delta)
    return first_rounds(model, n), {"rounds": n, "loss": losses[n - 1], "full_rounds": len(losses), "full_loss": losses[-1]}


# ------------------------------------------------------------------ tuning
def tune_linear(train: DataFrame, valid: DataFrame, grid: list[dict], label: str = "label",
                features: str = "features", weight: str | None = None) -> tuple[dict, list[dict]]:
    """ML8: fit each config on the hash-split training side, score log-loss on the
    validation side; best = lowest loss, first config wins ties. Configs with
    ``balanced`` weigh rows by their class's n / (2 n_class), times ``weight``."""
    from ..operators.metrics import logloss_expr
    n = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    own = F.lit(1.0)
    for value, rows in n.items():
        own = F.when(F.col(label) == value, F.lit(sum(n.values()) / (len(n) * rows))).otherwise(own)
    train = train.withColumn("__balanced", own * (F.col(weight) if weight else F.lit(1.0)))
    train = fit_frame(train.select(label, features, "__balanced", *([weight] if weight else []))).persist(StorageLevel.MEMORY_AND_DISK)
    valid = fit_frame(valid.select(label, features)).persist(StorageLevel.MEMORY_AND_DISK)

    def one(item):
        i, cfg = item
        fit = {k: v for k, v in cfg.items() if k != "balanced"}
        m = linear(0, features=features, label=label, weight="__balanced" if cfg.get("balanced") else weight, **fit).fit(train)
        s = m.transform(valid).select(F.col(label).alias("y"), prob1().alias("p"))
        loss = s.agg(logloss_expr("y", "p").alias("l")).first()["l"]
        return {"trial": i, **cfg, "val_logloss": float(loss)}

    with ThreadPoolExecutor(max_workers=FIT_THREADS) as pool:
        results = list(pool.map(one, list(enumerate(grid))))
    train.unpersist()
    valid.unpersist()
    best = min(results, key=lambda r: (r["val_logloss"], r["trial"]))
    return best, results


def linear_grid() -> list[dict]:
    """22 configs: five L2 strengths and six elastic-net points, each without and with balanced weights.

    The two constant-learning-rate points have no counterpart in a batch solver.
    """
    # fixed values: strengths and l1 ratios
    l2 = [(a, 0.0) for a in (1e-6, 3e-6, 1e-5, 3e-5, 1e-4)]
    en = [(a, r) for a in (1e-6, 1e-5, 3e-5) for r in (0.15, 0.5)]
    return [{"alpha": a, "l1_ratio": r, "balanced": b} for a, r in l2 + en for b in (False, True)]


# ------------------------------------------------------------------ adversarial weights
def adversarial_weights(train: DataFrame, test: DataFrame, feature_cols: list[str], id_col: str = "id",
                        make: Callable[[int], Estimator] | None = None, n_folds: int = FOLDS, seed: int = SEED,
                        clip_range: tuple[float, float] = ADV_CLIP, normalise: bool = True,
                        assemble: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ML10a: cross-fitted train-vs-test classifier -> p(test | x) for every training
    row out of fold -> clipped odds -> normalised to mean 1. ``id, weight``."""
    make = make or (lambda s: gbt(s, max_iter=20, label="domain"))
    u = union_domains(train, test, [id_col, *feature_cols], "domain")
    u = u.withColumn("__uid", F.concat_ws(":", F.col("domain").cast("string"), F.col(id_col).cast("string")))
    u = u.withColumn("__uidh", F.xxhash64("__uid"))
    u = stratified_folds(u, "__uidh", "domain", n_folds, seed)
    if assemble:
        u = assemble(u)
    res = cross_fit(u.withColumn("label", F.col("domain").cast("double")), make, id_col="__uid", label="label",
                    fold="fold", n_folds=n_folds, seeds=(seed,), keep=[id_col, "domain"])
    p = res.oof.where(F.col("domain") == 0)
    w = p.select(id_col, odds_weight(F.col("oof_pred"), 1e-6, clip_range[0], clip_range[1]).alias("weight"))
    return C.normalise_mean(w, "weight") if normalise else w


# ------------------------------------------------------------------ students and stacks
def stack(oof_wide: DataFrame, test_wide: DataFrame, meta_cols: list[str], C: float = 1.0,
          label: str = "y", id_col: str = "id", mean_loss: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """ML12: L2 logistic regression on meta features of the OOF table. The penalty is ``1/(C n)``, which matches
    the summed-loss form, or with ``mean_loss`` ``1/C``, added to the mean loss. Returns (OOF scores, test
    scores, report with rows, coefficients, OOF loss and AUC)."""
    from pyspark.ml.feature import VectorAssembler
    from ..operators.metrics import score_metrics
    n = oof_wide.count()
    va = VectorAssembler(inputCols=meta_cols, outputCol="__x")
    lr = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1.0 / C if mean_loss else 1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=200)
    m = lr.fit(va.transform(oof_wide.withColumn(label, F.col(label).cast("double"))))
    oof = m.transform(va.transform(oof_wide)).select(id_col, label, clip(prob1(), 1e-15, 1 - 1e-15).alias("p"))
    test = m.transform(va.transform(test_wide)).select(id_col, clip(prob1(), 0.0, 1.0).alias("diagnosed_diabetes"))
    got = score_metrics(oof, label, "p").first()
    rep = {"n": n, "coef": list(m.coefficients), "intercept": m.intercept, "logloss": got["logloss"], "auc": got["auc"]}
    return oof, test, rep


def monotone_audit(model, df: DataFrame, feature_cols: list[str], signs: dict[str, int], delta: float,
                   inputs: list[str]) -> DataFrame:
    """ML14: raise one standardised feature by ``delta``, re-score, and report the mean
    ``relu(-sign * change in logit)`` per feature (0 = monotone as promised).

    Base and moved feature vectors are assembled side by side on the same rows
    and the model scores each through its own input column, so no join of two
    scored copies is needed: one scan per audited feature.
    """
    from pyspark.ml.feature import VectorAssembler
    from ..functions.scalar import logit
    base = VectorAssembler(inputCols=inputs, outputCol="__f0", handleInvalid="keep").transform(df)
    parts = []
    for f in feature_cols:
        moved_inputs = [f"__m_{c}" if c == f else c for c in inputs]
        x = base.withColumn(f"__m_{f}", F.col(f) + d(delta))
        x = VectorAssembler(inputCols=moved_inputs, outputCol="__f1", handleInvalid="keep").transform(x)
        m0 = model.copy().setFeaturesCol("__f0").setProbabilityCol("__p0").setRawPredictionCol("__r0") \
            .setPredictionCol("__y0")
        m1 = model.copy().setFeaturesCol("__f1").setProbabilityCol("__p1").setRawPredictionCol("__r1") \
            .setPredictionCol("__y1")
        sc = m1.transform(m0.transform(x))
        dz = logit(prob1("__p1")) - logit(prob1("__p0"))
        parts.append(sc.agg(F.avg(F.greatest(d(0.0), -d(float(signs[f])) * dz)).alias("violation"),
                            F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feature", "violation", "n")


def adversarial_weights_linear(train: DataFrame, test: DataFrame, num_cols: list[str], code_cols: list[str],
                               id_col: str = "id", max_rows: int = 250_000, seed: int = SEED,
                               clip_range: tuple[float, float] = (0.2, 5.0), reg: float = 1e-4) -> DataFrame:
    """ML10c: linear train-vs-test classifier, not cross-fitted.

    At most ``max_rows`` rows per side (TK4, reproducible by id hash) train an
    L2 logistic model on standardised numerics + one-hot codes; every training
    row is then scored, turned into clipped odds (p clipped at 1e-4) and
    normalised to mean 1. ``id, weight``.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from ..operators.rank import sample_n
    cols = [id_col, *num_cols, *code_cols]
    fit_rows = (sample_n(train.select(*cols), max_rows, id_col, seed).withColumn("label", F.lit(0.0))
                .unionByName(sample_n(test.select(*cols), max_rows, id_col, seed + 1).withColumn("label", F.lit(1.0))))
    fit_rows = fit_frame(fit_rows, id_col)
    enc = OneHotEncoder(inputCols=code_cols, outputCols=[f"{c}__oh" for c in code_cols],
                        handleInvalid="keep", dropLast=False).fit(fit_rows)
    va = VectorAssembler(inputCols=[*num_cols, *[f"{c}__oh" for c in code_cols]], outputCol="__x",
                         handleInvalid="keep")
    model = LogisticRegression(featuresCol="__x", labelCol="label", regParam=reg, standardization=False,
                               maxIter=100).fit(va.transform(enc.transform(fit_rows)))
    scored = model.transform(va.transform(enc.transform(train.select(*cols))))
    w = scored.select(id_col, odds_weight(prob1(), 1e-4, clip_range[0], clip_range[1]).alias("weight"))
    return C.normalise_mean(w, "weight")


def fold_mean_loss(fold_metrics: DataFrame, loss: str = "logloss", fold: str = "fold") -> DataFrame:
    """AG17: mean of the per-fold (best) losses, next to the number of folds."""
    per = fold_metrics.where(F.col(fold) >= 0)
    return per.agg(F.avg(loss).alias("fold_mean_loss"), F.count(F.lit(1)).alias("n_folds"))
