"""Loss and ranking metrics over long score tables (AG13-AG17, AG22, WN4).

All metrics are aggregations: map-side partial sums, one small shuffle. AUC is
exact (ties count half) without sorting a class into one task: scores are
first collapsed to distinct values with positive/negative counts, then the
negatives below each score come from prefix sums over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LOSS_EPS, d, row_logloss
from ..session import materialise
from .rank import range_prefix_sums


def logloss_expr(y: str, p: str, w: str | None = None, eps: float = LOSS_EPS) -> Column:
    """AG13 aggregate: mean loss, or ``sum(w loss)/sum(w)``; non-positive weight sum -> unweighted."""
    loss = row_logloss(F.col(y), F.col(p), eps)
    if w is None:
        return F.avg(loss)
    ww = F.col(w).cast("double")
    sw = F.sum(ww)
    return F.when(sw > 0, F.sum(ww * loss) / sw).otherwise(F.avg(loss))


def logloss(df: DataFrame, y: str, p: str, w: str | None = None, by: list[str] | None = None,
            eps: float = LOSS_EPS) -> DataFrame:
    """AG13 per group: ``by..., logloss, n``."""
    return df.groupBy(*(by or [])).agg(logloss_expr(y, p, w, eps).alias("logloss"),
                                       F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """AG14: exact ROC AUC per group (``by..., auc``); null when a class is absent."""
    by = by or []
    return _auc_of(materialise(_distinct_scores(df, y, p, by), "distinct-scores"), by)


def _distinct_scores(df: DataFrame, y: str, p: str, by: list[str], w: str | None = None) -> DataFrame:
    """One row per (group, distinct score): rows by class, and the sums behind AG13."""
    loss = row_logloss(F.col(y), F.col(p), LOSS_EPS)
    ww = F.lit(1.0) if w is None else F.col(w).cast("double")
    return df.groupBy(*by, F.col(p).cast("double").alias("__s")).agg(
        F.count_if(F.col(y) > 0).cast("double").alias("__pos"),
        F.count_if(~(F.col(y) > 0)).cast("double").alias("__neg"),
        F.count(F.lit(1)).alias("__n"), F.count(loss).alias("__nl"), F.sum(loss).alias("__l"),
        F.sum(ww).alias("__w"), F.sum(ww * loss).alias("__wl"))


def _auc_of(s: DataFrame, by: list[str]) -> DataFrame:
    c = range_prefix_sums(s, by, "__s", ["__neg"])
    num = F.sum(F.col("__pos") * (F.col("__neg_before") + d(0.5) * F.col("__neg")))
    den = F.sum("__pos") * F.sum("__neg")
    return c.groupBy(*by).agg(F.when(den > 0, num / den).alias("auc"))


def score_metrics(df: DataFrame, y: str, p: str, w: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Log-loss (weighted if ``w``), unweighted AUC and row count per group.

    ``df`` is read once: its distinct scores, with the sums of the loss, are written
    to the shared folder and both metrics come from them. Without groups the metrics
    are single numbers, assembled into one row locally; with groups the two tables,
    of one row per group, join on the group keys.
    """
    by = by or []
    s = materialise(_distinct_scores(df, y, p, by, w), "distinct-scores")
    if by:
        return _metrics_of(s, by, w)
    mean = F.try_divide(F.sum("__l"), F.sum("__nl"))
    if w is not None:
        mean = F.when(F.sum("__w") > 0, F.sum("__wl") / F.sum("__w")).otherwise(mean)
    r1, r2 = s.agg(mean.alias("logloss"), F.sum("__n").alias("n")).first(), _auc_of(s, by).first()
    return df.sparkSession.createDataFrame([(r1["logloss"], r1["n"], r2["auc"])],
                                           "logloss double, n bigint, auc double")


def _metrics_of(s: DataFrame, by: list[str], w: str | None) -> DataFrame:
    """``by..., logloss, n, auc`` from a written table of distinct scores; the two sides have one row a group."""
    mean = F.try_divide(F.sum("__l"), F.sum("__nl"))
    if w is not None:
        mean = F.when(F.sum("__w") > 0, F.sum("__wl") / F.sum("__w")).otherwise(mean)
    ll = s.groupBy(*by).agg(mean.alias("logloss"), F.sum("__n").alias("n"))
    return ll.join(_auc_of(s, by), by)


def _with_totals(s: DataFrame, by: list[str], fold: str) -> DataFrame:
    """Distinct scores of every (by, fold) and, as fold -1, of every ``by``: grouping sets over the distinct scores."""
    sums = [F.sum(c).alias(c) for c in s.columns if c.startswith("__") and c != "__s"]
    g = s.groupingSets([[*by, fold, "__s"], [*by, "__s"]], *by, fold, "__s").agg(*sums, F.grouping(fold).alias("__all"))
    at = F.when(F.col("__all") == 1, F.lit(-1)).otherwise(F.col(fold)).cast("int")
    return g.withColumn(fold, at).drop("__all")


def cv_metrics(scored: DataFrame, y: str, p: str, fold: str, w: str | None = None) -> DataFrame:
    """AG15: metrics per fold and over all rows (fold = -1 marks the overall row).

    Rows are aggregated once, to the distinct scores of each fold; the overall line adds
    those up. ``scored`` holds one OOF score per row; for several seeds see
    :func:`cv_metrics_seeds`.
    """
    s = materialise(_distinct_scores(scored.withColumn(fold, F.col(fold).cast("int")), y, p, [fold], w), "fold-scores")
    m = _metrics_of(materialise(_with_totals(s, [], fold), "distinct-scores"), [fold], w)
    return m.select(fold, "logloss", "auc", "n")


def cv_metrics_seeds(scored: DataFrame, y: str, p: str, fold: str, seed: str, id_col: str, w: str | None = None) -> DataFrame:
    """AG15/ML16: a line per (seed, fold), per seed (fold -1), and for the scores averaged by id over all seeds
    (seed -1, fold -1). ``scored``: one row per id and seed, whose fold may differ by seed.

    The loss of the average is not the average loss, so the last line has its own aggregation by
    id; the others come from the distinct scores of each (seed, fold).
    """
    x = scored.withColumn(fold, F.col(fold).cast("int")).withColumn(seed, F.col(seed).cast("int"))
    s = materialise(_distinct_scores(x, y, p, [seed, fold], w), "seed-scores")
    per = _metrics_of(materialise(_with_totals(s, [seed], fold), "distinct-scores"), [seed, fold], w)
    mean = ensemble_mean(scored, id_col, p, [y] if w is None else [y, w])
    mean = mean.withColumn(seed, F.lit(-1)).withColumn(fold, F.lit(-1))
    total = _metrics_of(materialise(_distinct_scores(mean, y, p, [seed, fold], w), "mean-scores"), [seed, fold], w)
    return per.unionByName(total).select(seed, fold, "logloss", "auc", "n")


def ensemble_mean(scores: DataFrame, id_col: str, p: str, keep: list[str] | None = None) -> DataFrame:
    """AG16/ML16: mean score per id (over fold models, then seeds); ``keep``: columns that are the same in all rows of an id."""
    return scores.groupBy(id_col).agg(*[F.first(c).alias(c) for c in keep or []], F.avg(p).alias(p))


def base_losses(oof_long: DataFrame, y: str = "y", p: str = "p", model: str = "model") -> DataFrame:
    """AG22: each model's own OOF log-loss and AUC."""
    return score_metrics(oof_long, y, p, None, [model])


def loss_summary(losses: DataFrame, col: str = "logloss") -> DataFrame:
    """AG22 report: min / mean / max over models."""
    return losses.agg(F.min(col).alias("loss_min"), F.avg(col).alias("loss_mean"), F.max(col).alias("loss_max"))
