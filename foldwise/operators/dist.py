"""Distribution features: quantile bins, class-conditional and train/test cell
statistics (AG8-AG10, JN7, JN8, SC12-SC14, ML15).

Everything runs in long form -- one row per (row id, feature) -- so the
number of features only adds rows, never columns, joins or jobs:

* edges:  exact quantiles per feature (optionally per fold) on distinct
  values; at most ``features x folds`` rows of ``num_bins - 1`` doubles, so
  they are broadcast;
* cells:  numeric value -> bin by a binary search into the edges (codegen'd),
  categorical value -> its text (missing token included);
* counts: one partial aggregation by (fold, feature, cell, class);
* lookup: rows join the count table on (fold, feature, cell); this table is
  bounded by features x (bins or categories) x folds.

Cross-fitting reuses one count pass: the training side of fold k is every row
whose own fold is not k, so each row is credited to the K-1 folds it trains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MISSING_TOKEN, d, nonfinite_to_null, to_number
from .common import bounded_broadcast, local_copy, with_count_below
from .rank import exact_quantiles, running_max

# Fixed defaults of the reference.
NUM_BINS = 128
ALPHA = 0.5


def quantile_probs(num_bins: int) -> list[float]:
    """``linspace(0, 1, bins + 1)[1:-1]``: the bins - 1 inner cut points."""
    return [k / num_bins for k in range(1, num_bins)]


def numeric_long(df: DataFrame, keep: list[str], cols: list[str],
                 impute: dict[str, float] | None = None) -> DataFrame:
    """``keep..., feature, x``: coerced numbers, non-finite -> null -> ``impute[c]``."""
    vals = []
    for c in cols:
        x = nonfinite_to_null(to_number(c))
        if impute is not None:
            x = F.coalesce(x, d(impute[c]))
        vals.append(x.alias(c))
    return df.select(*keep, *vals).unpivot(keep, cols, "feature", "x")


def cat_long(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """``keep..., feature, cell``: category text with missing as its own cell."""
    vals = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN)).alias(c) for c in cols]
    return df.select(*keep, *vals).unpivot(keep, cols, "feature", "cell")


def _fold_targets(fold: str, n_folds: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col(fold))


def fit_edges(train_long: DataFrame, num_bins: int = NUM_BINS, n_features: int | None = None,
              fold: str | None = None, n_folds: int | None = None) -> DataFrame:
    """AG8 + WN5: exact quantile edges per feature, made monotone by a running max.

    Without ``fold``: ``feature, edges``. With ``fold``: edges of each fold's
    training rows, ``fold, feature, edges``, from one pass over distinct values.
    """
    x = train_long.where(F.col("x").isNotNull())
    probs = quantile_probs(num_bins)
    if fold is None:
        cnt = x.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
        group, mg = ["feature"], n_features
    else:
        cnt = x.groupBy("feature", "x", fold).agg(F.count(F.lit(1)).alias("c"))
        cnt = (cnt.select("feature", "x", "c", F.explode(_fold_targets(fold, n_folds)).alias("__k"))
               .groupBy("feature", "__k", "x").agg(F.sum("c").alias("c")))
        group = ["feature", "__k"]
        mg = None if n_features is None else n_features * n_folds
    q = exact_quantiles(cnt, group, "x", "c", probs, max_groups=mg)
    e = q.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("q_idx", "q_value"))).alias("__qs"))
    e = e.select(*group, running_max(F.transform("__qs", lambda s: s["q_value"])).alias("edges"))
    if fold is not None:
        e = e.withColumnRenamed("__k", fold).withColumn(fold, F.col(fold).cast("int"))
    # Edges are a fitted model of features [x folds] rows: kept locally.
    return local_copy(e, mg) if mg is not None else e


def digitize(long: DataFrame, edges: DataFrame, num_bins: int = NUM_BINS, on: list[str] | None = None,
             max_rows: int | None = None, out: str = "cell") -> DataFrame:
    """JN7: bin index = number of edges <= x (``searchsorted(..., 'right')``), 0..bins-1.

    The edge table is broadcast (its rows are features [x folds]); the lookup
    is a binary search, O(log bins) per row.
    """
    on = on or ["feature"]
    j = long.join(bounded_broadcast(edges, max_rows), on)
    return with_count_below(j, F.col("x"), F.col("edges"), num_bins - 1, out, inclusive=True).drop("edges")


def cell_counts(cells: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """AG9/AG10: ``by..., feature, cell, c0, c1`` -- rows per cell and class."""
    by = by or []
    return cells.groupBy(*by, "feature", "cell").agg(
        F.count_if(F.col(label) == 0).cast("double").alias("c0"),
        F.count_if(F.col(label) == 1).cast("double").alias("c1"))


def fold_train_counts(cells: DataFrame, label: str, fold: str, n_folds: int) -> DataFrame:
    """Counts of every fold's training side from one pass: each row credited to the
    K-1 folds it trains. ``fold, feature, cell, c0, c1``."""
    own = cell_counts(cells, label, [fold])
    return (own.select("feature", "cell", "c0", "c1", F.explode(_fold_targets(fold, n_folds)).alias("__k"))
            .groupBy("__k", "feature", "cell").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
            .withColumnRenamed("__k", fold).withColumn(fold, F.col(fold).cast("int")))


def class_totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n0, n1 per (by, feature) from a cell count table (every feature sees every row)."""
    by = by or []
    return counts.groupBy(*by, "feature").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))


def log_ratio(c1: Column, n1: Column, c0: Column, n0: Column, cells: Column, alpha: float) -> Column:
    """SC12/SC14: ``ln((c1+a)/(n1+a*cells)) - ln((c0+a)/(n0+a*cells))``."""
    a = d(alpha)
    return F.log((c1 + a) / (n1 + a * cells)) - F.log((c0 + a) / (n0 + a * cells))


def apply_cell_ratio(rows: DataFrame, counts: DataFrame, totals: DataFrame, n_cells: DataFrame,
                     alpha: float = ALPHA, by: list[str] | None = None, out: str = "llr",
                     max_cells: int | None = None, max_features: int | None = None,
                     n_by_groups: int | None = None) -> DataFrame:
    """JN8: attach each row's cell statistic; unseen cells count as zero.

    ``n_cells`` holds ``feature, cells`` (bins for numeric, cardinality + 1 for
    categorical). Count tables are small (features x cells [x folds]) and are
    broadcast when that bound is given.
    """
    by = by or []
    if max_cells is None and (not by or n_by_groups is not None):
        # Proven bound: a feature has at most ``cells`` distinct cells (bins, or
        # cardinality + 1), times the number of ``by`` groups (folds). ``n_cells``
        # is a fitted table of one row per feature, so this read is cheap.
        total = n_cells.agg(F.sum("cells")).first()[0] or 0
        max_cells = int(total) * (n_by_groups or 1)
    j = rows.join(bounded_broadcast(counts, max_cells), [*by, "feature", "cell"], "left")
    ft = totals.join(n_cells, "feature")
    j = j.join(bounded_broadcast(ft, max_features), [*by, "feature"])
    c0, c1 = F.coalesce("c0", d(0.0)), F.coalesce("c1", d(0.0))
    return j.withColumn(out, log_ratio(c1, F.col("n1"), c0, F.col("n0"), F.col("cells").cast("double"), alpha)
                        ).drop("c0", "c1", "n0", "n1", "cells")


def nb_logit(llr_long: DataFrame, keys: list[str], llr: str = "llr") -> DataFrame:
    """SC13: per row, the sum of its per-feature log-likelihood ratios."""
    return llr_long.groupBy(*keys).agg(F.sum(llr).alias("nb_logit"))


def categorical_cells(frames: list[DataFrame], cols: list[str]) -> DataFrame:
    """Cell count of a categorical feature: distinct values over train U test (null
    counted) + 1 reserved slot, as the reference's code space. ``feature, cells``."""
    long = None
    for f in frames:
        x = cat_long(f, [], cols)
        long = x if long is None else long.unionByName(x)
    cells = long.groupBy("feature").agg((F.count_distinct("cell") + 1).cast("double").alias("cells"))
    return local_copy(cells, len(cols))


def numeric_cells(spark, cols: list[str], num_bins: int = NUM_BINS) -> DataFrame:
    return spark.createDataFrame([(c, float(num_bins)) for c in cols], "feature string, cells double")
