"""Class counts, balanced weights and profile reports (AG1, AG2, AG19, AG23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import d


def class_counts(df: DataFrame, label: str = "y", by: list[str] | None = None) -> DataFrame:
    """AG1: rows per class (and per ``by`` group), always both classes 0 and 1.

    A partial (map-side) aggregation, so a class holding most rows costs no
    more than a small one.
    """
    by = by or []
    y = F.col(label)
    # Both classes as conditional sums in one aggregation, then unpivoted, so
    # an absent class still reports 0 without any join.
    wide = df.groupBy(*by).agg(
        F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    return wide.select(*by, F.expr("stack(2, 0, n0, 1, n1) as (y, n)")).select(
        *by, F.col("y").cast("int").alias("y"), F.col("n").cast("bigint").alias("n"))


def balanced_weights(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG2: ``w_c = n / (2 * max(1, n_c))`` per class, from :func:`class_counts`."""
    # The counts table has two rows per group, so this window is tiny.
    out = counts.withColumn("_tot", F.sum("n").over(_w(by or [])))
    return out.select(*counts.columns,
                      (F.col("_tot").cast("double") / (d(2.0) * F.greatest(F.col("n"), F.lit(1)).cast("double")))
                      .alias("bal_weight"))


def _w(by):
    from pyspark.sql import Window
    return Window.partitionBy(*by) if by else Window.partitionBy()


def weight_with_balance(df: DataFrame, weights: dict[int, float], label: str = "y") -> DataFrame:
    """Attach the per-class weight as column ``w`` (driver literals, no join)."""
    return df.withColumn("w", F.when(F.col(label) > 0, d(weights[1])).otherwise(d(weights[0])))


def weight_stats(df: DataFrame, col: str = "weight") -> DataFrame:
    """AG19: mean / min / max of a weight column."""
    return df.agg(F.avg(col).alias("weight_mean"), F.min(col).alias("weight_min"),
                  F.max(col).alias("weight_max"), F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, part_col: str, id_col: str, cat_cols: list[str]) -> DataFrame:
    """AG23: rows and distinct ids per part, distinct values per categorical column, and the least, median and greatest of those.

    Each distinct count is an aggregation of its own over its two columns, so no row is copied once a column;
    the pieces have one row a part.
    """
    out = df.groupBy(part_col).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(id_col).alias("n_ids"))
    names = []
    for c in cat_cols:
        names.append(f"nd_{c}")
        own = df.groupBy(F.col(part_col).alias("__part")).agg(F.count_distinct(c).alias(names[-1]))
        out = out.join(own, F.col(part_col).eqNullSafe(F.col("__part"))).drop("__part")
    if names:
        every = F.sort_array(F.array(*names))
        n = len(names)
        median = (F.element_at(every, (n - 1) // 2 + 1) + F.element_at(every, n // 2 + 1)) / 2
        out = out.select("*", F.element_at(every, 1).alias("cat_min"), median.alias("cat_median"), F.element_at(every, n).alias("cat_max"))
    return out


def normalise_mean(df: DataFrame, col: str, eps: float = 1e-12, skip_nonpositive: bool = False) -> DataFrame:
    """AG18: ``w / (mean(w) + eps)`` (or unchanged when the mean is <= 0 and
    ``skip_nonpositive``). The mean is fitted by one aggregation and applied as a
    literal, so no join (and no cross product with a one-row table) is planned."""
    mean = df.agg(F.avg(col)).first()[0]
    mean = 0.0 if mean is None else float(mean)
    if skip_nonpositive:
        return df.withColumn(col, F.col(col) / d(mean) if mean > 0 else F.col(col))
    return df.withColumn(col, F.col(col) / d(mean + eps))
