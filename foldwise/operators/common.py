"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is hinted for broadcast only when its row count has a bound known
# from parameters (features x bins, groups x buckets, max_categories, ...)
# and that bound is below this many rows. Otherwise no hint is given and
# AQE decides from the measured size at run time.
BROADCAST_ROW_LIMIT = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int | None, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """``broadcast(df)`` if ``max_rows`` (a proven upper bound) is within ``limit``."""
    if max_rows is not None and max_rows <= limit:
        return F.broadcast(df)
    return df


def local_copy(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Materialise a small, bounded result (a fitted statistic) as a local relation.

    Fitting steps (bucket boundaries, offsets, quantile edges) produce at most
    groups x buckets or features x bins rows. Collecting them once, as a Spark
    ML ``fit`` does, keeps every later plan shallow: the plan that produced
    them is neither re-optimised nor re-run by each consumer.
    """
    rows = df.collect()
    if max_rows is not None and len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, got {len(rows)}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def tmp(prefix: str = "t") -> str:
    return f"__{prefix}{uuid.uuid4().hex[:8]}"


def with_count_below(df: DataFrame, key: Column, arr: Column, n: int, out: str,
                     inclusive: bool = False) -> DataFrame:
    """Elements of sorted array ``arr`` (length <= ``n``) below ``key`` (or up to it with ``inclusive``) as a branchless binary search: one small projection per
    power-of-two step (ceil(log2(n + 1)) of them), each adding the step to the
    running count when the element it lands on is still below ``key``.

    Generated code stays O(log n) for any n, with a single state column per
    step. Elements past the array's real size count as +infinity. The result
    leaves through a one-element ``explode`` so that predicates on it (e.g. the
    ``isnotnull`` inferred for a join key) are not rewritten through every step.
    """
    k, a, pos = tmp("k"), tmp("a"), tmp("p")
    x = df.select("*", key.alias(k), arr.alias(a), F.lit(0).alias(pos))
    step = 1 << max(0, n.bit_length() - 1)
    while step >= 1:
        cand = F.col(pos) + F.lit(step)
        e = F.try_element_at(F.col(a), cand)
        below = (e <= F.col(k)) if inclusive else (e < F.col(k))
        x = x.select(*[c for c in x.columns if c != pos],
                     F.when((cand <= F.lit(n)) & F.coalesce(below, F.lit(False)), cand).otherwise(F.col(pos)).alias(pos))
        step >>= 1
    res = F.when(F.col(k).isNull(), F.lit(None).cast("int")).otherwise(F.col(pos).cast("int"))
    return x.select("*", F.explode(F.array(res)).alias(out)).drop(k, a, pos)
