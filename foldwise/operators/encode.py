"""Feature encoders: numeric policies N1-N6, category vocabularies C1-C6.

Fit/transform split in the Spark ML sense: fitting is an aggregation whose
result is small (per-column statistics, a vocabulary of at most
``max_categories`` rows per column); transforming is a projection or a
broadcast lookup of that small result.

Leakage rules kept from the reference: numeric statistics see training rows
only; vocabularies may see train + test (+ extra) rows; the median/mode
imputer is fitted per fold on that fold's training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (MISSING_TOKEN, OTHER_TOKEN, d, fill_missing_token,
                                nonfinite_to_null, to_number)
from ..session import materialise
from .common import bounded_broadcast, local_copy, tmp
from .rank import LOCAL_COPY_ROWS, exact_quantiles, range_prefix_sums

STD_FLOOR = 1e-6  # std below this -> 1 (fixed value of the reference)


# ------------------------------------------------------------ numeric stats
def fit_numeric_stats(train: DataFrame, cols: list[str], policy: str = "nan") -> dict[str, tuple[float, float]]:
    """AG3/AG4: per-column (mean, population std) from training rows, one pass.

    ``policy``:
      * ``"zero"`` (AG3, N1): nulls/uncastable -> 0 first; zero variance -> std 1.
      * ``"nan"`` (AG4, N3): NaN/inf/null ignored; std < 1e-6 -> 1; all-null -> (0, 1).
      * ``"nan_keep_inf"`` (N4/N5): NaN/null ignored but infinities enter the mean.
    The result is 2 numbers per column, held on the driver like any fitted model.
    """
    aggs = []
    for c in cols:
        x = to_number(c)
        if policy == "zero":
            v = F.coalesce(x, d(0.0))
        elif policy == "nan":
            v = nonfinite_to_null(x)
        elif policy == "nan_keep_inf":
            v = F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)
        else:
            raise ValueError(policy)
        aggs += [F.avg(v).alias(f"{c}__m"), F.stddev_pop(v).alias(f"{c}__s")]
    if not aggs:
        return {}
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        if policy == "zero":
            m = 0.0 if m is None else m
            s = 1.0 if (s is None or s == 0.0) else s
        elif policy == "nan":
            m = 0.0 if m is None else m
            s = 1.0 if (s is None or s < STD_FLOOR) else s
        else:
            m = float("nan") if m is None else m
            s = 1.0 if (s is not None and s < STD_FLOOR) else (float("nan") if s is None else s)
        out[c] = (float(m), float(s))
    return out


def numeric_policy(c: str, stats: tuple[float, float], policy: str) -> Column:
    """Transform one numeric column with fitted (mean, std).

    * N1 ``zero``: ``(coalesce(x, 0) - m) / s``
    * N3 ``impute_mean``: non-finite -> null -> m, then standardise
    * N4 ``std_then_zero``: standardise, then NaN/inf/null -> 0
    * N5 ``std_then_zero_raw``: as N4 on an already numeric column (no text coercion)
    """
    m, s = d(stats[0]), d(stats[1])
    if policy == "zero":
        return (F.coalesce(to_number(c), d(0.0)) - m) / s
    if policy == "impute_mean":
        x = F.coalesce(nonfinite_to_null(to_number(c)), m)
        return F.coalesce(nonfinite_to_null((x - m) / s), d(0.0))
    if policy == "std_then_zero":
        return F.coalesce(nonfinite_to_null((to_number(c) - m) / s), d(0.0))
    if policy == "std_then_zero_raw":
        return F.coalesce(nonfinite_to_null((F.col(c).cast("double") - m) / s), d(0.0))
    raise ValueError(policy)


def keep_null_with_indicator(df: DataFrame, c: str, fill: float = 0.0) -> DataFrame:
    """N2 for Spark trees (which reject NaN): impute and add a ``<c>_isnull`` flag."""
    x = nonfinite_to_null(to_number(c))
    return df.withColumn(f"{c}_isnull", x.isNull().cast("double")).withColumn(c, F.coalesce(x, d(fill)))


# ------------------------------------------------------------ vocabularies
def _as_category(c: str) -> Column:
    return fill_missing_token(c)


def unpivot_categories(frames: list[DataFrame], cols: list[str], id_col: str | None = None) -> DataFrame:
    """ST3 + long form: ``(feature, value)`` over the union of frames (missing -> token)."""
    parts = []
    for f in frames:
        present = [c for c in cols if c in f.columns]
        if not present:
            continue
        keep = [id_col] if id_col else []
        x = f.select(*keep, *[_as_category(c).alias(c) for c in present])
        parts.append(x.unpivot(keep, present, "feature", "value") if keep else
                     x.unpivot([], present, "feature", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts(frames: list[DataFrame], cols: list[str]) -> DataFrame:
    """AG5: ``feature, value, n`` over train U test [U extra]; missing is a value."""
    return (unpivot_categories(frames, cols).groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    spread: Column, buckets: int = 256, out: str = "rank") -> DataFrame:
    """TK1: the first ``k`` rows per group under ``order`` (exact), without one task per group.

    Rows are first ranked inside (group, hash bucket) and cut to ``k``; the
    global top-k is a subset of the local top-ks, so the final window sees at
    most ``buckets * k`` rows per group. ``order`` must be a total order.
    """
    b = tmp("b")
    x = df.withColumn(b, F.pmod(F.xxhash64(spread), F.lit(buckets)))
    x = x.withColumn(out, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)))
    x = x.where(F.col(out) <= k).drop(b)
    return x.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def _freq_order():
    return [F.col("n").desc(), F.col("value").asc()]


def vocab_alpha(counts: DataFrame, max_categories: int = 2000) -> DataFrame:
    """C2 vocabulary (top-K + OTHER, alphabetic codes): ``feature, value, n, code``.

    Kept values are the ``max_categories`` most frequent (ties: smaller value);
    when a feature has more, ``__OTHER__`` joins the list. Codes are ranks by
    value. At most max_categories + 1 rows per feature.
    """
    every = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("__nd"), F.sum("n").alias("__all"))
    top = top_k_per_group(counts, ["feature"], _freq_order(), max_categories, F.col("value")).drop("rank")
    kept = top.groupBy("feature").agg(F.sum("n").alias("__kept"))
    # all values less the kept ones; both sides have one row per feature
    other = (every.where(F.col("__nd") > max_categories).join(kept, "feature")
             .select("feature", F.lit(OTHER_TOKEN).alias("value"), (F.col("__all") - F.col("__kept")).alias("n")))
    vocab = top.select("feature", "value", "n").unionByName(other)
    # A real value spelled "__OTHER__" merges with the bucket, as it would in the reference.
    vocab = vocab.groupBy("feature", "value").agg(F.sum("n").cast("bigint").alias("n"))
    w = Window.partitionBy("feature").orderBy("value")
    return vocab.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def vocab_freq(counts: DataFrame, max_categories: int = 2000) -> DataFrame:
    """C4 vocabulary with reserved slots: 0 = ``__MISSING__``, 1 = ``__OTHER__``,
    then the ``max_categories - 2`` most frequent values (ties: smaller value), skipping
    the two tokens. ``feature, value, n, code``; ``n`` is null for unused tokens.
    """
    if max_categories < 4:
        raise ValueError("max_categories must be >= 4")
    k = max_categories - 2
    top = top_k_per_group(counts, ["feature"], _freq_order(), k, F.col("value"), out="__r")
    real = top.where(~F.col("value").isin(MISSING_TOKEN, OTHER_TOKEN))
    real = real.withColumn("code", (F.row_number().over(Window.partitionBy("feature").orderBy("__r")) + 1).cast("int"))
    feats = counts.select("feature").distinct()
    special = feats.select("feature", F.expr(
        f"stack(2, '{MISSING_TOKEN}', 0, '{OTHER_TOKEN}', 1) as (value, code)"))
    special = (special.join(counts, ["feature", "value"], "left")
               .select("feature", "value", F.col("n").cast("bigint").alias("n"), F.col("code").cast("int")))
    return real.select("feature", "value", F.col("n").cast("bigint"), "code").unionByName(special)


def vocab_first_seen(frames: list[DataFrame], cols: list[str], id_col: str) -> DataFrame:
    """C5 vocabulary: codes from 1 by first appearance (smallest id), 0 = unknown.

    Rows have no order in Spark, so "first" is the smallest id holding the
    value: codes match the reference's up to renaming. Distinct values are not
    bounded, so codes are prefix counts over range partitions, not a per-feature window.
    """
    long = unpivot_categories(frames, cols, id_col)
    first = long.groupBy("feature", "value").agg(F.min(id_col).alias("__first"))
    x = first.select("feature", "value", F.struct("__first", "value").alias("__at"), F.lit(1).cast("bigint").alias("one"))
    x = range_prefix_sums(x, ["feature"], "__at", ["one"])
    return x.select("feature", "value", (F.col("one_before") + 1).cast("int").alias("code"))


def lookup_codes(df: DataFrame, vocab: DataFrame, cols: list[str], default: int | dict[str, int],
                 max_categories: int | None = None, suffix: str = "_code") -> DataFrame:
    """JN6: value -> code for each categorical column; unseen -> ``default``.

    One broadcast hash join per column when the vocabulary is bounded by
    ``max_categories`` (map-side, no shuffle of ``df``); otherwise a regular
    join that AQE may still turn into a broadcast from measured sizes.
    """
    out = df
    # the vocabulary is fitted once, not once a column
    rows = None if max_categories is None else len(cols) * (max_categories + 2)
    vocab = vocab.select("feature", "value", "code")
    vocab = local_copy(vocab) if rows is not None and rows <= LOCAL_COPY_ROWS else materialise(vocab, "vocabulary")
    for c in cols:
        v = vocab.where(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        bound = None if max_categories is None else max_categories + 2
        out = out.withColumn(f"__k_{c}", _as_category(c))
        out = out.join(bounded_broadcast(v, bound), out[f"__k_{c}"] == v[f"__v_{c}"], "left").drop(f"__v_{c}", f"__k_{c}")
        dflt = default[c] if isinstance(default, dict) else default
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(dflt)).cast("int"))
    return out


def other_code(vocab: DataFrame) -> dict[str, int]:
    """Code of ``__OTHER__`` per feature in a C2 vocabulary (small driver read)."""
    rows = vocab.where(F.col("value") == OTHER_TOKEN).select("feature", "code").collect()
    return {r["feature"]: int(r["code"]) for r in rows}


# ------------------------------------------------------------ per-fold impute
def _fold_targets(df: DataFrame, fold: str, n_folds: int) -> Column:
    """Folds whose training side contains this row: every fold except its own."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col(fold))


def fold_medians(df: DataFrame, cols: list[str], fold: str, n_folds: int) -> DataFrame:
    """AG11/N6: exact median of each numeric column over each fold's training rows.

    Distinct (feature, value, own fold) counts are taken first (ties and hot
    values collapse map-side); each distinct row is then credited to the
    K-1 folds it trains, and exact quantiles run per (feature, fold).
    Returns ``fold, feature, median``.
    """
    long = df.select(fold, *[to_number(c).alias(c) for c in cols]).unpivot([fold], cols, "feature", "x")
    long = long.select(fold, "feature", nonfinite_to_null(F.col("x")).alias("x")).where(F.col("x").isNotNull())
    cnt = long.groupBy("feature", "x", fold).agg(F.count(F.lit(1)).alias("c"))
    cnt = (cnt.select("feature", "x", "c", F.explode(_fold_targets(cnt, fold, n_folds)).alias("tfold"))
           .groupBy("feature", "tfold", "x").agg(F.sum("c").alias("c")))
    q = exact_quantiles(cnt, ["feature", "tfold"], "x", "c", [0.5], max_groups=len(cols) * n_folds)
    return q.select(F.col("tfold").cast("int").alias(fold), "feature", F.col("q_value").alias("median"))


def fold_modes(df: DataFrame, cols: list[str], fold: str, n_folds: int) -> DataFrame:
    """AG12: most frequent non-missing value per column over each fold's training rows
    (ties -> smallest value). Returns ``fold, feature, mode``."""
    long = df.select(fold, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([fold], cols, "feature", "v")
    cnt = long.where(F.col("v").isNotNull()).groupBy("feature", "v", fold).agg(F.count(F.lit(1)).alias("c"))
    cnt = (cnt.select("feature", "v", "c", F.explode(_fold_targets(cnt, fold, n_folds)).alias("tfold"))
           .groupBy("feature", "tfold", "v").agg(F.sum("c").alias("c")))
    best = cnt.groupBy("feature", "tfold").agg(F.min_by("v", F.struct((-F.col("c")).alias("nc"), F.col("v").alias("v"))).alias("mode"))
    return best.select(F.col("tfold").cast("int").alias(fold), "feature", "mode")


def fold_ordinal_vocab(df: DataFrame, cols: list[str], fold: str, n_folds: int) -> DataFrame:
    """C6: per fold, alphabetic ordinal codes of the fold-train values after mode
    imputation; values unseen in the fold's training rows map to -1 at lookup.
    Returns ``fold, feature, value, code``.

    Codes are ranks in string order inside each (fold, feature), prefix counts over range
    partitions, so a high-cardinality column is not ranked in a single task."""
    long = df.select(fold, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([fold], cols, "feature", "v")
    modes = fold_modes(df, cols, fold, n_folds)
    seen = long.where(F.col("v").isNotNull()).select("feature", "v", fold).distinct()
    seen = seen.select("feature", "v", F.explode(_fold_targets(seen, fold, n_folds)).alias("tfold")).distinct()
    seen = seen.select(F.col("tfold").cast("int").alias(fold), "feature", F.col("v").alias("value"))
    vocab = seen.unionByName(modes.select(fold, "feature", F.col("mode").alias("value"))).distinct()
    x = range_prefix_sums(vocab.withColumn("one", F.lit(1).cast("bigint")), [fold, "feature"], "value", ["one"])
    return x.select(fold, "feature", "value", F.col("one_before").cast("int").alias("code"))
