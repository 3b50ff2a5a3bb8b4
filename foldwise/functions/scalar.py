"""Column expressions for coercion, probabilities and losses.

Every function returns a ``Column`` built from Spark built-ins, so it runs
inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the reference:
#   missing category token = "__MISSING__", rare category token = "__OTHER__"
#   log-loss clip          = 1e-15
MISSING_TOKEN = "__MISSING__"
OTHER_TOKEN = "__OTHER__"
LOSS_EPS = 1e-15


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def d(v: float) -> Column:
    """A DOUBLE literal (plain decimals in Spark SQL text are DECIMAL)."""
    return F.lit(float(v)).cast("double")


def to_number(c) -> Column:
    """PRJ5: text or number -> double; uncastable -> null (ANSI-safe)."""
    return _c(c).try_cast("double")


def nonfinite_to_null(c) -> Column:
    """PRJ16: NaN, +inf, -inf -> null."""
    x = _c(c)
    bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(x)


def coerce_id(c) -> Column:
    """PRJ6: id -> bigint; exact integers kept above 2^53, text via double, null -> 0."""
    x = _c(c)
    as_text = x.cast("string")
    return F.coalesce(as_text.try_cast("bigint"),
                      as_text.try_cast("double").try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def binary_label(c) -> Column:
    """PRJ7: coerce, null -> 0, truncate to integer, then ``> 0`` -> 1.

    Truncation comes first (as an int64 cast does), so 0.5 becomes 0.
    """
    x = _c(c).cast("string")
    v = F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    return (v > 0).cast("int")


def label_threshold(c, cut: float = 0.5) -> Column:
    """PRJ7b: re-binarise a float target with ``y > cut``."""
    return (_c(c) > d(cut)).cast("int")


def clip(c, lo: float | None, hi: float | None) -> Column:
    """PRJ13: clamp into [lo, hi] (either bound may be None)."""
    x = _c(c)
    if hi is not None:
        x = F.least(x, d(hi))
    if lo is not None:
        x = F.greatest(x, d(lo))
    return x


def logit(p, eps: float = LOSS_EPS) -> Column:
    """SC1: ``ln p - ln(1-p)`` after clipping into [eps, 1-eps]."""
    q = clip(p, eps, 1 - eps)
    return F.log(q) - F.log1p(-q)


def sigmoid(z) -> Column:
    """SC2: two-branch stable logistic function."""
    x = _c(z)
    return F.when(x >= 0, d(1.0) / (d(1.0) + F.exp(-x))).otherwise(F.exp(x) / (d(1.0) + F.exp(x)))


def row_logloss(y, p, eps: float = LOSS_EPS) -> Column:
    """SC3: per-row binary cross-entropy with p clipped into [eps, 1-eps]."""
    q = clip(p, eps, 1 - eps)
    yy = _c(y).cast("double")
    return -(yy * F.log(q) + (d(1.0) - yy) * F.log1p(-q))


def odds_weight(p, p_eps: float = 1e-6, lo: float = 0.1, hi: float = 10.0) -> Column:
    """SC4: importance weight ``p/(1-p)`` of a test-vs-train probability, clipped."""
    q = clip(p, p_eps, 1 - p_eps)
    return clip(q / (d(1.0) - q), lo, hi)


def soft_target(y, t, alpha: float, clamp_alpha: bool = True) -> Column:
    """SC5: ``(1-a) y + a t``; a is clamped to [0, 1] in the GBDT variant."""
    a = min(max(alpha, 0.0), 1.0) if clamp_alpha else alpha
    return d(1.0 - a) * _c(y).cast("double") + d(a) * _c(t).cast("double")


def smooth_label(y, eps: float, clamp_eps: bool = True) -> Column:
    """SC6: ``(1-eps) y + eps/2``."""
    e = min(max(eps, 0.0), 1.0) if clamp_eps else eps
    return d(1.0 - e) * _c(y).cast("double") + d(e * 0.5)


def standardise(c, mean: Column, std: Column) -> Column:
    """SC11: ``(x - mean) / std``."""
    return (_c(c).cast("double") - mean) / std


def fill_missing_token(c) -> Column:
    """SC10: category as text, null -> ``__MISSING__``."""
    return F.coalesce(_c(c).cast("string"), F.lit(MISSING_TOKEN))


def cat_tokens(cols: list[str]) -> Column:
    """SC7: ``"col=value "`` for each categorical column, concatenated per row."""
    if not cols:
        return F.lit("")
    return F.concat(*[F.concat(F.lit(f"{c}="), fill_missing_token(c), F.lit(" ")) for c in cols])


def metric_direction(name) -> Column:
    """SC22: ``'max'`` for AUC-like metric names, ``'min'`` otherwise."""
    return F.when(F.lower(_c(name)).contains("auc"), F.lit("max")).otherwise(F.lit("min"))
