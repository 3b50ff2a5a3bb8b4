"""Column roles and type split (PRJ1-PRJ3, PRJ14, PRJ15, AG6).

Role inference reads only ``df.columns`` / ``df.schema`` on the driver; the
one data-dependent rule (low-cardinality integers, PRJ3c) is one pass of sketches over
all candidate columns at once, and an exact count of those near the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default target name and the name set of the looser rule.
DEFAULT_TARGET = "diagnosed_diabetes"
TARGET_NAMES = ("diagnosed_diabetes", "target", "label", "y")


@dataclass(frozen=True)
class Roles:
    id_col: str
    target_col: str | None
    features: list[str]
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def infer_roles(df: DataFrame, id_col: str | None = None, target_col: str | None = None,
                require_target: bool = True) -> Roles:
    """PRJ1: id = given, else ``id``, else first column; target = given, else ``diagnosed_diabetes``."""
    cols = df.columns
    idc = id_col or ("id" if "id" in cols else cols[0])
    tgt = target_col or (DEFAULT_TARGET if DEFAULT_TARGET in cols else None)
    if require_target and (tgt is None or tgt not in cols):
        raise ValueError("Could not infer target column; pass target_col")
    feats = [c for c in cols if c not in (idc, tgt)]
    return Roles(idc, tgt, feats)


def infer_roles_by_name(df: DataFrame) -> Roles:
    """PRJ2: target = first column whose lower-cased name is in :data:`TARGET_NAMES`."""
    cand = [c for c in df.columns if c.lower() in TARGET_NAMES]
    if not cand:
        raise ValueError("Could not infer target column; expected one of " + "/".join(TARGET_NAMES))
    ids = [c for c in df.columns if c.lower() == "id"]
    if not ids:
        # Rows have no order, so positional ids would not be reproducible.
        raise ValueError("No id column: add one before encoding")
    feats = [c for c in df.columns if c not in (cand[0], ids[0])]
    return Roles(ids[0], cand[0], feats)


def _is_numeric(dt: T.DataType, bool_numeric: bool) -> bool:
    if isinstance(dt, T.BooleanType):
        return bool_numeric
    return isinstance(dt, T.NumericType)


def split_types(df: DataFrame, features: list[str], bool_numeric: bool = True) -> tuple[list[str], list[str]]:
    """PRJ3a/3b: numeric type -> numeric, else categorical (bool by flag)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    num = [c for c in features if _is_numeric(types[c], bool_numeric)]
    return num, [c for c in features if c not in num]


#: Relative error of the sketched distinct counts, and how many times it a count may be off before it is taken exactly.
SKETCH_ERROR = 0.02
MARGIN = 5


def distinct_with_null(c: str):
    """AG6: ``nunique(dropna=False)`` as one aggregate expression."""
    return (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).cast("bigint")


def distinct_counts(df: DataFrame, cols: list[str], exact_up_to: int) -> dict[str, int]:
    """AG6 of many columns: distinct values of each, null counted, exact up to ``exact_up_to``.

    One pass of mergeable sketches serves all columns (exact counts of several columns would copy every
    row once a column). Only columns whose sketch may still mean ``exact_up_to`` or less are
    counted exactly, each by an aggregation of its own; the others have more and report the estimate.
    """
    if not cols:
        return {}
    row = df.agg(*[(F.approx_count_distinct(F.col(c), SKETCH_ERROR) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        about = int(row[c] or 0)
        near = about <= exact_up_to * (1 + MARGIN * SKETCH_ERROR) + 1
        out[c] = int(df.agg(distinct_with_null(c).alias("n")).first()["n"] or 0) if near else about
    return out


def low_card_profile(train: DataFrame, test: DataFrame, features: list[str], exact_up_to: int = 64) -> DataFrame:
    """Per feature: type class, distinct count on train (nulls counted, exact up to ``exact_up_to``).

    String columns need no data. Returns ``feature, kind, n_unique`` (kind in int/float/string).
    """
    types = dict((f.name, f.dataType) for f in train.schema.fields)
    ttypes = dict((f.name, f.dataType) for f in test.schema.fields)
    spark = train.sparkSession

    def kind(c: str) -> str:
        if isinstance(types[c], T.StringType) or isinstance(ttypes.get(c), T.StringType):
            return "string"
        if isinstance(types[c], (T.IntegralType, T.BooleanType)):
            return "int"
        return "float" if isinstance(types[c], T.NumericType) else "string"

    counts = distinct_counts(train, [c for c in features if kind(c) == "int"], exact_up_to)
    rows = [(c, kind(c), counts.get(c)) for c in features]
    return spark.createDataFrame(rows, "feature string, kind string, n_unique bigint")


def role_at(threshold: int):
    """PRJ3c: string -> cat; int/bool with ``n_unique <= threshold`` -> cat; else num."""
    return (F.when(F.col("kind") == "string", F.lit("cat"))
            .when((F.col("kind") == "int") & (F.col("n_unique") <= threshold), F.lit("cat"))
            .otherwise(F.lit("num")))


def split_low_card(train: DataFrame, test: DataFrame, features: list[str],
                   threshold: int = 16) -> tuple[list[str], list[str]]:
    prof = low_card_profile(train, test, features, threshold).withColumn("role", role_at(threshold)).collect()
    role = {r["feature"]: r["role"] for r in prof}
    return [c for c in features if role[c] == "num"], [c for c in features if role[c] == "cat"]


def require_columns(df: DataFrame, cols, exact: bool = False, what: str = "input") -> None:
    """PRJ14: exact column set, or subset, with a clear error."""
    have, need = set(df.columns), set(cols)
    if exact and have != need:
        raise ValueError(f"Bad columns in {what}: {sorted(have)} (need {sorted(need)})")
    if not exact and not need <= have:
        raise ValueError(f"{what} is missing columns {sorted(need - have)}")


def require_no_missing(df: DataFrame, col: str, what: str) -> DataFrame:
    """PRJ15 inside the plan: fail the job when ``col`` is null, else pass rows through.

    ``raise_error`` keeps the check lazy and distributed (no extra count job);
    the message names the first offending id seen by the failing task.
    """
    bad = F.raise_error(F.concat(F.lit(f"{what} missing for id "), F.col("__chk_id").cast("string")))
    return (df.withColumn("__chk_id", F.col(df.columns[0]))
              .withColumn(col, F.when(F.col(col).isNull(), bad.cast(df.schema[col].dataType))
                          .otherwise(F.col(col)))
              .drop("__chk_id"))
