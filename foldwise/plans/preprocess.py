"""Fitted preprocessor: roles + numeric statistics + category vocabulary
(SNK7 / SRC10; the reserved-slot encoder C4 with policy N3).

Fitting is two aggregations (column statistics over training rows, value
counts over train + test); the result is a few small tables. Saving writes
them as Parquet plus a one-line JSON of roles, loading reads them back, and
``transform`` applies them with broadcast lookups.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import binary_label, coerce_id
from ..operators import encode as E
from ..operators import roles as R


@dataclass
class Preprocessor:
    roles: R.Roles
    stats: dict[str, tuple[float, float]]
    vocab: DataFrame            # feature, value, n, code
    max_categories: int

    def transform(self, df: DataFrame) -> DataFrame:
        """ids coerced, label binarised (when present), numerics N3, categories -> codes."""
        r = self.roles
        cols = [coerce_id(r.id_col).alias(r.id_col)]
        if r.target_col and r.target_col in df.columns:
            cols.append(binary_label(r.target_col).alias(r.target_col))
        cols += [E.numeric_policy(c, self.stats[c], "impute_mean").alias(c) for c in r.numeric]
        cols += [F.col(c) for c in r.categorical]
        x = df.select(*cols)
        x = E.lookup_codes(x, self.vocab, r.categorical, 1, self.max_categories)
        return x.drop(*r.categorical)

    def save(self, path: str) -> None:
        spark = self.vocab.sparkSession
        meta = {"id_col": self.roles.id_col, "target_col": self.roles.target_col,
                "feature_cols": self.roles.features, "num_cols": self.roles.numeric,
                "cat_cols": self.roles.categorical, "max_categories": self.max_categories}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")
        spark.createDataFrame([(c, m, s) for c, (m, s) in self.stats.items()],
                              "feature string, mean double, std double").write.mode("overwrite").parquet(f"{path}/stats")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def fit_preprocessor(train: DataFrame, test: DataFrame, id_col: str | None = None,
                     target_col: str | None = None, max_categories: int = 2000) -> Preprocessor:
    """Roles (PRJ1, bool -> categorical as PRJ3b), train-only statistics (AG4),
    train + test vocabulary with reserved slots (C4)."""
    r = R.infer_roles(train, id_col, target_col)
    num, cat = R.split_types(train, r.features, bool_numeric=False)
    roles = R.Roles(r.id_col, r.target_col, r.features, num, cat)
    stats = E.fit_numeric_stats(train, num, "nan")
    vocab = E.vocab_freq(E.value_counts([train, test], cat), max_categories) if cat else \
        train.sparkSession.createDataFrame([], "feature string, value string, n long, code int")
    return Preprocessor(roles, stats, vocab, max_categories)


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    """SRC10: read a saved preprocessor back."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    stats = {r.feature: (r.mean, r.std) for r in spark.read.parquet(f"{path}/stats").collect()}
    vocab = spark.read.parquet(f"{path}/vocab")
    roles = R.Roles(meta["id_col"], meta["target_col"], meta["feature_cols"], meta["num_cols"], meta["cat_cols"])
    return Preprocessor(roles, stats, vocab, meta["max_categories"])
