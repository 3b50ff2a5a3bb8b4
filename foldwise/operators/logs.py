"""Training-log metrics (SRC9, SC20-SC22, AG20, AG21, WN3, TK2, ST5).

Log lines are read with ``spark.read.text`` (whole directories at once) and
parsed with regular expressions and ``explode`` -- no Python per line. The
parsed table is long: ``seed, fold, epoch, metric, value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import metric_direction
from ..session import materialise, scratch_path
from .rank import two_level_row_number, value_buckets

#: Evaluations of one run that are folded at once, and buckets per run of their order.
BLOCK = 100_000
BUCKETS = 256

# Fixed value: the line prefix the reference's parser accepts.
PREFIX_RE = r"^\[seed=(\d+)\s+fold=(\d+)\]\s+epoch=(\d+)\s+(.*)$"
# Number syntax accepted by Python's float(): decimals with optional
# underscores between digits, exponents, inf/infinity/nan (any case).
FLOAT_RE = (r"^[+-]?((([0-9](_?[0-9])*)?\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\.?)([eE][+-]?[0-9](_?[0-9])*)?"
            r"|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])$")


def parse_metric_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SC20 + SC21: ``[seed=S fold=F] epoch=E k=v k=v ...`` -> one row per numeric token.

    Lines without the prefix are ignored; tokens without ``=`` or with an
    empty key are dropped; trailing commas of a value are stripped; values
    that are not numbers (in Python's float syntax) are dropped, ``nan`` and
    ``inf`` are kept.
    """
    line = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    x = lines.select(line.alias("__l")).where(F.col("__l").rlike(PREFIX_RE))
    x = x.select(*[F.regexp_extract("__l", PREFIX_RE, i).try_cast("bigint").alias(n)
                   for i, n in ((1, "seed"), (2, "fold"), (3, "epoch"))],
                 F.regexp_replace(F.regexp_extract("__l", PREFIX_RE, 4), r"^\s+|\s+$", "").alias("__rest"))
    x = x.select("seed", "fold", "epoch", F.explode(F.split("__rest", r"\s+")).alias("__tok"))
    x = x.where(F.col("__tok").contains("="))
    k = F.substring_index("__tok", "=", 1)
    v = F.regexp_replace(F.expr("substr(__tok, instr(__tok, '=') + 1)"), ",+$", "")
    x = x.select("seed", "fold", "epoch", k.alias("metric"), v.alias("__v")).where(F.col("metric") != "")
    x = x.where(F.col("__v").rlike(FLOAT_RE))
    return x.select("seed", "fold", "epoch", "metric",
                    F.regexp_replace("__v", "_", "").try_cast("double").alias("value"))


def series_count(df: DataFrame) -> DataFrame:
    """ST5 + AG23: distinct (seed, fold) series per metric."""
    return df.select("metric", "seed", "fold").dropDuplicates().groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_series"))


def best_metric(df: DataFrame) -> DataFrame:
    """AG21 + SC22: best value per metric (max for AUC-like names, else min) with its
    epoch, seed and fold; ties go to the first row in (seed, fold, epoch) order.
    One aggregation: ``min_by`` over a (signed value, seed, fold, epoch) key."""
    dirn = metric_direction(F.col("metric"))
    key = F.struct(F.when(dirn == "max", -F.col("value")).otherwise(F.col("value")).alias("v"),
                   "seed", "fold", "epoch")
    best = F.min_by(F.struct("value", "epoch", "seed", "fold"), key)
    g = df.groupBy("metric").agg(best.alias("__b"))
    return g.select("metric", metric_direction(F.col("metric")).alias("direction"),
                    F.col("__b.value").alias("best_value"), F.col("__b.epoch").alias("best_epoch"),
                    F.col("__b.seed").alias("best_seed"), F.col("__b.fold").alias("best_fold"))


def epoch_mean(df: DataFrame) -> DataFrame:
    """AG20: mean value per (metric, epoch) over all seeds and folds, NaN left out (all NaN: null)."""
    return df.groupBy("metric", "epoch").agg(F.avg(_number("value")).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def _number(c: str):
    return F.when(~F.isnan(c), F.col(c))


def epoch_mean_side_by_side(df: DataFrame, metrics: list[str]) -> DataFrame:
    """AG20 report: one row per epoch, one column per metric (e.g. train vs validation)."""
    return df.where(F.col("metric").isin(*metrics)).groupBy("epoch").pivot("metric", metrics).agg(F.avg(_number("value")))


def patience_pick(df: DataFrame, metric: str, patience: int, min_delta: float = 0.0,
                  direction: str = "min", block: int = BLOCK) -> DataFrame:
    """WN3: per (seed, fold), replay early stopping over the epochs of ``metric``.

    An evaluation improves when it beats the best so far by more than
    ``min_delta``; NaN never does; after ``patience`` evaluations without improvement the run
    stops. Returns ``seed, fold, best_epoch, best_value, stop_epoch, n_evals``.
    A series may be as long as the table: it is dealt into blocks of at most ``block``
    evaluations in (epoch, value) order, and one fold over a block's evaluations starts
    from the state (best, bad, stop) that the block before it ended with. A round folds the
    next block of every run that has not stopped, so rounds end with the last run's stop.
    """
    if block < 1:
        raise ValueError("block must be at least 1")
    s = df.where(F.col("metric") == metric).select(
        "seed", "fold", F.col("epoch").cast("bigint").alias("epoch"), F.col("value").cast("double").alias("value"))
    sign = 1.0 if direction == "min" else -1.0
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("be"),
                    F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"), F.lit(0).alias("n"))

    def step(acc, e):
        stopped = acc["stop"].isNotNull()
        v = e["value"] * F.lit(sign)
        better = ~F.isnan(v) & (acc["best"].isNull() | (v < acc["best"] - F.lit(min_delta)))
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        return F.when(stopped, acc).otherwise(F.struct(
            F.when(better, v).otherwise(acc["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(acc["be"]).alias("be"),
            bad.alias("bad"),
            F.when(bad >= patience, e["epoch"]).otherwise(F.lit(None).cast("bigint")).alias("stop"),
            (acc["n"] + 1).alias("n")))

    # one key without nulls for a run, as the joins below drop nulls
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seed", "fold")]
    s = s.withColumn("run", F.concat_ws("|", *text)).withColumn("at", F.coalesce("epoch", F.lit(-(1 << 63))))
    s = value_buckets(s, ["run"], "at", BUCKETS, out="bucket")
    s = two_level_row_number(s, ["run"], ["epoch", "value"], F.col("bucket"))
    s = s.select("run", "seed", "fold", "epoch", "value", F.floor((F.col("rn") - 1) / F.lit(block)).alias("block"))
    path = scratch_path(df.sparkSession, "evaluations")
    s.repartition("block", "run").write.partitionBy("block").parquet(path)
    rows = df.sparkSession.read.schema(s.schema).parquet(path)
    state = materialise(rows.groupBy("run").agg(F.first("seed").alias("seed"), F.first("fold").alias("fold"),
                                                F.max("epoch").alias("last"), F.count(F.lit(1)).alias("total"))
                        .withColumn("r", init), "patience")
    k = 0
    while state.where("r.stop is null and r.n < total").limit(1).count():
        part = (rows.where(F.col("block") == k).join(state.where("r.stop is null").select("run"), "run")
                .groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "value"))).alias("h")))  # at most ``block``
        state = materialise(state.join(part, "run", "left").select(
            "run", "seed", "fold", "last", "total",
            F.when(F.col("h").isNull(), F.col("r")).otherwise(F.aggregate("h", F.col("r"), step)).alias("r")), "patience")
        k += 1
    # A run that never ran out of patience stops at its last evaluation.
    return state.select("seed", "fold", F.col("r.be").alias("best_epoch"),
                        (F.col("r.best") * F.lit(sign)).alias("best_value"),
                        F.coalesce("r.stop", "last").alias("stop_epoch"),
                        F.col("r.n").alias("n_evals"))
