"""Structured Streaming versions of the reference's chunked passes (SM1-SM6).

The reference reads a CSV in chunks and keeps running statistics in memory.
Here the same statistics are streaming aggregations over a file source
(``maxBytesPerTrigger`` bounds each micro-batch; ``availableNow`` drains what
is there and stops), with state and progress in a checkpoint under the shared
folder so a restarted query resumes instead of recounting.

Results of complete-mode aggregations are written by ``foreachBatch`` as the
whole current answer (overwrite per epoch, idempotent on replay) to a table
under the shared folder, which the caller reads back as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import d, row_logloss, sigmoid
from ..session import scratch_path


#: Bytes of files in a micro-batch (at least one file): small files share a batch, large ones do not pile up.
BATCH_BYTES = 1 << 30


def file_stream(spark: SparkSession, path: str, schema: StructType, bytes_per_trigger: int = BATCH_BYTES,
                fmt: str = "parquet") -> DataFrame:
    """SRC2 as a stream: a file source with an explicit schema and micro-batches bounded by bytes."""
    r = spark.readStream.schema(schema).format(fmt).option("maxBytesPerTrigger", bytes_per_trigger)
    return (r.option("header", True) if fmt == "csv" else r).load(path)


def run_to_table(agg: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain a streaming aggregation (``availableNow``) and return its final answer.

    Each micro-batch's complete result overwrites one Parquet table in the
    shared folder; the checkpoint next to it holds offsets and state.
    """
    spark = agg.sparkSession
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/table", f"{base}/checkpoint"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (agg.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """SM5 sink: append a row-wise stream to Parquet files (exactly-once with the
    checkpoint) and return the written table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/table", f"{base}/checkpoint"
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_scaler(stream: DataFrame, cols: list[str], fill_zero: bool = True) -> DataFrame:
    """SM1: running count, mean and population std per numeric column (nulls -> 0 first
    when ``fill_zero``, as the reference's scaler pass)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.coalesce(F.col(c).try_cast("double"), d(0.0)) if fill_zero else F.col(c).try_cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
    return stream.groupBy().agg(*aggs)


def stream_class_counts(stream: DataFrame, label: Callable[[], object] | str, side: str | None = None) -> DataFrame:
    """SM2: running row count per class and, with ``side``, per hold-out side."""
    y = F.col(label) if isinstance(label, str) else label
    return stream.groupBy(*([side] if side else []), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


def stream_logloss(stream: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """SM4: accumulated log-loss over the stream: running sum of losses and count."""
    return stream.groupBy().agg(F.sum(row_logloss(F.col(y), F.col(p), eps)).alias("loss_sum"),
                                F.count(F.lit(1)).alias("n"))


def stream_sgd_logistic(spark: SparkSession, source: Callable[[], DataFrame], features: list[str],
                        label: str, passes: int = 2, lr: float = 0.5, l2: float = 1e-4,
                        weight: str | None = None, name: str = "sgd") -> tuple[list[float], float]:
    """SM3 + SM6: logistic regression fitted by mini-batch gradient steps, one step per
    micro-batch, over ``passes`` replays of the stream (a fresh checkpoint per pass).

    Each step's gradient is one distributed aggregation over that micro-batch
    (sums of ``(p - y) x`` and counts); only the k+1 coefficients live on the
    driver. ``weight`` gives per-row sample weights (e.g. balanced classes).
    """
    k = len(features)
    coef = [0.0] * k
    state = {"w": coef, "b": 0.0}

    def step(batch: DataFrame, epoch: int) -> None:
        w, b = state["w"], state["b"]
        z = sum((d(wi) * F.col(f).cast("double") for wi, f in zip(w, features)), d(b))
        sw = F.col(weight).cast("double") if weight else d(1.0)
        err = (sigmoid(z) - F.col(label).cast("double")) * sw
        r = batch.agg(F.sum(sw).alias("n"), F.sum(err).alias("gb"),
                      *[F.sum(err * F.col(f).cast("double")).alias(f"g{i}") for i, f in enumerate(features)]).first()
        n = r["n"] or 0.0
        if n <= 0:
            return
        state["w"] = [wi - lr * (r[f"g{i}"] / n + l2 * wi) for i, wi in enumerate(w)]
        state["b"] = b - lr * (r["gb"] / n)

    for p in range(passes):
        base = scratch_path(spark, f"{name}-pass{p}")
        q = (source().writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return state["w"], state["b"]


def stream_passes(source: Callable[[], DataFrame], step: Callable[[DataFrame], object], passes: int = 1, name: str = "passes") -> int:
    """SM3 + SM6: hand every micro-batch of ``passes`` replays of a stream to ``step`` (as :meth:`AveragedSgd.step`).

    Every replay has a checkpoint of its own, so it reads the whole source again. Returns the micro-batches.
    """
    batches = 0

    def one(batch: DataFrame, epoch: int) -> None:
        nonlocal batches
        step(batch)
        batches += 1

    for p in range(passes):
        stream = source()
        base = scratch_path(stream.sparkSession, f"{name}-pass{p}")
        q = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return batches


def score_linear(df: DataFrame, features: list[str], coef: list[float], intercept: float,
                 out: str = "p") -> DataFrame:
    """SM5 transform: probability of a fitted linear model as a column expression
    (works on batch and streaming frames alike)."""
    z = sum((d(wi) * F.col(f).cast("double") for wi, f in zip(coef, features)), d(intercept))
    return df.withColumn(out, sigmoid(z))
