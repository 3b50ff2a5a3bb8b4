"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession`` from the caller; this
module only offers a sensible default for scripts, tests and the bench, and
the one place that decides where lineage-cutting tables go.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on: AQE re-plans joins/partition counts at run
# time (and only broadcasts a side whose *measured* size is small), skew-join
# splitting handles a hot key, UTC keeps timestamp literals stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Constraint propagation re-derives alias equalities through every
    # projection; on the library's stepwise plans (hash limbs, binary-search
    # steps) that planning cost dominates small jobs. Join keys here are
    # non-null by construction, so the inferred filters it adds are not needed.
    "spark.sql.constraintPropagation.enabled": "false",
}

# Only used when this module starts the JVM (scripts, tests, bench); a
# cluster session keeps whatever its launcher configured.
LOCAL_DRIVER_MEMORY = "12g"


def get_spark(master: str | None = None, app: str = "foldwise",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = LOCAL_DRIVER_MEMORY
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names shared storage and is always read from the
    session. Only when it is unset on a local master (a test run) is a private
    folder made and recorded in the session, so later calls agree; on a cluster a
    missing setting is an error, as machines would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc_dir = spark.sparkContext.getCheckpointDir()
        path = sc_dir
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="foldwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder, for written intermediate tables."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._foldwise_path = path  # for `discard`
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._foldwise_path
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._foldwise_path = None
