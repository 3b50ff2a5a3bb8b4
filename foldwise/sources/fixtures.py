"""Stand-in inputs built from the driver tables (FIXTURES.md, tasks T1-T4).

These only shape the given tables into the schemas the reference's jobs
read (a labelled table with ids, prediction tables, weight tables, log
lines). They do none of the jobs' work; every registered query then runs the
library's operators on them. Each builder has a DuckDB twin so the oracle
reads the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


# ------------------------------------------------------------------ T1
def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: orders joined to customers; ``id, y, part, price_txt, acctbal, nation, priority, segment``.

    ``part`` is train / test / extra by order date; text, null and
    uncastable values are injected by rule so coercion has work to do.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    k = F.col("o_orderkey")
    part = (F.when(F.col("o_orderdate") < _ts("2000-01-01 00:00:00"), F.lit("train"))
            .when(F.col("o_orderdate") < _ts("2001-01-01 00:00:00"), F.lit("test"))
            .otherwise(F.lit("extra")))
    price = (F.when(k % 19 == 0, F.lit("n/a"))
             .when(k % 17 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("o_totalprice").cast("string")))
    prio = F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(k.alias("id"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
                    part.alias("part"), price.alias("price_txt"),
                    F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"),
                    prio.alias("priority"), F.col("c_mktsegment").alias("segment")))


T1_SQL = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
       CASE WHEN o_orderdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'train'
            WHEN o_orderdate < TIMESTAMP '2001-01-01 00:00:00' THEN 'test' ELSE 'extra' END AS part,
       CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE CAST(o_totalprice AS VARCHAR) END AS price_txt,
       c_acctbal AS acctbal, c_nationkey AS nation,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey
"""

# Roles of T1 as a user would declare them.
T1_ID, T1_TARGET = "id", "y"
T1_FEATURES = ["price_txt", "acctbal", "nation", "priority", "segment"]


# ------------------------------------------------------------------ T2
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: documents left-joined to labels; labelled rows are train, the rest test."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(lab, "doc_id", "left")
            .select("doc_id", "lang", "source", "n_chars", "quality",
                    F.when(F.col("quality").isNull(), F.lit("test")).otherwise(F.lit("train")).alias("part")))


T2_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality,
       CASE WHEN l.quality IS NULL THEN 'test' ELSE 'train' END AS part
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


# ------------------------------------------------------------------ T3
def closed_form_scores(t1: DataFrame) -> DataFrame:
    """T3: three model scores, a fold column and an optional weight on T1."""
    i = F.col("id")
    return t1.select(
        "*",
        (d(1.0) / (d(1.0) + F.exp(-F.col("acctbal") / d(5000.0)))).alias("p1"),
        (d(0.2) + d(0.6) * ((i % 10).cast("double") / d(10.0))).alias("p2"),
        (d(0.1) + d(0.08) * (F.col("nation") % 10).cast("double")).alias("p3"),
        (i % 5).cast("int").alias("fold"),
        F.when(i % 101 == 0, F.lit(None).cast("double"))
         .otherwise(d(0.5) + (i % 7).cast("double") / d(7.0)).alias("weight"))


T3_SQL = f"""
SELECT *, 1.0/(1.0+exp(-acctbal/5000.0)) AS p1,
       0.2 + 0.6*((id % 10)::DOUBLE/10.0) AS p2,
       0.1 + 0.08*((nation % 10)::DOUBLE) AS p3,
       (id % 5)::INTEGER AS fold,
       CASE WHEN id % 101 = 0 THEN NULL ELSE 0.5 + (id % 7)::DOUBLE/7.0 END AS weight
FROM ({T1_SQL})
"""

MODELS = ["p1", "p2", "p3"]


def oof_table(t3: DataFrame, model: str) -> DataFrame:
    """An OOF table ``id, y, oof_pred`` (train rows) for one closed-form model."""
    return t3.where(F.col("part") == "train").select("id", "y", F.col(model).alias("oof_pred"))


def submission_table(t3: DataFrame, model: str) -> DataFrame:
    """A submission ``id, diagnosed_diabetes`` (test rows) for one closed-form model."""
    return t3.where(F.col("part") == "test").select("id", F.col(model).alias("diagnosed_diabetes"))


def weights_table(t3: DataFrame, complete: bool) -> DataFrame:
    """Row weights ``id, weight`` for train ids; with ``complete`` every id has one."""
    tr = t3.where(F.col("part") == "train")
    if complete:
        return tr.select("id", (d(0.5) + (F.col("id") % 7).cast("double") / d(7.0)).alias("weight"))
    return tr.where(F.col("weight").isNotNull()).select("id", "weight")


# ------------------------------------------------------------------ T4
def metric_log_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """T4: one training-log line per event (``value`` column, as ``spark.read.text``), after the columns ``keep``."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    i = F.col("event_id")
    seed = (F.lit(42) + F.pmod(F.floor(i / 5), F.lit(2))).cast("string")
    line = F.concat(
        F.lit("[seed="), seed, F.lit(" fold="), (i % 5).cast("string"), F.lit("] epoch="),
        (F.floor(i / 10) + 1).cast("string"),
        F.lit(" train_bce="), F.col("value").cast("string"),
        F.lit(", val_logloss="), (F.col("value") + d(0.5)).cast("string"), F.lit(" lr=0.001"))
    noise = F.concat(F.lit("noise "), i.cast("string"))
    return e.select(*keep, F.when(F.col("event_type") == "error", noise).otherwise(line).alias("value"))


T4_SQL = """
SELECT CASE WHEN event_type = 'error' THEN 'noise ' || CAST(event_id AS VARCHAR)
  ELSE '[seed=' || CAST(42 + (floor(event_id/5)::BIGINT % 2) AS VARCHAR) || ' fold=' || CAST(event_id % 5 AS VARCHAR)
    || '] epoch=' || CAST(floor(event_id/10)::BIGINT + 1 AS VARCHAR)
    || ' train_bce=' || CAST(value AS VARCHAR) || ', val_logloss=' || CAST(value + 0.5 AS VARCHAR)
    || ' lr=0.001' END AS value
FROM events
"""
