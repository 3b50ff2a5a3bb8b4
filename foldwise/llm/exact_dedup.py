"""Exact dedup by skew-safe combining (DataFrame functions only).

Stages, each of which compares full contents (the normalised text is a grouping
key of every combining step; a digest only spreads the work):

1. *local*: map-side aggregation deduplicates inside every input partition;
2. *salted*: survivors merge per (digest, salt of the id, content), so a group
   holding a third of all rows is spread over ``salts`` tasks;
3. *global*: at most ``salts`` winners per content combine into the group.

Each row then finds its group through its own (digest, salt), a join whose hot
key is spread over the same salts. Should two different contents ever share
SHA-256 and a second 64-bit hash, the job fails instead of merging them.

Defined results: a null text counts as empty and equals it; rows with a null id
join their group but never win while the group has an id (a group of null ids
only keeps them all as ``keep_id`` null, ``kept`` true on each); repeated ids are
separate rows of their group, each with ``kept`` true if the id wins; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents_like, unused, written

SALTS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of each group of equal texts (after lower-casing A-Z) stays.
    """
    norm = documents_like(docs, id_col, text_col).select(
        "doc_id", F.coalesce(ascii_lower(F.col("text")), F.lit("")).alias("content"))
    keyed = norm.select("doc_id", "content", F.sha2("content", 256).alias("digest"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    local = (keyed.groupBy("digest", "salt", "content")
             .agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")))
    # a group has at most `salts` rows here, so its list of salts is bounded
    merged = (local.groupBy("digest", "content")
              .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"),
                   F.collect_list("salt").alias("in_salts"))
              .select("digest", F.xxhash64("content").alias("check"), "keep_id", "group_size",
                      F.explode("in_salts").alias("salt")))
    groups = (written(merged, "exact-groups").groupBy("digest", "salt", "check")
              .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                   F.count(F.lit(1)).alias("contents"))
              .withColumn("group_size", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(
                  F.raise_error(F.concat(F.lit("different texts share the digest "), F.col("digest"))).cast("long"))))
    rows = keyed.select("doc_id", "digest", "salt", F.xxhash64("content").alias("check"))
    return (rows.join(groups, ["digest", "salt", "check"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops (all columns, one row per kept text).

    Of repeated rows with the winning id and an equal text all stay; they are one document.
    """
    gone_id, gone_text = unused(docs, "_gone", "_gone_text")
    gone = exact_groups(docs, id_col, text_col).where("not kept and doc_id is not null").select(
        F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_text)).distinct()
    digest = F.sha2(F.coalesce(ascii_lower(docs[text_col]), F.lit("")), 256)
    return docs.join(gone, (docs[id_col] == gone[gone_id]) & (digest == gone[gone_text]), "left_anti")
