"""MinHash near-dedup with tensored banding.

Two collections of ``HALVES`` half-keys, each of ``ROWS`` minhashes, are computed
per set; every pair of half-keys, one from either collection, is a table key. That
makes HALVES^2 tables of 2 ROWS minhashes from only 2 HALVES ROWS minhashes. Two
sets meet in some table exactly if they agree in a half-key of both collections:
at similarity 0.75 this fails with probability 2 (1 - 0.75^3)^18, about 1e-4, at
0.8 with 5e-6. A half-key that only one set has cannot lead to a meeting, so such
half-keys are removed before the pairs are formed.

A first pass pairs every item with the smallest one of each of its first half-keys: one
row an item and key, which joins most of a large group of near copies into one
component. Tables then only hold half-keys that different components share, so
such a group does not stand in hundreds of tables.

Equal sets are one item. Candidates are verified on full shingle sets and closed
to components (:mod:`foldwise.llm.simjoin`).

Defined results: null and empty texts, and texts without words, have no shingles
and are linked with nothing (component: the id itself); rows with a null id are linked
with nothing (component null, kept); every row is judged by its own text, so rows
that repeat an id with equal texts have equal results and different texts of one
id may have different components; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHash, as_bytes, bitmap_of, documents_like, id_bit, in_bitmap, list_array,
                     map_batches, minhashes, mix64, scratch, shingle_hashes, signed, unused, words, worker_state, written)
from .simjoin import SKETCH, first_components, linked_components, sketch_words

ROWS = 3
HALVES = 18
N_MINHASHES = 2 * ROWS * HALVES
#: Meeting in large buckets of at most 4 tables (2 x 2 half-keys, say) and nowhere else has
#: probability 2 (1 - 0.75^3)^16, 3e-4, at similarity 0.75 and 2e-5 at 0.8.
FEW = 4


#: Half-keys of either collection that the first pass looks at.
FIRST = 3


def _hasher() -> WordHash:
    return worker_state("near-words", WordHash)


def half_keys(mins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of consecutive groups of ``rows`` minhashes, each with its place hashed in."""
    m = mins.reshape(-1, rows)
    acc = np.arange(1, len(m) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        acc = mix64(acc ^ m[:, j])
    return acc


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, set_key (128-bit digest of the set, null without shingles), halves, s0..s3."""

    def run(batches):
        h = _hasher()
        for b in batches:
            sets = [shingle_hashes(h.of(words(raw))) for raw in b.column("text").to_pylist()]
            mins = iter(minhashes([s for s in sets if len(s)], N_MINHASHES))
            key, halves, sk = [], [], []
            for s in sets:
                m = next(mins) if len(s) else None
                key.append(None if m is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                halves.append(np.empty(0, dtype=np.int64) if m is None else signed(half_keys(m)))
                sk.append([0, 0, 0, 0] if m is None else sketch_words(m))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()),
                 list_array(halves, pa.int64()), *[pa.array([x[i] for x in sk], pa.int64()) for i in range(4)]],
                ["doc_id", "text_hash", "n", "set_key", "halves", *SKETCH])

    rows = as_bytes(documents_like(docs)).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, n long, set_key binary, halves array<long>, "
                       + ", ".join(f"{s} long" for s in SKETCH))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) for ``wanted`` (id, doc_id, set_key): whole texts are read again, only those sets move."""
    bits, bitmap = bitmap_of(wanted, lambda n: id_bit(F.col("doc_id"), n))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        h = _hasher()
        known = shared.value
        for b in batches:
            rows = b.filter(pa.array(in_bitmap(known, b.column("bit").to_numpy())))
            sets = [shingle_hashes(h.of(words(raw))) for raw in rows.column("text").to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(keys, pa.binary()),
                                              list_array([signed(s) for s in sets], pa.int64())],
                                             ["doc_id", "set_key", "set"])

    rows = as_bytes(docs.where("doc_id is not null")).withColumn("bit", id_bit(F.col("doc_id"), bits))
    found = map_batches(rows.select("doc_id", "text", "bit"), run, "doc_id long, set_key binary, set array<long>")
    # rows that repeat a document repeat its set: one of them serves
    return found.join(wanted, ["doc_id", "set_key"]).select("id", "set").dropDuplicates(["id"])


def first_keys(items: DataFrame) -> DataFrame:
    """(key, id): the first half-keys of either collection, which most near copies share."""
    at = [F.element_at("halves", c * HALVES + i + 1) for c in (0, 1) for i in range(FIRST)]
    return items.select(F.explode(F.array(*at)).alias("key"), "id")


def table_keys(items: DataFrame, first: DataFrame, halves: int = HALVES) -> DataFrame:
    """(key, id, component): pairs of half-keys, one of either collection, both shared with another component.

    ``first``: (node, component) of items already linked; the others are components of their own. Half-keys that
    only one component has cannot lead to a link between two.
    """
    known = first.withColumnRenamed("node", "id")
    half = (items.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
            .select("id", "component", F.posexplode("halves").alias("at", "half")))
    shared = half.groupBy("half").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("half")
    live = half.join(shared, "half")
    sides = live.groupBy("id", "component").agg(F.collect_list(F.when(F.col("at") < halves, F.col("half"))).alias("x"),
                                                F.collect_list(F.when(F.col("at") >= halves, F.col("half"))).alias("y"))
    return (sides.select("id", "component", F.explode("x").alias("x"), "y").select("id", "component", "x", F.explode("y").alias("y"))
            .select(F.xxhash64("x", "y").alias("key"), "id", "component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return _judged(documents_like(docs, id_col, text_col)).drop("text_hash")


def _judged(docs: DataFrame) -> DataFrame:
    """The rows of :func:`near_groups` with ``text_hash``."""
    with scratch():
        return written(_groups(docs), "judged", keep=True)


def _groups(docs: DataFrame) -> DataFrame:
    sk = written(sketches(docs).withColumn("v", F.monotonically_increasing_id()), "sketches")
    cols = ["doc_id", "v", "n", "halves", *SKETCH]
    # one item per set, named by a row of its smallest document
    items = (sk.where("set_key is not null and doc_id is not null").groupBy("set_key")
             .agg(F.min(F.struct(*cols)).alias("r")).select("set_key", *[F.col(f"r.{c}").alias(c) for c in cols]))
    items = written(items.withColumnRenamed("v", "id"), "items")

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(docs, written(items.select("id", "doc_id", "set_key").join(ids, "id"), "wanted"))

    first = first_components(first_keys(items), items.select("id", "n", *SKETCH), sets_of, N_MINHASHES)
    comp = linked_components(table_keys(items, first), items.select("id", "n", *SKETCH), sets_of, N_MINHASHES, FEW, first)
    member = items.select("id", "set_key", "doc_id").join(comp.withColumnRenamed("node", "id"), "id")
    least = member.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = member.join(least, "component").select("set_key", "least")
    named = written(items.select("set_key", "doc_id").join(linked, "set_key", "left")
                    .select("set_key", F.coalesce("least", "doc_id").alias("least")), "components")
    return (sk.join(named, "set_key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "text_hash")
            .withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with only the smallest id of each near-duplicate component; all columns stay.

    A row goes by its id and text: other texts of the same id are judged by themselves."""
    gone_id, gone_text = unused(docs, "_gone", "_gone_text")
    gone = _judged(documents_like(docs)).where("not kept").select(
        F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(gone, (docs["doc_id"] == gone[gone_id]) & (own == gone[gone_text]), "left_anti")
