"""Sharding by balanced label propagation (DataFrame functions only).

Documents are vertices, links are edges. Every linked document starts in the
shard of its hash. In each round a document counts its neighbours' shards and
asks to move to the most frequent one if that cuts fewer edges. Of two linked
askers only the one with the larger gain moves, so rounds never swap a pair and
the cut falls monotonically. A shard admits askers in order of gain up to its
quota, counted per (shard, gain class, hash bucket); whole buckets are admitted.
At last documents without links, which cost no cut, fill the shards to sizes at
most one apart; only if linked documents exceed a shard's size are the least
linked of them moved too.

Global ranks (fill order, slots) use two levels: rows per (shard, bucket) give
offsets (at most shards x buckets rows), a window inside a bucket finishes.

Defined results: null text has no bytes (size 1, crc32 0) and equals the empty
text as a group; rows with null or repeated ids are vertices of their own
(a row key, not the id, names a vertex); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
BUCKETS = 256
ROUNDS = 8
#: Leaves of one hub in the links of a group of equal texts.
FANOUT = 1024


def group_links(rows: DataFrame, vertex: str, key: str, whole: int, fanout: int = FANOUT) -> DataFrame:
    """Weighted links (a, b, w) that connect each group of equal ``key``: a tree, not all pairs.

    A group of n rows gets ceil(n / fanout) hubs, each the smallest vertex of its
    hash part; leaves link to their hub and hubs to the group's smallest vertex.
    The links between hubs outweigh a hub's leaves in groups of at most ``whole``
    rows, which fit into a shard; larger groups must be cut, best between hubs.
    """
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = written(size.withColumn("parts", F.ceil(F.col("n") / F.lit(fanout))), "group-sizes")
    part = F.pmod(F.xxhash64(F.col(vertex), F.lit(7)), F.col("parts"))
    members = written(rows.select(vertex, key).join(size, key).select(vertex, key, part.alias("part")), "members")
    hubs = written(members.groupBy(key, "part").agg(F.min(vertex).alias("hub")), "hubs")
    roots = hubs.groupBy(key).agg(F.min("hub").alias("root"))
    leaf = (members.join(hubs, [key, "part"]).where(F.col(vertex) != F.col("hub"))
            .select(F.col("hub").alias("a"), F.col(vertex).alias("b"), F.lit(1).cast("long").alias("w")))
    weight = F.when(F.col("n") <= whole, F.lit(4 * fanout)).otherwise(1).cast("long")
    trunk = (hubs.join(roots, key).join(size.select(key, "n"), key).where("hub <> root")
             .select(F.col("root").alias("a"), F.col("hub").alias("b"), weight.alias("w")))
    return leaf.union(trunk)


def _gain_class(gain: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(7) - F.floor(F.log2(gain)).cast("int"))


def propagate(links: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Labels (v, shard) of all linked vertices after balanced label propagation.

    ``capacity[s]`` is the most linked vertices that shard ``s`` may admit. Ends
    early when no vertex moves.
    """
    spark, shards = links.sparkSession, len(capacity)
    ab = (links.where("a is not null and b is not null and a <> b")
          .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    edges = written(ab.union(ab.select("b", "a", "w")), "links")
    labels = written(edges.select(F.col("a").alias("v")).distinct()
                     .withColumn("shard", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)).cast("int")), "labels")
    for _ in range(rounds):
        votes = (edges.join(labels.select(F.col("v").alias("b"), F.col("shard").alias("to")), "b")
                 .groupBy("a", "to").agg(F.sum("w").alias("votes")))
        best = (votes.join(labels.select(F.col("v").alias("a"), "shard"), "a").groupBy("a", "shard")
                .agg(F.max(F.struct("votes", (-F.col("to")).alias("neg"))).alias("best"),
                     F.sum(F.when(F.col("to") == F.col("shard"), F.col("votes")).otherwise(0)).alias("own")))
        ask = written(best.select(F.col("a").alias("v"), (-F.col("best.neg")).alias("to"),
                                  (F.col("best.votes") - F.col("own")).alias("gain")).where("gain > 0"), "ask")
        rival = (edges.join(ask.select(F.col("v").alias("a"), F.col("gain").alias("g")), "a")
                 .join(ask.select(F.col("v").alias("b"), F.col("gain").alias("h")), "b")
                 .where("h > g or (h = g and b < a)").select(F.col("a").alias("v")).distinct())
        bucket = _gain_class(F.col("gain")) * BUCKETS + F.pmod(F.xxhash64("v", F.lit(5)), F.lit(BUCKETS))
        movers = written(ask.join(rival, "v", "left_anti").withColumn("bucket", bucket), "movers")
        # shards x gain classes x buckets rows at most
        load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [max(0, capacity[s] - load.get(s, 0)) for s in range(shards)]
        cut = [8 * BUCKETS] * shards
        for r in movers.groupBy("to", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("to", "bucket").collect():
            s = r["to"]
            if r["bucket"] < cut[s]:
                if r["n"] > room[s]:
                    cut[s] = r["bucket"]
                else:
                    room[s] -= r["n"]
        limit = F.element_at(F.array(*[F.lit(c) for c in cut]), F.col("to") + 1)
        moved = movers.where(F.col("bucket") < limit).select("v", F.col("to").alias("new"))
        after = written(labels.join(moved, "v", "left")
                        .select("v", F.coalesce("new", "shard").cast("int").alias("shard"),
                                F.col("new").isNotNull().alias("m")), "labels")
        done = after.where("m").limit(1).count() == 0
        labels = after.select("v", "shard")
        if done:
            break
    return labels


def _offsets(df: DataFrame, keys: list[str], n: str = "off") -> DataFrame:
    """Exclusive running counts over (keys..., bucket): a bounded table."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    c = df.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    return c.select(*keys, "bucket", (F.sum("_n").over(w) - F.col("_n")).alias(n))


def _ranked(df: DataFrame, keys: list[str], order: list, bound: int) -> DataFrame:
    """Rank from 0 within ``keys``; ``bucket`` is monotone in ``order``.

    The offsets hold at most ``bound`` rows (keys x buckets), so they are broadcast.
    """
    off = _offsets(df, keys)
    inner = Window.partitionBy(*keys, "bucket").orderBy(*order)
    return (df.join(F.broadcast(off), [*keys, "bucket"])
            .withColumn("rank", F.row_number().over(inner) - 1 + F.col("off")).drop("off"))


def balanced_shards(vertices: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(v, shard, slot): every vertex of ``vertices(v)`` in a shard, counts at most one apart.

    ``links(a, b, w)`` name vertices and weigh their links. ``slot`` numbers a shard's rows without gaps from 0.
    """
    vertices = vertices.select("v")
    total = vertices.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(links, quota, rounds)
    degree = (links.select(F.col("a").alias("v")).union(links.select(F.col("b").alias("v")))
              .groupBy("v").agg(F.count(F.lit(1)).alias("deg")))
    h = F.pmod(F.xxhash64("v", F.lit(11)), F.lit(BUCKETS))
    # linked rows keep their shard up to its quota, the most linked first
    linked = labels.join(degree, "v").withColumn(
        "bucket", F.greatest(F.lit(0), 7 - F.floor(F.log2("deg")).cast("int")) * BUCKETS + h)
    rows = written(vertices.join(linked, "v", "left"), "placed")
    ranked = _ranked(rows.where("shard is not null"), ["shard"], ["v"], shards * 8 * BUCKETS)
    at = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    ranked = written(ranked.withColumn("stays", F.col("rank") < at), "ranked")
    held = {r["shard"]: r["n"] for r in ranked.where("stays").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = (rows.where("shard is null").select("v").union(ranked.where("not stays").select("v"))
            .withColumn("bucket", F.pmod(F.xxhash64("v", F.lit(13)), F.lit(16 * BUCKETS))))
    free = _ranked(free.withColumn("one", F.lit(0)), ["one"], ["v"], 16 * BUCKETS)
    upto, dealt = 0, F.lit(shards - 1)
    bounds = []
    for s in range(shards):
        upto += quota[s] - held.get(s, 0)
        bounds.append(upto)
    for s in reversed(range(shards - 1)):
        dealt = F.when(F.col("rank") < bounds[s], F.lit(s)).otherwise(dealt)
    placed = (ranked.where("stays").select("v", "shard")
              .union(free.select("v", dealt.cast("int").alias("shard"))).withColumn("bucket", h))
    placed = written(placed, "shards")
    return _ranked(placed, ["shard"], ["v"], shards * BUCKETS).select(
        "v", "shard", F.col("rank").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shards of documents linked by equal texts: doc_id, size, text_crc32, shard, slot."""
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    # a row key: the id's hash, told apart among repeated and null ids by content and position
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("text_key"),
                       F.monotonically_increasing_id().alias("v"))
    rows = written(rows, "rows")
    whole = rows.count() // shards
    placed = balanced_shards(rows, group_links(rows, "v", "text_key", whole), shards, rounds)
    return rows.join(placed, "v").select("doc_id", "size", "text_crc32", "shard", "slot")
