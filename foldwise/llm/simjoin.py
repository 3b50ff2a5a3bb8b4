"""From hash-table keys to exact links and their components, without pairing up whole buckets.

Items have an id, a set of 64-bit shingles, a 1-bit-minhash sketch and any number
of table keys; items that share a key are candidates.

* Buckets are sized, and those of one component left out, by a window over their keys:
  one row an item and key, without a join.
* Buckets of at most ``SMALL`` items pair their members (a bounded number each); tables often
  repeat such a bucket, so its list of members is paired once.
* In larger buckets every member is paired with ``CENTRES`` members only: the least
  and the first ones in fixed hash orders, so buckets of the same items agree on them.
  Links that this leaves out can only join members that are not yet in one
  component, so those members are joined again exactly by prefix filtering: sets
  with Jaccard >= t share one of their n - ceil(t n) + 1 rarest shingles, and only
  pairs across components are looked at. Members of at most ``few`` large buckets need
  not be: a similar pair shares many tables, and the chance that it shares none but
  those few is of the order of the tables' own chance to miss it (the callers state it).

Pairs whose sketches differ so much that similarity t is out of the question
(more than five standard deviations) are dropped before the sets are fetched;
all others are verified on full sets: 100 |A & B| >= 75 |A | B|.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, scratch, written

PERCENT = 75
SMALL = 24
CENTRES = 5
SKETCH = [f"s{i}" for i in range(4)]


def sketch_words(mins: np.ndarray) -> list[int]:
    """Two bits of each minhash, at most 128 of them, packed into four signed 64-bit words."""
    m = mins[:128]
    bits = np.zeros(256, dtype=np.uint8)
    bits[:2 * len(m)] = np.stack([(m & np.uint64(1)), (m >> np.uint64(1)) & np.uint64(1)], axis=1).reshape(-1)
    return np.packbits(bits).view(np.int64).tolist()


def _far(n_minhashes: int, percent: int) -> int:
    """Differing sketch bits that similarity ``percent`` does not reach within 5 standard deviations."""
    n = min(128, n_minhashes)
    p = percent / 100
    mean, var = (1 - p), (1 - p) * 1.5 - (1 - p) ** 2
    return int(n * mean + 5 * (n * var) ** 0.5) + 1


def _plausible(n_minhashes: int, percent: int) -> Column:
    differ = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in SKETCH[1:]),
                 F.bit_count(F.col(f"a{SKETCH[0]}").bitwiseXOR(F.col(f"b{SKETCH[0]}"))))
    sizes = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    return sizes & (differ <= _far(n_minhashes, percent))


def _sketched(pairs: DataFrame, items: DataFrame, n_minhashes: int, percent: int) -> DataFrame:
    for side in ("a", "b"):
        s = items.select(F.col("id").alias(side), F.col("n").alias(f"{side}n"),
                         *[F.col(c).alias(side + c) for c in SKETCH])
        pairs = pairs.join(s, side)
    return pairs.where(_plausible(n_minhashes, percent)).select("a", "b")


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. ``sets_of(ids)`` gives (id, set array<long>).

    An id in many pairs (the least member of a large bucket) would gather them all in one
    task, so its set is dealt over a salt for every 64 of its pairs.
    """
    with scratch():
        return written(_verified(pairs, sets_of, percent), "links", keep=True)


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    pairs = written(pairs.distinct(), "pairs")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    sets = written(sets_of(ids), "sets")
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(64)).cast("int").alias("parts")), "parts")
    left = (sets.withColumnRenamed("id", "a").join(parts, "a")
            .select("a", F.col("set").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    both = (salted.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
            .join(left, ["a", "salt"]))
    common = F.size(F.array_intersect("sa", "sb"))
    hit = common * 100 >= (F.size("sa") + F.size("sb") - common) * percent
    return both.where(hit).select("a", "b")


def first_components(keys: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], n_minhashes: int,
                     percent: int = PERCENT) -> DataFrame:
    """(node, component) of verified links between items and the smallest item of each of their ``keys`` (key, id)."""
    with scratch():
        return written(_first_components(keys, items, sets_of, n_minhashes, percent), "first", keep=True)


def _first_components(keys: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], n_minhashes: int,
                      percent: int) -> DataFrame:
    root = keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "a")
    pairs = keys.withColumnRenamed("id", "b").join(root, "key").where("a <> b").select("a", "b").distinct()
    return components(verified(_sketched(pairs, items, n_minhashes, percent), sets_of, percent))


def _live(keys: DataFrame) -> DataFrame:
    """(key, id, component, size) of the buckets with two components or more, in one pass over ``keys``."""
    bucket = Window.partitionBy("key")
    return (keys.select("key", "id", "component", F.count(F.lit(1)).over(bucket).alias("size"), F.min("component").over(bucket).alias("lo"),
                        F.max("component").over(bucket).alias("hi"))
            .where("lo <> hi").select("key", "id", "component", "size"))


def _small_pairs(small: DataFrame) -> DataFrame:
    """(a, b) of members of different components; every set of members is paired once, however many keys have it."""
    members = F.array_sort(F.collect_list(F.struct("id", "component")))
    once = small.groupBy("key").agg(members.alias("m")).select("m").distinct()
    later = F.filter("m", lambda y: (y["id"] > F.col("x.id")) & (y["component"] != F.col("x.component")))
    return (once.select(F.explode("m").alias("x"), "m").select(F.col("x.id").alias("a"), F.explode(later).alias("y"))
            .select("a", F.col("y.id").alias("b")).distinct())


def _centred(large: DataFrame) -> DataFrame:
    """One row an item of ``large``: id, component, its number of buckets ``c``, their least members and their centres of other components."""
    bucket = Window.partitionBy("key")
    own = F.struct("id", "component")
    centre = [F.min_by(own, F.xxhash64("id", F.lit(r))).over(bucket) for r in range(1, CENTRES)]
    rows = large.select("id", "component", F.min("id").over(bucket).alias("least"), F.array(F.min(own).over(bucket), *centre).alias("of"))
    others = F.transform(F.filter("of", lambda x: x["component"] != F.col("component")), lambda x: x["id"])
    # a member's centres over all its buckets are one set before they become rows
    return rows.withColumn("of", F.array_distinct(others)).groupBy("id", "component").agg(
        F.count(F.lit(1)).alias("c"), F.collect_set("least").alias("least"), F.array_distinct(F.flatten(F.collect_set("of"))).alias("centres"))


def _prefixes(tokens: DataFrame, weight: DataFrame, percent: int) -> DataFrame:
    """Rows (token, id, rank) of each set's n - ceil(t n) + 1 first tokens; ``tokens``: (token, id, n).

    Tokens are ordered by (df, token). Tokens without a row in ``weight`` (token, df) come
    first; they need not be among ``tokens``, since only their number counts.
    """
    own = Window.partitionBy("id")
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token"))
    return (tokens.join(weight, "token").withColumn("rank", rank)
            .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1)
            .select("token", "id", "rank"))


def _prefix_pairs(members: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame],
                  n_minhashes: int, percent: int) -> DataFrame:
    """Plausible pairs across components that share a token of both prefixes.

    ``members``: (id, component, apart); one member of a pair is ``apart``, so a token's
    df counts the sets of those. A pair meets at a token only if the tokens from there
    on can still make up the wanted overlap.
    """
    info = members.join(items.select("id", "n", *SKETCH), "id")
    tokens = (sets_of(members.select("id")).join(info.select("id", "n", "apart"), "id")
              .select(F.explode("set").alias("token"), "id", "n", "apart"))
    tokens = written(tokens, "tokens")
    weight = written(tokens.where("apart").groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-df")
    prefix = written(_prefixes(tokens, weight, percent).join(info, "id"), "prefixes")
    sides = [(prefix.where("apart") if side == "a" else prefix).select(
        "token", *[F.col(c).alias(side + c) for c in ("id", "component", "n", "rank", *SKETCH)]) for side in "ab"]
    rest = 1 + F.least(F.col("an") - F.col("arank"), F.col("bn") - F.col("brank"))
    meet = ((F.col("acomponent") != F.col("bcomponent")) & _plausible(n_minhashes, percent)
            & (rest * (100 + percent) >= (F.col("an") + F.col("bn")) * percent))
    both = sides[0].withColumnRenamed("token", "x").join(sides[1], (F.col("x") == F.col("token")) & meet)
    return both.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct()


def linked_components(keys: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], n_minhashes: int,
                      few: int, first: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """Rows (node, component) of every item with a verified link; component = smallest item reachable.

    ``keys``: (key, id, component); ``items``: (id, n, s0..s3), one row per id. ``sets_of(ids)`` gives (id, set).
    ``first``: (node, component) of links found before. Only items that a key gives different components are paired:
    those of ``first``, each item itself, or whatever else says that a pair need not be looked at.
    """
    with scratch():
        return written(_linked(keys, items, sets_of, n_minhashes, few, first, percent), "linked", keep=True)


def _linked(keys: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], n_minhashes: int,
            few: int, first: DataFrame | None, percent: int) -> DataFrame:
    live = written(_live(keys), "live-keys")
    pairs = _small_pairs(live.where(F.col("size") <= SMALL))
    large = written(_centred(live.where(F.col("size") > SMALL)), "centred")
    star = large.select(F.explode("centres").alias("a"), F.col("id").alias("b"))
    found = verified(_sketched(pairs.union(star).distinct(), items, n_minhashes, percent), sets_of, percent)
    if first is not None:  # the components so far stand for their links
        found = found.union(first.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b"))
    comp = written(components(found), "found")
    if large.limit(1).count() == 0:
        return comp
    # buckets of the same least item ask the same question: one row an item and least item
    asked = (large.where(F.col("c") > few).select("id", "least").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .select("id", F.coalesce("component", "id").alias("component"), F.explode("least").alias("least")))
    member = (asked.join(comp.select(F.col("node").alias("least"), F.col("component").alias("main")), "least", "left")
              .withColumn("main", F.coalesce("main", "least")))
    member = written(member.groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("apart")),
                     "members")
    if member.where("apart").limit(1).count() == 0:
        return comp
    more = _prefix_pairs(member.select("id", "component", "apart"), items, sets_of, n_minhashes, percent)
    return components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
                      .union(verified(more, sets_of, percent)))
