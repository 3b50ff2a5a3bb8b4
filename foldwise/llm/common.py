"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import string
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwise.session import discard, materialise

#: Rows in an Arrow batch handed to Python: whole texts may be 100 KB and more.
ARROW_ROWS = 256
MASK64 = (1 << 64) - 1
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_like(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so extra columns cannot clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"),
                     *[df[m] for m in more])


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in, which equals it there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def as_bytes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text as UTF-8 bytes (null: empty), which Arrow hands over without decoding."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between the bytes 0x20 and 0x09-0x0D."""
    return raw.lower().split()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session (they need not have it installed)."""
    sc = spark.sparkContext
    if getattr(sc, "_foldwise_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="foldwise-src-"), "foldwise.zip")  # served by the driver
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(to)
    sc._foldwise_shipped = True


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | StructType, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows, in a plan by those of the call that came last."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class WordHash(dict):
    """word -> 64-bit hash, computed once per word and worker; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of the Python worker (caches; never results).

    ``sys.modules`` keeps it out of the pickled closures, so every task of a worker finds it again.
    """
    store = sys.modules[__name__].__dict__.setdefault("_STATE", {})
    if name not in store:
        store[name] = make()
    return store[name]


def shingle_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width``-word shingles; fewer words make one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(width, n)
    acc = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - k + 1 + j]
    if k < width:
        acc = acc + np.uint64(k)
    return np.unique(mix64(acc))


def minhash_family(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of ``count`` hash functions."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, count, dtype=np.uint64))


def minhashes(sets: list[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """Min-wise hashes of non-empty shingle sets: one row of ``count`` per set."""
    out = np.empty((len(sets), count), dtype=np.uint64)
    if sets:
        mult, mask = minhash_family(count, seed)
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for i in range(count):
            out[:, i] = np.minimum.reduceat((flat ^ mask[i]) * mult[i], starts)
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy rows."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    if rows:
        np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def crc_mod5(col: Column) -> Column:
    """crc32 of the id written as text, modulo 5 (null id: the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def bitmap_of(ids: DataFrame, bit: Callable[[int], Column]) -> tuple[int, np.ndarray]:
    """(bits, packed bitmap) with bit ``bit(bits)`` of every row set; ``bits`` is a power of two.

    Rows whose bit is not set are surely not among the ids, so texts are filtered
    before anything is shuffled; a join decides the rest. At most 2^25 bits (4 MB).
    """
    n = ids.count()
    bits = 1 << 15
    while bits < 16 * n and bits < 1 << 25:
        bits *= 2
    x = bit(bits).cast("long") + 1
    rows = ids.groupBy(F.bitmap_bucket_number(x).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("map")).collect()  # 4 KB each
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["map"], dtype=np.uint8)
        out[(r["at"] - 1) * len(part):r["at"] * len(part)] = part
    return bits, out


def in_bitmap(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def id_bit(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits)).cast("long")


#: Tables made inside each open :func:`scratch`, the innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end, but for those to ``keep``: no more than the tables
    of the step at work are on disk. What comes out of it must read kept tables only."""
    _SCRATCH.append([])
    try:
        yield
    except BaseException:
        _SCRATCH.pop()
        raise
    discard(*_SCRATCH.pop())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors. Inside a :func:`scratch` it is
    deleted with it, with ``keep`` with the next outer one, if there is one.

    The shuffle files of a query go when it ends, unless the session's owner set :data:`CLEAN_SHUFFLES`: an operator of many
    written rounds would keep those of all rounds on disk until the driver's garbage collector finds them.
    """
    conf = df.sparkSession.conf
    if conf.get(CLEAN_SHUFFLES, None) is None:
        conf.set(CLEAN_SHUFFLES, "true")
    out = materialise(df, f"llm-{name}")
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(out)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an edge table: rows (node, component), component = smallest node.

    Alternating large-star and small-star joins; every round is a table in the
    shared folder, deleted when the next one is there. Rounds end when the edges form stars: every node has either one
    smaller neighbour, which has none itself, or none. Nodes without an edge are
    absent. Null ends and self-loops are ignored; no edges give no rows.
    """
    kind = edges.schema[a].dataType

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            df.select("v", F.lit(0), F.lit(1)))
        up, down = F.sum("up"), F.max("down")
        return ends.groupBy("x").agg(up.alias("up"), down.alias("down")).where(
            "up > 1 or (up = 1 and down = 1)").limit(1).count() == 0

    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u is not null and v is not null and u <> v").distinct(), "edges")
    rounds = 0
    while not stars(cur):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        with scratch():
            both = cur.union(cur.select("v", "u"))
            low = written(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), "low")
            large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
            large = written(large, "large")
            low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            small = large.join(low, "u")
            after = written(small.select("u", F.col("m").alias("v"))
                            .union(small.where("v <> m").select("v", "m")).distinct(), "small", keep=True)
        discard(cur)
        cur = after
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return out.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
