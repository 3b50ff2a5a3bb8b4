"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are cut into pieces of at most ``capacity`` tokens (words, plus one end
token per document). Pieces go to the tightest bin that has room and holds
neither another piece of their source (while the bin's bitmap has that source's
bit) nor one of their cluster of equal texts. Bins are ordered by residual;
a bitset over residuals gives the successor of the wanted size, and the search
goes on through larger residuals until a compatible bin is found, else a new bin
opens. Pieces are placed in order of falling size (best fit decreasing).

Packing runs in independent shards of about ``shard_rows`` pieces, dealt by a hash
of the id, the piece and the row's place, so no source, cluster, run of ids or repeated row
concentrates in a task and a lost executor repeats only its shards. Bins never span shards. Repeated rows, a source
or a cluster of any size only open more bins.

Defined results: null text counts as empty (one end token); a null source
conflicts with nothing; null and repeated ids are pieces of their own; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, written

CAPACITY = 2048
SHARD_ROWS = 20_000


class BestFitBins:
    """Open bins of one shard: residual -> {source bitmap: bins}."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.classes: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.occupied = 0  # bit r: some open bin has residual r
        self.sources: list[int] = []  # bitmaps by bin
        self.clusters: list[int] = []
        self.residual: list[int] = []
        self.blocked: dict[int, int] = {}  # source bit -> residuals that hold only bins with that bit

    def _take(self, r: int, bitmap: int, at: int) -> int:
        group = self.classes[r][bitmap]
        b = group[at]
        group[at] = group[-1]
        group.pop()
        if not group:
            del self.classes[r][bitmap]
            if not self.classes[r]:
                self.occupied &= ~(1 << r)
        return b

    def _put(self, b: int) -> None:
        r = self.residual[b]
        self.classes[r].setdefault(self.sources[b], []).append(b)
        self.occupied |= 1 << r
        bitmap = self.sources[b]
        for bit, residuals in self.blocked.items():
            if residuals >> r & 1 and not bitmap & bit:
                self.blocked[bit] = residuals & ~(1 << r)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin of a piece; ``source`` and ``cluster`` are single bits, 0 for none."""
        known = self.blocked.setdefault(source, 0) if source else 0
        open_residuals = (self.occupied & ~known) >> size << size
        found = -1
        while open_residuals and found < 0:
            low = open_residuals & -open_residuals
            r = low.bit_length() - 1
            only_source = True
            for bitmap, bins in self.classes[r].items():
                if bitmap & source:
                    continue
                only_source = False
                at = next((i for i in range(len(bins) - 1, -1, -1) if not self.clusters[bins[i]] & cluster), -1)
                if at >= 0:
                    found = self._take(r, bitmap, at)
                    break
            else:
                if only_source and source:
                    self.blocked[source] |= low
                open_residuals ^= low
        if found < 0:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        self.residual[found] -= size
        self.sources[found] |= source
        self.clusters[found] |= cluster
        if self.residual[found]:
            self._put(found)
        return found


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of each piece, placed in the given order."""
    bits: dict = {}
    repeated, seen = set(), set()
    for c in clusters:
        (repeated if c in seen else seen).add(c)
    cluster_bits = {c: 1 << i for i, c in enumerate(sorted(c for c in repeated if c is not None))}
    bins = BestFitBins(capacity)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        bit = 0 if source is None else bits.setdefault(source, 1 << len(bits))
        out.append(bins.place(size, bit, cluster_bits.get(cluster, 0)))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, cluster (128 bits of the lower-cased text's digest) of every row."""

    def run(batches):
        for b in batches:
            raws = [raw.lower() for raw in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([len(r.split()) + 1 for r in raws], pa.int64()),
                 pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raws], pa.binary())],
                ["doc_id", "source", "n_tokens", "cluster"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       docs[source_col].cast("string").alias("source"))
    return map_batches(as_bytes(rows), run, "doc_id long, source string, n_tokens long, cluster binary")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, shard, bin, bin_offset, source.

    A bin is (shard, bin); ``bin_offset`` is where the piece starts in it.
    """
    # ``row`` sets repeated rows apart; it is written, so a repeated task deals alike
    sized = written(measure(docs, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "sized")
    pieces = sized.agg(F.sum(F.ceil(F.col("n_tokens") / capacity)).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(pieces) // shard_rows))
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))
    cut = sized.select("doc_id", "source", "cluster", "n_tokens", "row", at.alias("piece"))
    cut = cut.select("doc_id", "source", "cluster", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start_token"),
                     F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("size"),
                     F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row"), F.lit(shards)).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True],
                              kind="stable").reset_index(drop=True)
        # pieces that fill a bin leave no room: they need no search
        pdf["bin"] = pack_shard(pdf["size"].tolist(), [None if pd.isna(s) else s for s in pdf["source"]],
                                pdf["cluster"].tolist(), capacity)
        pdf["bin_offset"] = pdf.groupby("bin")["size"].cumsum() - pdf["size"]
        return pdf[["doc_id", "piece", "start_token", "size", "shard", "bin", "bin_offset", "source"]].rename(
            columns={"size": "n_tokens"})

    return cut.groupBy("shard").applyInPandas(
        run, "doc_id long, piece int, start_token long, n_tokens long, shard int, bin long, bin_offset long, source string")
