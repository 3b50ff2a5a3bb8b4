"""Document fingerprints by winnowing.

Every ``k`` consecutive code points get a polynomial rolling hash; each window of
``window`` consecutive hashes contributes its minimum, the rightmost one among
equals, with its position. Any passage of ``k + window - 1`` code points that two
texts share therefore leaves a common fingerprint in both.

Texts too short for that guarantee keep every hash of k-grams of a quarter of
their length (``k`` at most, 1 at least); the empty text (and null) has none.

Likeness is the Jaccard similarity of the two bags of selected hashes, so text
that repeats counts as often as it stands there; two empty bags are alike (1.0).

Neighbours by ascending id come from a range-blocked layout: ids are cut into
blocks at approximate quantiles, each block is sorted and also receives the first
document of the next block, so one shuffle of the texts brings every document
next to its successor.

Defined results: null text is empty; rows with a null id come first in the order,
rows that repeat an id follow one another; an empty table gives no rows; a single
document is its own successor; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents_like, map_batches, mix64

K = 12
WINDOW = 32
BASE = np.uint64(0x100000001B3)
MASK64 = (1 << 64) - 1
LOW32 = np.uint64(0xFFFFFFFF)


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams (of the whole text if it is shorter).

    Polynomial hashes of lengths 1, 2, 4, ... combine into length k, so the cost
    per code point grows with log k.
    """
    n = len(codes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    power, block, length = BASE, codes.astype(np.uint64) + np.uint64(1), 1
    out, out_len = None, 0
    while True:
        if k & length:  # append this block to what is gathered so far
            if out is None:
                out, out_len = block, length
            else:
                m = n - (out_len + length) + 1
                out = out[:m] * power + block[out_len:out_len + m]
                out_len += length
        if length * 2 > k:
            break
        block = block[:-length] * power + block[length:]
        power = np.uint64(int(power) * int(power) & MASK64)
        length *= 2
    return mix64(out[:n - k + 1]) >> np.uint64(32)


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) selected from a text's code points, by position."""
    if len(codes) < k + window - 1:
        k, window = max(1, min(k, len(codes) // 4)), 1
    h = rolling_hashes(codes, k)
    n = len(h)
    if n == 0:
        return h.astype(np.uint32), np.empty(0, dtype=np.int64)
    # the smaller key is the smaller hash, then the larger position
    key = (h << np.uint64(32)) | (LOW32 - np.arange(n, dtype=np.uint64))
    w, width = min(window, n), 1
    low = key
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[:n - w + 1], low[w - width:w - width + n - w + 1])
    keep = np.empty(len(low), dtype=bool)
    keep[0] = True
    np.not_equal(low[1:], low[:-1], out=keep[1:])
    low = low[keep]
    return (low >> np.uint64(32)).astype(np.uint32), (LOW32 - (low & LOW32)).astype(np.int64)


def fingerprint_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Digest of the selected hashes and their positions (hex); empty without hashes."""
    if len(hashes) == 0:
        return ""
    return hashlib.blake2b(hashes.astype("<u4").tobytes() + positions.astype("<i8").tobytes(), digest_size=16).hexdigest()


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and how often each was selected."""
    return np.unique(hashes, return_counts=True)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def codes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long>, positions array<long>: the selected hashes of every text."""

    def run(batches):
        for b in batches:
            got = [winnow(codes_of(raw), k, window) for raw in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())),
                 pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return map_batches(as_bytes(documents_like(docs, id_col, text_col)), run,
                       "doc_id long, hashes array<long>, positions array<long>")


def with_successor_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, lead, doc_id, text bytes), laid out so that each partition holds whole blocks
    sorted by id; ``lead`` 1 marks the first document of the next block (cyclic), once more.

    The cut points, one per block, are the only values that reach the driver.
    """
    d = documents_like(docs)
    low = -(1 << 63)
    cuts = (d.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10_000).alias("c")).first()["c"]
            if blocks > 1 else None) or []
    cuts = sorted(set(cuts))
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    # binary search over the cut points, unrolled as a balanced tree of comparisons
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    block = tree(0, len(cuts))
    ids = d.select("doc_id", block.alias("block"))
    heads = sorted((r["block"], r["head"]) for r in ids.groupBy("block").agg(
        F.min(F.coalesce("doc_id", F.lit(low))).alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    # of repeated rows with a head's id one serves as the head
    lead_to = F.lit(None).cast("int")
    if before:
        lookup = F.create_map(*[F.lit(x) for h, p in before.items() for x in (h, p)])
        lead_to = F.element_at(lookup, key)
    rows = as_bytes(d.withColumn("block", block).withColumn("to", lead_to))
    rows = rows.select("doc_id", "text", F.explode(F.array(
        F.struct(F.col("block").alias("block"), F.lit(0).alias("lead")),
        F.struct(F.col("to").alias("block"), F.lit(1).alias("lead")))).alias("x")).select("doc_id", "text", "x.*")
    return (rows.where("block is not null").repartition(max(1, len(heads)), "block")
            .sortWithinPartitions("block", "lead", F.col("doc_id").asc_nulls_first(), "text"))


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def neighbour_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with the next document's."""
    spark = docs.sparkSession
    blocks = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def row(doc_id, text: str, marks, following: str, next_marks) -> tuple:
        edited = edited_text(text, following)
        e = winnow(np.frombuffer(edited.encode("utf-32-le"), dtype="<u4"), k, window)
        mine, other = bag(marks[0]), bag(next_marks[0])
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint_string(*marks),
                fingerprint_string(*e), likeness(mine, bag(e[0])), likeness(mine, other), len(marks[0]))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_marks"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        last = None  # the row still waiting for its successor
        for b in batches:
            out = []
            for block, lead, doc_id, raw in zip(*(b.column(c).to_pylist() for c in ("block", "lead", "doc_id", "text")),
                                                strict=True):
                if last is not None and last[0] == block and last[4]:
                    continue  # a repeated head
                text = raw.decode("utf-8", "replace")
                marks = winnow(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), k, window)
                if last is not None and last[0] == block:
                    out.append(row(last[1], last[2], last[3], text, marks))
                last = (block, doc_id, text, marks, bool(lead))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, n_marks long")
    return map_batches(with_successor_blocks(docs, blocks), run, schema)
