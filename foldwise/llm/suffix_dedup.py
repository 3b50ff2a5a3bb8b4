"""Substring dedup over a logarithmic family of suffix arrays.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (in a smaller
document, or earlier in the same one) is removed; strings are judged on the input.

1. *Copies.* Of equal texts only the first is searched; the others go whole.
2. *Runs.* Each window of ``LENGTH`` bytes belongs to its least ``GRAM``-byte gram (by hash, then
   the leftmost), so equal windows have equal grams at equal places. Consecutive
   windows of one gram occurrence are a run, about 35 of them; runs of grams that stand
   only once in the corpus share no window and are dropped before anything else moves.
3. *Equal runs* (128 bits of hashes) after the first one go whole.
4. *Index family.* The first of each group of equal runs goes, with its bytes, to a bucket of its
   gram's hash. There runs come in document order, in batches: each batch gets an array of its
   windows in the order of their bytes; the array is merge-scanned against those of the
   existing levels; windows found there, or before in the batch, are repeats, the others form a new
   level, and levels of equal size merge, so their sizes grow geometrically. Bytes
   are compared, not hashes. Buckets hold ``BUCKET_RUNS`` runs on average.
5. *Crowded grams*, of more than ``MOST_RUNS`` different runs, are too much for one bucket. Their
   windows are compared by 128 bits of hashes in an aggregation that combines before it shuffles.

Nothing is collected but a bitmap of bounded size, which only spares work; a task holds
one bucket. All tables lie in the shared folder.

Defined results: a null text counts as empty; texts shorter than a window stay whole; rows
with a null id are left alone and no other row is judged by them; rows that repeat id
and text are one document (all stay or lose the same bytes), different texts of one id
follow each other in the order of their hashes; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bitmap_of, documents_like, id_bit, in_bitmap, map_batches, mix64, signed, written

LENGTH = 100
GRAM = 32
BUCKET_RUNS = 8192
MOST_RUNS = 32768
BATCH_RUNS = 1024
#: Bytes handled at a time; a longer text is cut into overlapping parts.
PART = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASES = [(0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB)]


class _Rolling:
    """Hashes of substrings of a byte sequence: a polynomial over the bytes' random values, modulo 2^64."""

    _tables: dict = {}

    def __init__(self, octets: np.ndarray, which: int):
        base, seed = _BASES[which]
        power, inverse, value = self._table(which, base, seed, len(octets) + 1)
        self.inverse = inverse
        self.sums = np.zeros(len(octets) + 1, dtype=np.uint64)
        np.cumsum(value[octets] * power[:len(octets)], out=self.sums[1:])

    @classmethod
    def _table(cls, which: int, base: int, seed: int, n: int):
        have = cls._tables.get(which)
        if have is None or len(have[0]) < n:
            n = max(n, PART + LENGTH)
            powers = []
            for x in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, x, dtype=np.uint64)
                p[0] = 1
                powers.append(np.cumprod(p, dtype=np.uint64))
            value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
            cls._tables[which] = have = (*powers, value)
        return have

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[at + size] - self.sums[at]) * self.inverse[at])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return key


def _part_runs(octets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, gram, digest) of the runs of a byte sequence; ``valid``: places where a window may start."""
    n = len(octets) - LENGTH + 1
    if n <= 0 or not valid[:n].any():
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    gram = _Rolling(octets, 0).of(np.arange(len(octets) - GRAM + 1), GRAM)
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_least(key, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    ok = valid[:n]
    begin = ok & np.append(True, (anchor[1:] != anchor[:-1]) | ~ok[:-1])
    start = np.flatnonzero(begin)
    windows = np.bincount(np.cumsum(begin)[ok] - 1, minlength=len(start))
    digest = _Rolling(octets, 1).of(start, windows + LENGTH - 1)
    return start, windows, signed(gram[anchor[start]]), signed(digest)


def text_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, at, windows, gram, digest) of the runs of all texts."""
    found = []

    def add(first: int, group: list[bytes]) -> None:
        sizes = np.array([len(x) for x in group])
        begin = np.cumsum(sizes) - sizes
        octets = np.frombuffer(b"".join(group), dtype=np.uint8)
        valid = np.zeros(len(octets), dtype=bool)
        for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            valid[b:max(b, b + n - LENGTH + 1)] = True
        for lo in range(0, len(octets), PART):
            hi = min(lo + PART, len(octets))
            start, windows, gram, digest = _part_runs(octets[lo:hi + LENGTH - 1], valid[lo:hi])
            if len(start):
                which = np.searchsorted(begin, start + lo, side="right") - 1
                found.append((which + first, start + lo - begin[which], windows, gram, digest))

    at, total = 0, 0
    for k, x in enumerate(texts):
        if k > at and total + len(x) > PART:
            add(at, texts[at:k])
            at, total = k, 0
        total += len(x)
    if at < len(texts):
        add(at, texts[at:])
    return tuple(np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(5))


class SuffixFamily:
    """Windows seen so far, in sorted arrays whose sizes grow geometrically."""

    def __init__(self):
        self.octets = np.empty(0, dtype=np.uint8)
        self.levels: list[tuple[int, np.ndarray]] = []  # (batches, places of distinct windows in byte order), smaller ones last

    def _bytes_at(self, places: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.octets, LENGTH)[places].view(f"S{LENGTH}").reshape(-1)

    @staticmethod
    def _found(level: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which windows of the sorted ``wanted`` stand in the sorted ``level``."""
        at = np.searchsorted(level, wanted)
        return (level[np.minimum(at, len(level) - 1)] == wanted) & (at < len(level))

    def add(self, octets: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which windows at ``places`` of a new batch stood before, in earlier batches or earlier places."""
        places = places + len(self.octets)
        self.octets = np.concatenate([self.octets, octets])
        windows = self._bytes_at(places)
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        before = np.append(False, ordered[1:] == ordered[:-1])
        for _, level in self.levels:
            before |= self._found(self._bytes_at(level), ordered)
        self._push(1, places[order[~before]])
        out = np.empty(len(places), dtype=bool)
        out[order] = before
        return out

    def _push(self, batches: int, fresh: np.ndarray) -> None:
        while self.levels and self.levels[-1][0] == batches:
            _, level = self.levels.pop()
            into = np.searchsorted(self._bytes_at(level), self._bytes_at(fresh))
            fresh = np.insert(level, into, fresh)
            batches *= 2
        if len(fresh):
            self.levels.append((batches, fresh))


def _intervals(marked: np.ndarray, run: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(run, first offset, end in bytes) of stretches of marked windows."""
    go = marked & ~np.append(False, marked[:-1] & (run[1:] == run[:-1]))
    end = marked & ~np.append(marked[1:] & (run[1:] == run[:-1]), False)
    for a, b in zip(np.flatnonzero(go).tolist(), np.flatnonzero(end).tolist(), strict=True):
        yield int(run[a]), int(offset[a]), int(offset[b]) + LENGTH


def bucket_repeats(raws: list[bytes]) -> list[tuple[int, int, int]]:
    """(run, start, end in its bytes) of what repeats in the runs' bytes, given in document order."""
    family, out = SuffixFamily(), []
    for lo in range(0, len(raws), BATCH_RUNS):
        batch = raws[lo:lo + BATCH_RUNS]
        sizes = np.array([len(x) for x in batch])
        count = sizes - LENGTH + 1
        run = np.repeat(np.arange(len(batch)), count)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        marked = family.add(np.frombuffer(b"".join(batch), dtype=np.uint8), (np.cumsum(sizes) - sizes)[run] + offset)
        out.extend((r + lo, a, e) for r, a, e in _intervals(marked, run, offset))
    return out


DOC = ["doc_id", "text_hash"]
_DOC_TYPES = "doc_id long, text_hash long"


def _runs_of(docs: DataFrame, wanted: np.ndarray | None, bits: int, first: tuple[int, np.ndarray]) -> DataFrame:
    """Runs of the documents in the bitmap ``first``: their grams; with ``wanted``, a bitmap of grams, the runs of
    those: doc_id, text_hash, at, windows, gram, digest. A later equal run of the same document has a null gram:
    it is a repeat."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, first[1]))

    def run(batches):
        grams, searched = shared.value
        for b in batches:
            b = b.filter(pa.array(in_bitmap(searched, b.column("bit").to_numpy())))
            text, at, windows, gram, digest = text_runs(b.column("text").to_pylist())
            if grams is not None:
                keep = in_bitmap(grams, gram & (bits - 1))
                text, at, windows, gram, digest = (x[keep] for x in (text, at, windows, gram, digest))
            order = np.lexsort((digest, gram, text))  # stable: the first of a document's equal runs comes first
            again = np.zeros(len(text), dtype=bool)
            again[order[1:]] = np.all([x[order[1:]] == x[order[:-1]] for x in (text, gram, digest)], axis=0)
            if grams is None:
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64())], ["gram"])  # those of `again` too: they repeat
                continue
            doc = [b.column(c).to_numpy()[text] for c in DOC]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in doc), pa.array(at, pa.int32()), pa.array(windows, pa.int32()),
                 pa.array(gram, pa.int64(), mask=again), pa.array(digest, pa.int64())], [*DOC, "at", "windows", "gram", "digest"])

    rows = docs.withColumn("bit", id_bit(F.col("doc_id"), first[0])).select(*DOC, "text", "bit")
    return map_batches(rows, run, "gram long" if wanted is None else f"{_DOC_TYPES}, at int, windows int, gram long, digest long")


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` runs (doc_id, text_hash, at, windows, gram, kinds) with their bytes."""
    per_doc = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("at", "windows", "gram", "kinds")).alias("runs"))  # one document's
    bits, bitmap = bitmap_of(per_doc, lambda n: id_bit(F.col("doc_id"), n))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def known(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, b.column("bit").to_numpy()))).select([*DOC, "text"])

    def cut(batches):
        for b in batches:
            out = []
            for i, th, raw, runs in zip(*(b.column(c).to_pylist() for c in (*DOC, "text", "runs")), strict=True):
                out.extend((i, th, r["at"], r["gram"], r["kinds"], raw[r["at"]:r["at"] + r["windows"] + LENGTH - 1]) for r in runs)
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             [*DOC, "at", "gram", "kinds", "raw"])

    rows = docs.withColumn("bit", id_bit(F.col("doc_id"), bits)).select(*DOC, "text", "bit")
    texts = map_batches(rows, known, f"{_DOC_TYPES}, text binary").dropDuplicates(DOC)
    return map_batches(texts.join(per_doc, DOC).select(*DOC, "text", "runs"), cut,
                       f"{_DOC_TYPES}, at int, gram long, kinds long, raw binary")


def _index_repeats(runs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text_hash, start, end of what the index family finds in runs with bytes."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*DOC, "at")])
        found = np.array(bucket_repeats(table.column("raw").to_pylist()), dtype=np.int64).reshape(-1, 3)
        rows = table.take(pa.array(found[:, 0]))
        at = rows.column("at").to_numpy()
        return pa.table({"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"),
                         "start": pa.array(at + found[:, 1], pa.int64()), "end": pa.array(at + found[:, 2], pa.int64())})

    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    return runs.select(bucket, *DOC, "at", "raw").groupBy("bucket").applyInArrow(find, f"{_DOC_TYPES}, start long, end long")


def _crowded_repeats(runs: DataFrame) -> DataFrame:
    """The same by hashes of windows, for grams with too many runs for a bucket."""

    def windows(batches):
        for b in batches:
            raws = b.column("raw").to_pylist()
            count = np.array([len(x) - LENGTH + 1 for x in raws], dtype=np.int64)
            run = np.repeat(np.arange(len(raws)), count)
            offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            octets = np.frombuffer(b"".join(raws), dtype=np.uint8)
            place = (np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1))[run] + offset
            halves = [signed(_Rolling(octets, i).of(place, LENGTH)) for i in (0, 1)]
            doc = [b.column(c).to_numpy()[run] for c in (*DOC, "at")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*doc[:2], doc[2] + offset, *halves)],
                                             [*DOC, "start", "h1", "h2"])

    rows = written(map_batches(runs.select(*DOC, "at", "raw"), windows, f"{_DOC_TYPES}, start long, h1 long, h2 long"), "crowded")
    place = F.struct(*DOC, "start")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    return (rows.join(first, ["h1", "h2"]).where(place != F.col("first"))
            .select(*DOC, "start", (F.col("start") + LENGTH).alias("end")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_runs: int = MOST_RUNS) -> DataFrame:
    """One row per document that loses bytes: doc_id, text_hash, spans (start, end in bytes; they may overlap)."""
    docs = as_bytes(documents_like(docs, id_col, text_col).where("doc_id is not null")).withColumn("text_hash", F.xxhash64("text"))
    sized = docs.select(*DOC, F.md5("text").alias("proof"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    first = written(sized.groupBy("text_hash", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "first-texts")
    copies = (sized.join(first.where("first <> last").select("text_hash", "proof", "first"), ["text_hash", "proof"])
              .where("doc_id <> first").select(*DOC, F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")).distinct())
    ids = first.select(F.col("first").alias("doc_id"))
    bits, bitmap = bitmap_of(ids, lambda n: id_bit(F.col("doc_id"), n))
    searched = (bits, bitmap)

    grams = _runs_of(docs, None, 0, searched).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    grams = written(grams, "shared-grams")
    gram_bits, wanted = bitmap_of(grams, lambda n: F.col("gram").bitwiseAND(F.lit(n - 1)))
    runs = written(_runs_of(docs, wanted, gram_bits, searched), "runs")
    inside = runs.where("gram is null").select(*DOC, F.col("at").cast("long").alias("start"),
                                               (F.col("at") + F.col("windows") + (LENGTH - 1)).cast("long").alias("end"))
    runs = runs.where("gram is not null")
    place = F.struct(*DOC, "at")
    one = written(runs.groupBy("gram", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"),
                                                     F.max("windows").alias("windows")), "first-runs")
    again = (runs.join(one.where("first <> last").select("gram", "digest", "first"), ["gram", "digest"]).where(place != F.col("first"))
             .select(*DOC, F.col("at").cast("long").alias("start"),
                     (F.col("at") + F.col("windows") + (LENGTH - 1)).cast("long").alias("end")))
    several = one.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    different = written(one.join(several, "gram").select("first.*", "windows", "gram", "kinds"), "different-runs")
    raws = written(_with_bytes(docs, different), "run-bytes")
    total, crowded = raws.agg(F.count(F.lit(1)), F.max("kinds")).first()
    buckets = max(1, -(-total // BUCKET_RUNS))
    found = _index_repeats(raws.where(F.col("kinds") <= most_runs), buckets)
    if (crowded or 0) > most_runs:
        found = found.union(_crowded_repeats(raws.where(F.col("kinds") > most_runs)))
    spans = copies.union(inside).union(again).union(found)
    return spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # one document's


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint, not touching (start, end), ascending."""
    out: list[tuple[int, int]] = []
    for a, e in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_runs: int = MOST_RUNS) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of the maximal removed runs), kept (binary: the other bytes)."""
    spans = written(repeated_spans(docs, id_col, text_col, most_runs), "spans")
    bits, bitmap = bitmap_of(spans, lambda n: id_bit(F.col("doc_id"), n))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = as_bytes(documents_like(docs, id_col, text_col)).withColumn("text_hash", F.xxhash64("text")).withColumn(
        "bit", F.when(F.col("doc_id").isNotNull(), id_bit(F.col("doc_id"), bits)))
    schema = f"{_DOC_TYPES}, text binary"

    def part(touched: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                bit = b.column("bit").to_pandas()
                hit = bit.notna().to_numpy() & in_bitmap(shared.value, bit.fillna(0).to_numpy(dtype=np.int64))
                yield b.filter(pa.array(hit == touched)).select([*DOC, "text"])

        return map_batches(rows, run, schema)

    def cut(batches):
        for b in batches:
            sizes, all_spans, kept = [], [], []
            for raw, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                gone = _joined(spans or [])
                ends = [0, *(e for _, e in gone)]
                kept.append(b"".join(raw[a:e] for a, e in zip(ends, [*(s for s, _ in gone), len(raw)], strict=True)))
                sizes.append(len(raw))
                all_spans.append([{"start": a, "end": e} for a, e in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_spans, kind),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = part(True).join(spans, DOC, "left").select("doc_id", "text", "spans")
    whole = part(False).select("doc_id", "text", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"))
    return map_batches(joined.union(whole), cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def cut_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_repeats(docs).select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                    F.sha2("kept", 256).alias("kept_sha256"))
