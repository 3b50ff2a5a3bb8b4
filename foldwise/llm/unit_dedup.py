"""Substring dedup by MinHash banding of content-defined paragraphs.

Texts of any line layout are cut into *units* where their own words say so. Over the words of a text, from
its first to its last line, every pair of neighbouring words has a hash; the least one of every
``START_WINDOW`` consecutive pairs begins a unit, the least one of every ``END_WINDOW`` pairs may end one, and a unit
runs from its start to the first end at least ``MIN_WORDS`` words on. All this depends on the words nearby alone, so any
``PASSAGE_WORDS`` equal words hold a whole equal unit, wherever they stand. Units overlap; they are
``MIN_WORDS`` to ``MIN_WORDS + END_WINDOW`` words long.

Each unit's set of five-word shingles has ``BANDS`` bands of minhashes, tuned for the wanted recall at similarity 0.75.
Band keys that only one unit has are found by a count and dropped before anything else moves. Equal units
(128 bits of hashes of their words, A-Z lower-cased) are one item; items that share a key are verified
by exact Jaccard similarity on full sets and closed to components (:mod:`foldwise.llm.simjoin`). The first unit of a cluster
(by doc_id, text, word) stays, the others are removed, but for units that overlap the one that stays. Units that first
stand over each other in one document share their keys' places; such pairs are not compared.

Uncaught: passages of fewer than ``PASSAGE_WORDS`` words without a whole common unit; up to ``START_WINDOW`` words before
the first and ``END_WINDOW`` after the last unit of a longer one; similar units that share no band key.

Defined results: null and empty texts, and texts of fewer than about ``PASSAGE_WORDS`` words, have no unit; rows with a null id are
left alone; rows that repeat id and text are one document (all stay or lose the same words); different texts of one id
follow each other in the order of their hashes; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (as_bytes, bitmap_of, documents_like, id_bit, in_bitmap, list_array, map_batches, minhash_family, mix64, scratch, signed,
                     unused, written)
from .simjoin import PERCENT, SKETCH, linked_components

SHINGLE = 5
PASSAGE_WORDS = 50
MIN_WORDS = 16
START_WINDOW = 24
#: A start within the first START_WINDOW pairs, an end within END_WINDOW pairs MIN_WORDS on, and the end's own pair.
END_WINDOW = PASSAGE_WORDS - START_WINDOW - MIN_WORDS
MISS = 0.02
N_MINHASHES = 64
#: Every member of a large bucket takes part in the exact completion.
FEW = 0
#: Bytes of texts handled at a time; a longer text stands alone.
PART = 1 << 20
#: 0 for blanks, else 1.
_INSIDE = bytes(x not in b" \t\n\x0b\x0c\r" for x in range(256))
_PLACE = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1]))


def tune_bands(threshold: float = PERCENT / 100, miss: float = MISS, most_rows: int = 3) -> tuple[int, int]:
    """(bands, rows) with the fewest band keys that miss similarity ``threshold`` with at most probability ``miss``."""
    found = []
    for rows in range(1, most_rows + 1):
        bands = 1
        while (1 - threshold**rows) ** bands > miss:
            bands += 1
        found.append((bands, rows))
    return min(found)


BANDS, ROWS = tune_bands()


def _powers(n: int, which: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 (grows with the longest part)
    """Powers of a base and of its inverse, modulo 2^64."""
    if which not in _kept or len(_kept[which][0]) < n:
        made = []
        for x in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(max(n, PART), x, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _kept[which] = tuple(made)
    return _kept[which]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of ranges of a sequence of 64-bit values: equal ranges have equal hashes."""
    power, inverse = _powers(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, power[:len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return key


class Words:
    """Words of several texts: byte ``starts`` and ``ends``, 64-bit hashes, and the text of each."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes  # of each text
        joined = b"\n".join([*texts, b""]).lower()
        self.octets = np.frombuffer(joined, dtype=np.uint8)
        inside = np.frombuffer(b"\0" + joined.translate(_INSIDE) + b"\0", dtype=np.uint8)
        at = np.flatnonzero(inside[1:] != inside[:-1])  # a start, its end, the next start ...
        self.starts, self.ends = at[::2], at[1::2]
        self.hashes = _ranges(_LETTERS.take(self.octets), self.starts, self.ends, 0)
        self.first = np.searchsorted(self.starts, self.begin)  # first word of each text
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.append(self.first, len(self.starts))))

    def _marks(self, key: np.ndarray, window: int) -> np.ndarray:
        """Places of the least key of every ``window`` consecutive pairs of one text (ties: the leftmost)."""
        if len(key) < window:
            return np.empty(0, dtype=np.int64)
        at = np.arange(len(key), dtype=np.uint64)
        least = _least((key & ~_PLACE) | (at & _PLACE), window)
        n = len(least)
        whole = self.text[:n] == self.text[window:window + n]  # of n words there are n - 1 pairs
        first = np.arange(n)[whole]
        place = (least[whole] & _PLACE).astype(np.int64)
        return np.unique(first + (place - first) % (1 << 24))

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end) of every unit."""
        h = self.hashes
        key = mix64(h[:-1] * np.uint64(_BASES[0]) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
        starts, ends = self._marks(key, START_WINDOW), self._marks(key, END_WINDOW)
        if not len(starts) or not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        to = np.searchsorted(ends, starts + MIN_WORDS)
        end = ends[np.minimum(to, len(ends) - 1)]
        ok = (to < len(ends)) & (self.text[end] == self.text[starts])
        return starts[ok], end[ok]

    def shingles(self) -> np.ndarray:
        """Hashes of the ``SHINGLE`` words from every word on."""
        n = len(self.hashes) - SHINGLE + 1
        acc = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(SHINGLE if n > 0 else 0):
            acc = acc * np.uint64(_BASES[0]) + self.hashes[j:n + j]
        return mix64(acc)


def _range_minhashes(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """Minhashes of the shingle sets of units: one row of ``count`` each."""
    out = np.empty((len(starts), count), dtype=np.uint64)
    if len(starts):
        mult, mask = minhash_family(count)
        cut = np.stack([starts, ends - SHINGLE + 1], axis=1).reshape(-1)
        over = cut[-1] == len(shingles)
        for i in range(count):
            x = (shingles ^ mask[i]) * mult[i]
            out[:, i] = np.minimum.reduceat(np.append(x, x[-1]) if over else x, cut)[::2]
    return mix64(out)


def _band_places(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each unit's bands have their least shingles: one number a unit and band, equal for the same places."""
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    if len(starts):
        at = np.arange(len(shingles), dtype=np.uint64) & _PLACE
        mult, mask = minhash_family(BANDS * ROWS)
        cut = np.stack([starts, ends - SHINGLE + 1], axis=1).reshape(-1)
        over = cut[-1] == len(shingles)
        for i in range(BANDS * ROWS):
            x = (((shingles ^ mask[i]) * mult[i]) & ~_PLACE) | at
            place = np.minimum.reduceat(np.append(x, x[-1]) if over else x, cut)[::2] & _PLACE
            out[:, i // ROWS] = out[:, i // ROWS] * np.uint64(_BASES[0]) + place
    return out


def _distinct(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Different shingles of each unit: few units repeat one, so only those are counted one by one."""
    n = ends - starts - SHINGLE + 1
    if len(starts):
        order = np.argsort(shingles, kind="stable")
        before = np.full(len(shingles) + 1, -1)  # the last place with the same shingle
        before[order[1:]] = np.where(shingles[order[1:]] == shingles[order[:-1]], order[:-1], -1)
        cut = np.stack([starts, ends - SHINGLE + 1], axis=1).reshape(-1)
        for i in np.flatnonzero(np.maximum.reduceat(before, cut)[::2] >= starts):
            n[i] = len(np.unique(shingles[starts[i]:ends[i] - SHINGLE + 1]))
    return n


def _band_keys(mins: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of every row of minhashes, the band's number hashed in."""
    m = mins[:, :BANDS * ROWS].reshape(len(mins), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BASES[0]), m.shape[:2])
    for j in range(ROWS):
        acc = mix64(acc ^ m[:, :, j])
    return signed(np.ascontiguousarray(acc))


def _portions(texts: list[bytes]):
    at, total = 0, 0
    for k, x in enumerate(texts):
        if k > at and total + len(x) > PART:
            yield at, texts[at:k]
            at, total = k, 0
        total += len(x)
    if at < len(texts):
        yield at, texts[at:]


PLACE = ["doc_id", "text_hash", "word", "n_words", "start", "n_chars", "byte", "n_bytes"]
_PLACE_TYPES = "doc_id long, text_hash long, word int, n_words int, start int, n_chars int, byte int, n_bytes int"


def _rows(docs: DataFrame) -> DataFrame:
    return as_bytes(documents_like(docs).where("doc_id is not null")).withColumn("text_hash", F.xxhash64("text"))


def band_keys(docs: DataFrame) -> DataFrame:
    """(key): the band keys of all units, once for each place that gives it (units that overlap share such places)."""

    def run(batches):
        for b in batches:
            for _, texts in _portions(b.column("text").to_pylist()):
                w = Words(texts)
                units, shingles = w.units(), w.shingles()
                keys, places = _band_keys(_range_minhashes(shingles, *units, BANDS * ROWS)), _band_places(shingles, *units)
                once = [keys[np.unique(places[:, i], return_index=True)[1], i] for i in range(BANDS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(once), pa.int64())], ["key"])

    return map_batches(_rows(docs).select("text"), run, "key long")


def shared_units(docs: DataFrame, bits: int, keys: np.ndarray) -> DataFrame:
    """Units with a key in the bitmap: place, item and proof (128 bits of their words), n, those keys and the places that give them."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        known = shared.value
        for b in batches:
            ids, ths = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            for base, texts in _portions(b.column("text").to_pylist()):
                w = Words(texts)
                starts, ends = w.units()
                shingles = w.shingles()
                bands, places = _band_keys(_range_minhashes(shingles, starts, ends, BANDS * ROWS)), _band_places(shingles, starts, ends)
                hit = in_bitmap(known, bands & (bits - 1)) if len(bands) else np.zeros((0, BANDS), dtype=bool)
                some = hit.any(axis=1)
                starts, ends, bands, hit = starts[some], ends[some], bands[some], hit[some]
                text = w.text[starts]
                # a place is counted from its text's start, so that it does not depend on the batch
                places = (places[some] - (w.first[text].astype(np.uint64)[:, None] if ROWS == 1 else np.uint64(0))).view(np.int64)
                chars = np.append(0, np.cumsum((w.octets & 0xC0) != 0x80))  # code points before each byte
                at = chars[w.starts[starts]]
                kept = np.append(0, np.cumsum(hit.sum(axis=1)))
                lists = [pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(x[hit], pa.int64())) for x in (bands, places)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[base + text], pa.int64()), pa.array(ths[base + text], pa.int64()), pa.array(starts - w.first[text], pa.int32()),
                     pa.array(ends - starts, pa.int32()), pa.array(at - chars[w.begin[text]], pa.int32()),
                     pa.array(chars[w.ends[ends - 1]] - at, pa.int32()), pa.array(w.starts[starts] - w.begin[text], pa.int32()),
                     pa.array(w.ends[ends - 1] - w.starts[starts], pa.int32()), pa.array(signed(_ranges(w.hashes, starts, ends, 0)), pa.int64()),
                     pa.array(signed(_ranges(w.hashes, starts, ends, 1)), pa.int64()), pa.array(_distinct(shingles, starts, ends), pa.int64()), *lists], [*PLACE, "item", "proof", "n", "bands", "places"])

    return map_batches(_rows(docs), run, f"{_PLACE_TYPES}, item long, proof long, n long, bands array<long>, places array<long>")


def unit_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the items in ``wanted`` (id, doc_id of the first unit): texts are read again, only those sets move."""
    bits, in_docs = bitmap_of(wanted, lambda n: id_bit(F.col("doc_id"), n))
    id_bits, in_items = bitmap_of(wanted, lambda n: F.col("id").bitwiseAND(F.lit(n - 1)))
    shared = docs.sparkSession.sparkContext.broadcast((in_docs, in_items))

    def run(batches):
        for b in batches:
            known_docs, known_items = shared.value
            for _, texts in _portions(b.filter(pa.array(in_bitmap(known_docs, b.column("bit").to_numpy()))).column("text").to_pylist()):
                w = Words(texts)
                starts, ends = w.units()
                item = signed(_ranges(w.hashes, starts, ends, 0))
                some = in_bitmap(known_items, item & (id_bits - 1))
                shingles = w.shingles()
                sets = [signed(np.unique(shingles[s:e - SHINGLE + 1])) for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(item[some], pa.int64()), list_array(sets, pa.int64())], ["id", "set"])

    rows = _rows(docs).withColumn("bit", id_bit(F.col("doc_id"), bits)).select("text", "bit")
    return map_batches(rows, run, "id long, set array<long>").dropDuplicates(["id"]).join(wanted.select("id"), "id")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed unit: doc_id, text_hash, word, n_words, start, n_chars, byte, n_bytes (places in words, code points and
    bytes), keep_doc_id, keep_word (the unit that stays), cluster_size."""
    with scratch():
        occ, kept = _clustered(documents_like(docs, id_col, text_col))
    again = occ.join(kept, "cluster")
    inside = ((F.col("doc_id") == F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
              & (F.col("word") < F.col("keep.word") + F.col("keep.n_words")))
    return again.where(~inside).select(*PLACE, F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.word").alias("keep_word"), "cluster_size")


def _clustered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units in clusters, by cluster of two or more the unit that stays and their number), both kept."""
    keys = band_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    bits, bitmap = bitmap_of(written(keys, "shared-bands"), lambda n: F.col("key").bitwiseAND(F.lit(n - 1)))
    units = written(shared_units(docs, bits, bitmap), "units")
    first = ["doc_id", "proof", "n", "bands", "places"]
    items = (units.groupBy("item").agg(F.min(F.struct(*first)).alias("r"), F.count(F.lit(1)).alias("copies"))
             .select(F.col("item").alias("id"), "copies", *[F.col(f"r.{c}").alias(c) for c in first]))
    items = written(items, "unit-items")

    def sets_of(ids: DataFrame) -> DataFrame:
        return unit_sets(docs, written(items.select("id", "doc_id").join(ids, "id"), "wanted"))

    # units that overlap often have a key of the same place: such keys and pairs say nothing
    table = items.select("id", "doc_id", F.explode(F.arrays_zip("bands", "places")).alias("k")).select(
        F.col("k.bands").alias("key"), "id", F.xxhash64("doc_id", "k.places").alias("component"))
    # units are so short that their sets are verified without a look at sketches first
    flat = items.select("id", "n", *[F.lit(0).cast("long").alias(c) for c in SKETCH])
    comp = linked_components(table, flat, sets_of, N_MINHASHES, FEW)
    named = (items.select("id", "proof", "copies").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .where("component is not null or copies > 1")
             .select(F.col("id").alias("item"), "proof", F.coalesce("component", "id").alias("cluster")))
    occ = written(units.select(*PLACE, "item", "proof").join(written(named, "clusters"), ["item", "proof"]).select(*PLACE, "cluster").distinct(), "occurrences", keep=True)
    keep = occ.groupBy("cluster").agg(F.min(F.struct("doc_id", "text_hash", "word", "n_words")).alias("keep"), F.count(F.lit(1)).alias("cluster_size"))
    return occ, written(keep.where("cluster_size > 1"), "kept-units", keep=True)


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans (start, end), which may overlap; blanks after a span go, and a line that it leaves empty."""
    out, at = b"", 0
    for a, e in sorted(spans):
        if e <= at:
            continue
        if a > at:
            out += raw[at:a]
        at = e
        while raw[at:at + 1] in (b" ", b"\t"):
            at += 1
        if raw[at:at + 1] == b"\n" and out[-1:] in (b"", b"\n"):
            at += 1
    return out + raw[at:]


def without_repeated_units(docs: DataFrame) -> DataFrame:
    """``docs`` with the units of :func:`repeated_units` cut out of ``text``; ``n_chars`` is counted anew for texts that change."""
    columns = docs.columns
    own, gone_id, gone_text, spans = unused(docs, "_own", "_gone", "_gone_text", "_spans")
    with scratch():
        cut = repeated_units(docs).groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)).agg(
            F.collect_set(F.struct("byte", "n_bytes")).alias(spans))  # one document's units
        cut = written(cut, "unit-spans", keep=True)
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary")))

    def run(batches):
        for b in batches:
            at = b.column(spans).to_pylist()
            keep = b.select(columns)
            if any(at):
                new = [_cut(t, [(s["byte"], s["byte"] + s["n_bytes"]) for s in a]) if a else t
                       for t, a in zip(b.column("text").cast(pa.binary()).to_pylist(), at, strict=True)]
                changed = {"text": pa.array(new, pa.binary()).cast(b.column("text").type, safe=False)}
                if "n_chars" in columns:
                    old = b.column("n_chars")
                    changed["n_chars"] = pa.array([len(t.decode("utf-8", "replace")) if a else o for t, a, o in zip(new, at, old.to_pylist(), strict=True)], old.type)
                keep = pa.RecordBatch.from_arrays([changed.get(c, b.column(c)) for c in columns], columns)
            yield keep

    joined = rows.join(cut, (rows["doc_id"] == cut[gone_id]) & (rows[own] == cut[gone_text]), "left")
    return map_batches(joined.select(*[rows[c] for c in columns], spans), run, docs.schema)
