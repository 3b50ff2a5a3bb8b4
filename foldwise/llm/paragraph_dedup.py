"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are lines of at least ``min_words`` words. Bands of minhashes over their
five-word shingles are the table keys; ``tune_bands`` finds the fewest minhashes
that miss a pair of the wanted similarity with at most the wanted probability.
Colliding paragraphs are verified by exact Jaccard similarity on full shingle sets
and clustered as connected components; the first paragraph of each cluster (by
doc_id, then line) stays, the others are removals.

Equal paragraphs (after lower-casing A-Z, in words) are one item. An item is named
by 64 bits of its hash; occurrences whose further 64 bits differ from the item's
first one are left alone.

Passages are looked for whatever the line layout, over a text's words from its first
to its last line. Of the hashes of all runs of ``GRAM`` words the least of every
``GRAM_WINDOW`` consecutive ones is a mark, so any ``PASSAGE_WORDS`` equal words hold
an equal mark. The first place of a mark (by doc_id, text, word) stays, the others
are cut, within one document too; overlapping cuts are one span. Equal runs of ``GRAM``
to ``PASSAGE_WORDS`` - 1 words go where they hold a mark. Marks are named by 128 bits of hashes of
their words. Uncaught: passages in which a changed word leaves no ``PASSAGE_WORDS``
equal words in a row (unless they are near-equal lines), up to ``GRAM_WINDOW`` - 1 words
at either end of a passage, and runs that only come together where a span was cut.

Defined results: null and empty texts have no paragraphs; rows with a null id are
left alone; rows that repeat id and text are one document (all stay or lose the
same lines); of different texts of one id each line is judged by itself; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHash, as_bytes, bitmap_of, documents_like, id_bit, in_bitmap, list_array,
                     map_batches, minhashes, mix64, shingle_hashes, signed, worker_state, written)
from .simjoin import PERCENT, SKETCH, linked_components, sketch_words

MIN_WORDS = 20
MISS = 5e-5
#: Meeting in 2 of the 12 bands and nowhere else has probability (1 - 0.75^2)^10, 3e-4, at similarity 0.75.
FEW = 2
#: Every run of so many equal words is found, as GRAM + GRAM_WINDOW - 1 words are a window of runs.
PASSAGE_WORDS = 50
GRAM = 26
GRAM_WINDOW = PASSAGE_WORDS - GRAM + 1
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def tune_bands(threshold: float = PERCENT / 100, miss: float = MISS, most_rows: int = 3) -> tuple[int, int]:
    """(bands, rows) with the fewest minhashes, of at least two rows, that miss similarity ``threshold`` rarely enough."""
    found = []
    for rows in range(2, most_rows + 1):
        bands = 1
        while (1 - threshold**rows) ** bands > miss:
            bands += 1
        found.append((bands * rows, bands, rows))
    return min(found)[1:]


BANDS, ROWS = tune_bands()
#: Minhashes behind a sketch: the bands' and as many more as its words hold.
N_MINHASHES = max(64, BANDS * ROWS)


def _hasher() -> WordHash:
    return worker_state("paragraph-words", WordHash)


def _names(norm: list[bytes]) -> tuple[list[int], list[int]]:
    """Two signed 64-bit halves of the hashes of normalised paragraphs."""
    both = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in norm], dtype=np.uint64).reshape(-1, 2)
    return both[:, 1].astype(np.uint64).view(np.int64), both[:, 0].astype(np.uint64).view(np.int64)


def _lines(raw: bytes, min_words: int):
    """(line, start, n_chars, words) of each paragraph; places in code points."""
    start = 0
    for i, line in enumerate(raw.split(b"\n")):
        n_chars = len(line.decode("utf-8", "replace"))
        ws = line.lower().split()
        if len(ws) >= min_words:
            yield i, start, n_chars, ws
        start += n_chars + 1


def _band_keys(mins: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of every row of minhashes, the band's number hashed in."""
    m = mins[:, :BANDS * ROWS].reshape(len(mins), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), m.shape[:2])
    for j in range(ROWS):
        acc = mix64(acc ^ m[:, :, j])
    return signed(acc)


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph: doc_id, text_hash, line, start, n_chars, n_words, item, proof, n, bands, s0..s3."""
    places = ["doc_id", "text_hash", "line", "start", "n_chars", "n_words"]

    def run(batches):
        h = _hasher()
        for b in batches:
            out, norm, sets = [], [], []
            for doc_id, th, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                for i, start, n_chars, ws in _lines(raw, min_words):
                    out.append((doc_id, th, i, start, n_chars, len(ws)))
                    norm.append(b" ".join(ws))
                    sets.append(shingle_hashes(h.of(ws)))
            item, proof = _names(norm)
            mins = minhashes(sets, N_MINHASHES)
            sk = [sketch_words(m) for m in mins]
            cols = list(zip(*out, strict=True)) or [()] * len(places)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(item, pa.int64()),
                 pa.array(proof, pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                 list_array(list(_band_keys(mins)), pa.int64()), *[pa.array([x[i] for x in sk], pa.int64()) for i in range(4)]],
                [*places, "item", "proof", "n", "bands", *SKETCH])

    rows = as_bytes(documents_like(docs).where("doc_id is not null")).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, line int, start int, n_chars int, n_words int, item long, "
                                  "proof long, n long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def item_sets(docs: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, set) of the items in ``wanted`` (id, doc_id of the first occurrence): texts are read
    again, and of them only those documents' paragraphs with those items move."""
    bits, in_docs = bitmap_of(wanted, lambda n: id_bit(F.col("doc_id"), n))
    id_bits, in_items = bitmap_of(wanted, lambda n: F.pmod("id", F.lit(n)))
    shared = docs.sparkSession.sparkContext.broadcast((in_docs, in_items))

    def run(batches):
        h = _hasher()
        for b in batches:
            known_docs, known_items = shared.value
            ids, sets = [], []
            for raw in b.filter(pa.array(in_bitmap(known_docs, b.column("bit").to_numpy()))).column("text").to_pylist():
                lines = [ws for *_, ws in _lines(raw, min_words)]
                item, _ = _names([b" ".join(ws) for ws in lines])
                for i in np.flatnonzero(in_bitmap(known_items, (item & (id_bits - 1)))):
                    ids.append(item[i])
                    sets.append(signed(shingle_hashes(h.of(lines[i]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(sets, pa.int64())], ["id", "set"])

    rows = as_bytes(documents_like(docs).where("doc_id is not null")).withColumn("bit", id_bit(F.col("doc_id"), bits))
    found = map_batches(rows.select("text", "bit"), run, "id long, set array<long>")
    return found.dropDuplicates(["id"]).join(wanted.select("id"), "id")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed paragraph: doc_id, text_hash, line, start, n_chars, n_words (places in
    code points), keep_doc_id, keep_line (the cluster's first paragraph), cluster_size."""
    docs = documents_like(docs, id_col, text_col)
    para = written(paragraphs(docs, min_words), "paragraphs")
    first = ["doc_id", "line", "proof", "n", "bands", *SKETCH]
    items = (para.groupBy("item").agg(F.min(F.struct(*first)).alias("r"), F.count(F.lit(1)).alias("copies"))
             .select(F.col("item").alias("id"), "copies", *[F.col(f"r.{c}").alias(c) for c in first]))
    items = written(items, "paragraph-items")

    def sets_of(ids: DataFrame) -> DataFrame:
        return item_sets(docs, written(items.select("id", "doc_id").join(ids, "id"), "wanted"), min_words)

    keys = items.select(F.explode("bands").alias("key"), "id", F.col("id").alias("component"))
    comp = linked_components(keys, items.select("id", "n", *SKETCH), sets_of, N_MINHASHES, FEW)
    # clusters of one paragraph remove nothing: only the others are joined with the paragraphs
    named = (items.select("id", "proof", "copies").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .where("component is not null or copies > 1")
             .select(F.col("id").alias("item"), "proof", F.coalesce("component", "id").alias("cluster")))
    named = written(named, "clusters")
    place = ["doc_id", "text_hash", "line", "start", "n_chars", "n_words"]
    occ = written(para.select(*place, "item", "proof").join(named, ["item", "proof"]).select(*place, "cluster"), "occurrences")
    keep = written(occ.groupBy("cluster").agg(F.min(F.struct("doc_id", "line")).alias("keep"),
                                              F.count(F.lit(1)).alias("cluster_size")), "kept-paragraphs")
    return (occ.join(keep, "cluster").where(F.struct("doc_id", "line") != F.col("keep"))
            .select(*place, F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), "cluster_size"))


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, two 64-bit halves of the name) of the marks of a text's word hashes."""
    n = len(hashes) - GRAM + 1
    if n < GRAM_WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    halves = []
    for mult in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        acc = np.zeros(n, dtype=np.uint64)
        for j in range(GRAM):
            acc = acc * mult + hashes[j:n + j]
        halves.append(mix64(acc))
    windows = np.lib.stride_tricks.sliding_window_view(halves[0], GRAM_WINDOW)[:, ::-1]  # ties: the rightmost
    at = np.unique(np.arange(len(windows)) + GRAM_WINDOW - 1 - windows.argmin(axis=1))
    return at, signed(halves[0][at]), signed(halves[1][at])


def passage_marks(docs: DataFrame) -> DataFrame:
    """One row per mark: doc_id, text_hash, word (its place), mark, proof."""

    def run(batches):
        h = _hasher()
        for b in batches:
            found = [_marks(h.of(raw.lower().split())) for raw in b.column("text").to_pylist()]
            sizes = [len(x[0]) for x in found]
            word, mark, proof = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in found)]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat(b.column(c).to_numpy(), sizes), pa.int64()) for c in ("doc_id", "text_hash")),
                 pa.array(word, pa.int32()), pa.array(mark, pa.int64()), pa.array(proof, pa.int64())],
                ["doc_id", "text_hash", "word", "mark", "proof"])

    rows = as_bytes(documents_like(docs).where("doc_id is not null")).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, word int, mark long, proof long")


def _repeated_marks(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _at): by document the places of its marks that stand earlier too, and where the first one is."""
    marks = written(passage_marks(docs), "marks")
    place = F.struct("doc_id", "text_hash", "word")
    first = (marks.groupBy("mark", "proof").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first <> last").drop("last"))
    again = marks.join(written(first, "first-marks"), ["mark", "proof"]).where(place != F.col("first"))
    at = F.struct("word", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.word").alias("keep_word"))
    return written(again.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
                   .agg(F.collect_set(at).alias("_at")), "repeated-marks")  # bounded by one document's words


def _places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a text's words in bytes."""
    inside = np.concatenate([[False], ~_BLANK[np.frombuffer(raw, dtype=np.uint8)], [False]]).astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _spans(words: list[int]) -> list[tuple[int, int]]:
    """(first word, end) of the joined runs that begin at ``words``."""
    out: list[tuple[int, int]] = []
    for w in sorted(words):
        if out and w <= out[-1][1]:
            out[-1] = (out[-1][0], w + GRAM)
        else:
            out.append((w, w + GRAM))
    return out


def _cut(raw: bytes, words: list[int]) -> bytes:
    """The text without the runs that begin at ``words``; blanks after a span go, and a line that it leaves empty."""
    starts, ends = _places(raw)
    out, at = b"", 0
    for a, e in _spans(words):
        out += raw[at:starts[a]]
        at = int(ends[e - 1])
        while raw[at:at + 1] in (b" ", b"\t"):
            at += 1
        if raw[at:at + 1] == b"\n" and out[-1:] in (b"", b"\n"):
            at += 1
    return out + raw[at:]


def _n_chars(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


def _with_marks(docs: DataFrame, text_col: str, how: str) -> DataFrame:
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    gone = _repeated_marks(docs.select("doc_id", docs[text_col].alias("text")))
    return docs.withColumn("_h", F.xxhash64(raw)).join(
        gone, (docs["doc_id"] == F.col("_id")) & (F.col("_h") == F.col("_hash")), how)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per cut span: doc_id, text_hash, word, n_words, start, n_chars (places in words and
    code points), keep_doc_id, keep_word (where the words of the span's first mark stay)."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, th, raw, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_hash", "text", "_at")), strict=True):
                starts, ends = _places(raw)
                first = {x["word"]: (x["keep_doc_id"], x["keep_word"]) for x in at}
                for a, e in _spans(list(first)):
                    out.append((doc_id, th, a, e - a, _n_chars(raw[:starts[a]]), _n_chars(raw[starts[a]:ends[e - 1]]), *first[a]))
            names = ["doc_id", "text_hash", "word", "n_words", "start", "n_chars", "keep_doc_id", "keep_word"]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = _with_marks(documents_like(docs, id_col, text_col), "text", "inner")
    return map_batches(as_bytes(rows).select("doc_id", "_hash", "text", "_at"), run,
                       "doc_id long, text_hash long, word int, n_words int, start int, n_chars int, keep_doc_id long, keep_word int")


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of :func:`repeated_passages` cut out of ``text``; ``n_chars`` is counted anew for texts that change."""
    columns = docs.columns

    def run(batches):
        for b in batches:
            at = b.column("_at").to_pylist()
            keep = b.select(columns)
            if any(at):
                raw = [_cut(x, [m["word"] for m in a]) if a else x
                       for x, a in zip(b.column("text").cast(pa.binary()).to_pylist(), at, strict=True)]
                new = {"text": pa.array(raw, pa.binary()).cast(b.column("text").type, safe=False)}
                if "n_chars" in columns:
                    old = b.column("n_chars")
                    n = [_n_chars(x) if a else o for x, a, o in zip(raw, at, old.to_pylist(), strict=True)]
                    new["n_chars"] = pa.array(n, old.type)
                keep = pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], columns)
            yield keep

    return map_batches(_with_marks(docs, "text", "left").select(*columns, "_at"), run, docs.schema)


def without_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with removed paragraphs' lines cut out of ``text``; ``n_chars`` is counted anew for texts that change."""
    gone = (repeated_paragraphs(docs, min_words=min_words).distinct()
            .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
            .agg(F.collect_set("line").alias("_lines")))  # bounded by one document's lines
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    lines = F.split("text", "\n", -1)
    cut = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains("_lines", i)))
    joined = docs.withColumn("_h", F.xxhash64(raw)).join(
        gone, (docs["doc_id"] == F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(cut)
    return joined.select(*[text.alias("text") if c == "text" else
                           F.when(F.col("_lines").isNull(), F.col("n_chars")).otherwise(F.char_length(cut)).cast("long").alias("n_chars")
                           if c == "n_chars" else F.col(c) for c in docs.columns])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without removed paragraphs' lines, then without repeated passages of any line layout."""
    return without_passages(written(without_lines(docs, min_words), "lines-cut"))
