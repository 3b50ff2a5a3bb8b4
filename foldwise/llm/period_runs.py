"""Periodic runs of words by recompression.

A run is a stretch of consecutive words of smallest period q, at least
``max(MIN_WORDS, 3 q)`` words long, that no neighbouring word extends. The texts of an
Arrow batch are one sequence of word numbers with a separator of its own kind after
each text, and recompression turns that sequence into a run-length grammar: block
compression replaces every stretch a a ... a by one symbol (a, length), then pair compression splits the
symbols into a left and a right half and replaces each pair left-right by one
symbol, in turns until every text is one symbol. Equal stretches are parsed alike
but for their ends, so the longest common extension of two places climbs the levels
while both stand at symbol starts, and comes down to the word where they differ:
a few steps a level, for all queries of a batch at once.

Every run of period q holds two points of the grid 0, q, 2q, ... of its text; all
grid pairs (g, g + q) with q up to a third of the text are candidates, n log n of
them. Those whose first ``PROBE`` words differ pair by pair cannot lie in a run (from the first grid
pair of a run more equal words follow) and are left out; for the others the
extensions of the sequence and of its mirror image give the exact run. Of
equal stretches the smallest period stays.

Memory: a batch is cut where its texts exceed ``BATCH_WORDS`` words, a longer text
stands alone; grid pairs are made ``GRID`` at a time.

Defined results: null and empty texts, and texts without words, have no run; a null id
counts as the empty id where ids matter (:func:`plant_repeats`); repeated ids are
judged row by row; an empty table gives no rows; further columns are not read.
Words are compared byte by byte, without lower-casing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents_like, map_batches, mix64

MIN_WORDS = 24
MIN_EXPONENT = 3
BATCH_WORDS = 200_000
GRID = 2_000_000
#: From the first grid pair of a run at least so many equal words follow: 25 - 2q for q <= 8, q + 1 beyond.
PROBE = 9


class RunLengthGrammar:
    """Levels of block and pair compression over a sequence of symbols, and longest common extensions.

    ``parent[t]`` maps the symbols' places of level t to the places of level t + 1 and
    ``start[t]`` the places of level t + 1 back to their first place on level t. The last symbol
    and every negative one stand alone: they equal no other symbol.
    """

    def __init__(self, seq: np.ndarray):
        self.symbols = [seq]
        self.starts: list[np.ndarray] = []
        self.parents: list[np.ndarray] = []
        self.blocks: list[bool] = []
        fresh = int(seq.max(initial=0)) + 1
        texts = int((seq < 0).sum())
        turn = 0
        while len(self.symbols[-1]) > 2 * texts and turn < 128:
            fresh = self._level(self._block_starts(), fresh, True)
            fresh = self._level(self._pair_starts(turn), fresh, False)
            turn += 1

    def _block_starts(self) -> np.ndarray:
        s = self.symbols[-1]
        return np.flatnonzero(np.append(True, s[1:] != s[:-1]))

    def _pair_starts(self, turn: int) -> np.ndarray:
        s = self.symbols[-1]
        left = (mix64((s.astype(np.uint64) << np.uint64(7)) + np.uint64(turn)) & np.uint64(1)).astype(bool)
        real = s >= 0
        both = real[:-1] & real[1:]
        halves = [left[:-1] & ~left[1:] & both, ~left[:-1] & left[1:] & both]
        second = np.append(False, halves[0] if halves[0].sum() >= halves[1].sum() else halves[1])
        return np.flatnonzero(~second)

    def _level(self, start: np.ndarray, fresh: int, block: bool) -> int:
        """Add the level whose symbols begin at ``start``; the next unused symbol."""
        s = self.symbols[-1]
        size = np.diff(start, append=len(s))
        first, last = s[start], s[start + size - 1]
        made = size > 1
        key = np.stack([first[made], size[made] if block else last[made]], axis=1)
        new = first.copy()
        if len(key):
            _, which = np.unique(key[:, 0] * (key[:, 1].max() + 1) + key[:, 1], return_inverse=True)
            new[made] = fresh + which.reshape(-1)
            fresh += int(which.max()) + 1
        parent = np.cumsum(np.bincount(start, minlength=len(s))) - 1
        self.symbols.append(new)
        self.starts.append(start)
        self.parents.append(parent)
        self.blocks.append(block)
        return fresh

    def _run_left(self, level: int, at: np.ndarray) -> np.ndarray:
        """Places from ``at`` to the end of its symbol of the next level."""
        up = self.parents[level][at]
        ends = np.append(self.starts[level], len(self.symbols[level]))
        return ends[up + 1] - at

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are equal from i and from j on; i differs from j, both are places of level 0."""
        a, b = i.copy(), j.copy()
        settled = np.full(len(a), -1)  # the level where the symbols at (a, b) differ
        going = np.arange(len(a))
        for t, (parent, start) in enumerate(zip(self.parents, self.starts, strict=True)):
            s = self.symbols[t]
            x, y = a[going], b[going]
            ready = (start[parent[x]] == x) & (start[parent[y]] == y)
            # one of them stands inside a symbol of the next level: equal symbols up to where the shorter one ends
            x, y, rest = x[~ready], y[~ready], going[~ready]
            same = self._equal(s, x, y)
            fx, fy = self._run_left(t, x), self._run_left(t, y)
            step = np.where(same, np.minimum(fx, fy) if self.blocks[t] else 1, 0)
            a[rest] += step
            b[rest] += step
            # blocks that end apart differ right behind the shorter one; so do pairs of which one went on
            differ = ~same | ((fx != fy) & self.blocks[t])
            settled[rest[differ]] = t
            going = np.concatenate([going[ready], rest[~differ]])
            a[going], b[going] = parent[a[going]], parent[b[going]]
        top = len(self.parents)
        settled[going] = top
        s = self.symbols[top]
        while len(going):  # a few symbols a text at most
            going = going[self._equal(s, a[going], b[going])]
            a[going] += 1
            b[going] += 1
        for t in range(top - 1, -1, -1):
            s, start = self.symbols[t], self.starts[t]
            down = np.flatnonzero(settled > t)
            a[down], b[down] = start[a[down]], start[b[down]]
            same = down[self._equal(s, a[down], b[down])]
            step = np.minimum(self._run_left(t, a[same]), self._run_left(t, b[same])) if self.blocks[t] else 1
            a[same] += step
            b[same] += step
        return a - i

    @staticmethod
    def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (s[a] == s[b]) & (s[a] >= 0)


def _grid(sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): every pair (g, g + q) on the grids of the texts, ``GRID`` pairs or one period of a text at a time."""
    offset = np.cumsum(np.append(0, sizes[:-1] + 1))
    most = np.where(sizes >= least, sizes // exponent, 0)
    for lo in range(1, int(most.max(initial=0)) + 1, 64):
        text, q = [], []
        for p in range(lo, min(lo + 64, int(most.max()) + 1)):
            on = np.flatnonzero(most >= p)
            text.append(on)
            q.append(np.full(len(on), p))
        text, q = np.concatenate(text), np.concatenate(q)
        count = (sizes[text] - 1) // q  # g = 0, q, ... with g + q inside the text
        cut = np.searchsorted(np.cumsum(count), np.arange(GRID, int(count.sum()) + GRID, GRID))
        for part in np.split(np.arange(len(text)), np.unique(np.clip(cut, 0, len(text)))):
            if len(part):
                c = count[part]
                step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                period = np.repeat(q[part], c)
                yield np.repeat(offset[text[part]], c) + step * period, period


def runs_of(texts: list[list[int]] | list[np.ndarray], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Rows (start, length, period), by start and period, of each text of non-negative word numbers."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    if not len(sizes):
        return []
    ends = np.cumsum(sizes + 1) - 1
    seq = np.empty(int(ends[-1]) + 1, dtype=np.int64)
    for x, e in zip(texts, ends, strict=True):
        seq[e - len(x):e] = x
    seq[ends] = -1 - np.arange(len(sizes))
    n = len(seq)
    probe = PROBE if (min_words, min_exponent) == (MIN_WORDS, MIN_EXPONENT) else 1
    found = []
    for g, q in _grid(sizes, min_words, min_exponent):
        for k in range(probe):  # within the sequence: a separator stops the comparison before its end
            keep = (seq[np.minimum(g + k, n - 1)] == seq[np.minimum(g + q + k, n - 1)]) & (g + q + k < n)
            g, q = g[keep], q[keep]
        if len(g):
            found.append(np.stack([g, q]))
    none = np.empty((0, 3), dtype=np.int64)
    if not found:
        return [none] * len(sizes)
    g, q = np.concatenate(found, axis=1)
    ahead = RunLengthGrammar(seq).extension(g, g + q)
    # the mirror image: the separators first, so place x becomes n - 1 - x of the sequence with one separator more at its end
    back = RunLengthGrammar(np.append(seq[::-1], -1 - len(sizes))).extension(n - g, n - g - q)
    start, length = g - back, back + q + ahead
    keep = length >= np.maximum(min_words, min_exponent * q)
    rows = np.stack([start[keep], length[keep], q[keep]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[:len(rows)]]  # smallest period of a stretch
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    at = np.searchsorted(rows[:, 0], np.append(ends - sizes, n))
    return [rows[a:b] - [e - s, 0, 0] if b > a else none for a, b, e, s in zip(at[:-1], at[1:], ends, sizes, strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def best_run(runs: np.ndarray) -> list[int | None]:
    """start, length, period, exponent_milli of the run with the greatest length / period (ties: smallest start, period)."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = [s, n, q]
    return [None] * 4 if best is None else [*best, 1000 * best[1] // best[2]]


def _portions(sizes: list[int]) -> Iterator[slice]:
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > BATCH_WORDS:
            yield slice(at, k)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period), the best run's start, length, period,
    exponent_milli, and ``collapsed`` (binary, UTF-8): the text's words without those that repeat a run's first period."""

    def run(batches):
        for b in batches:
            split = [raw.split() for raw in b.column("text").to_pylist()]
            names = ["start", "length", "period"]
            at, flat, best, collapsed = [0], [], [], []
            for part in _portions([len(w) for w in split]):
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)) for w in split[part]]
                for w, r in zip(split[part], runs_of(coded, min_words, min_exponent), strict=True):
                    at.append(at[-1] + len(r))
                    flat.append(r)
                    best.append(best_run(r))
                    collapsed.append(b" ".join(w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r).tolist(), strict=True) if k]))
            rows = np.concatenate([np.empty((0, 3), np.int64), *flat])
            spans = pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(3)], names)
            cols = list(zip(*best, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans),
                 *[pa.array(c, pa.int64()) for c in cols], pa.array(collapsed, pa.binary())],
                ["doc_id", "n_words", "runs", *names, "exponent_milli", "collapsed"])

    return map_batches(as_bytes(documents_like(docs, id_col, text_col)), run,
                       "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, "
                       "period long, exponent_milli long, collapsed binary")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for a tenth of the ids periodic from some word on (chosen by the id's crc32)."""
    n = len(words)
    g, digit = divmod(zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), 10)
    if digit or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def plant_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text: every document's words, joined by one blank, with :func:`planted` repeats."""

    def run(batches):
        for b in batches:
            texts = [b" ".join(planted(raw.split(), i)) for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return map_batches(as_bytes(documents_like(docs, id_col, text_col)), run, "doc_id long, text binary").withColumn(
        "text", F.col("text").cast("string"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document with planted repeats."""
    line = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return periodic_runs(plant_repeats(docs)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
