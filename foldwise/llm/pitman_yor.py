"""Language-model scoring: a hierarchical Pitman-Yor model of word pairs.

Restaurants. The root serves words over a uniform base of V + 1 kinds (V training
words and the unknown one). Every context has a restaurant whose parent is the
root: every previous word has its own, and the first word of a text has the one
of the text's start. P(w | u) = (c_uw - d t_uw + (theta + d t_u) P(w)) /
(theta + c_u), the root alike with its customers c_w = sum over u of t_uw.

Seating. A cell is the customers of one word in one restaurant. A sweep reseats
every cell given all others: customers sit down one by one by the Chinese
restaurant rule, and the new seating replaces the old one with the
Metropolis-Hastings probability that makes this an exact Gibbs step for the cell
(beyond 64 customers they sit down in groups that grow with the cell, each with
the rule's odds at its start). Words of different hash buckets are sampled in
parallel against the totals t_u of the previous round. After burn-in the tables
of the samples are averaged; predictive probabilities use these averages and sum
to one.

Distribution. Tasks count (word, context) in blocks of the corpus before anything
is shuffled; a bucket of words holds its cells as packed arrays. Totals by context
of the ``frequent`` most frequent words and of the start are broadcast; those of
all other contexts are summed in the context's home, a bucket by its hash, which
answers each bucket that named it. Held-out documents name their contexts too, by
cells without customers. For scoring, tokens of frequent words after frequent ones
find their probability in a broadcast table of at most frequent x contexts cells;
of all others a block sends (word, context, document, count) to the word's bucket,
which returns sums by document. The number of buckets grows with the corpus. All documents
are scored, in a few rounds, so that requests and answers of a part of them are on disk at a time.

Defined results: null text is the empty text (one end token, in the start
context); rows with a null id are scored and learned from as if their id were
the empty text; repeated rows are learned from as often as they stand there, and
repeat in the result; an empty table gives no rows; if no document is learned
from, N = V = 0 and every token has probability 1; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import discard

from .common import as_bytes, crc_mod5, documents_like, map_batches, scratch, written

FREQUENT = 1000
DISCOUNT, STRENGTH = 0.7, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 20.0
BURN_IN, SAMPLES = 2, 4
BLOCK_TOKENS = 1_000_000
BLOCK_DOCS = 60_000
BUCKET_TOKENS = 2_000_000
#: Documents are scored in as many rounds as their bytes ask for, at most ROUNDS: a round's requests and answers go before the next.
ROUNDS, ROUND_BYTES = 3, 64_000_000
END = b" end"  # no word holds a space
CTX_BITS, DOC_BITS = np.uint64(32), 16
CTX_MASK = np.uint64((1 << 32) - 1)
#: Set in the name of a rare context, the hash of its word, and in no number of a frequent one.
RARE = np.uint64(1 << 63)
#: Cells that a bucket gathers before it adds up equal ones.
MERGE_CELLS = 4_000_000
#: Rows in a batch: packed arrays are many times as large as texts.
BATCH_ROWS = 32


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    return map_batches(df, fn, schema, BATCH_ROWS)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Lexicon(dict):
    """word -> number within a block; remembers each word's hash."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(word_hash(word))
        return n


@dataclass
class Block:
    """Tokens of consecutive documents."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    tokens: list[np.ndarray] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    ids: list = field(default_factory=list)
    held: list[bool] = field(default_factory=list)
    size: int = 0

    def add(self, doc_id, held: bool, raw: bytes) -> None:
        ws = raw.lower().split()
        ws.append(END)
        self.tokens.append(np.fromiter(map(self.lexicon.__getitem__, ws), dtype=np.int32, count=len(ws)))
        self.lengths.append(len(ws))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(ws)

    def full(self) -> bool:
        return self.size >= BLOCK_TOKENS or len(self.ids) >= BLOCK_DOCS

    def arrays(self, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes, rank among the frequent or -1) by word, (word, context, document) by token.

        A context is a frequent word's rank, the start's number, which follows, or beyond it the number of a rare word."""
        hashes = np.array(self.lexicon.hashes, dtype=np.uint64)
        at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
        rank = np.where(frequent[at] == hashes, at, -1) if len(frequent) else np.full(len(hashes), -1)
        own = np.where(rank >= 0, rank, len(frequent) + 1 + np.arange(len(hashes))).astype(np.int32)
        word = np.concatenate(self.tokens)
        ctx = np.empty(len(word), dtype=np.int32)
        ctx[1:] = own[word[:-1]]
        starts = np.cumsum([0, *self.lengths[:-1]])
        ctx[starts] = len(frequent)
        doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        return hashes, rank, word, ctx, doc


def blocks(batches) -> Iterator[Block]:
    block = Block()
    for b in batches:
        for doc_id, held, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            block.add(doc_id, held, raw)
            if block.full():
                yield block
                block = Block()
    if block.ids:
        yield block


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of words by (bucket, hash), their place in it, first place of each bucket)."""
    bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    place = np.empty(len(order), dtype=np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    return order, place, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its type and length in front."""
    out = []
    for a in arrays:
        head = np.array([len(a)], dtype="<u4").tobytes() + a.dtype.str.encode().ljust(4)
        out += [head, a.tobytes()]
    return b"".join(out)


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest type that holds them all."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def counted(word: np.ndarray, ctx: np.ndarray, last: np.ndarray, bits: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """(cells, last, count) of the distinct (word, context, last) in order; ``bits`` hold each. One sort where they fit 64 bits."""
    w, c, z = map(np.uint64, bits)
    if sum(bits) <= 64:
        key, n = np.unique((word.astype(np.uint64) << (c + z)) | (ctx.astype(np.uint64) << z) | last.astype(np.uint64), return_counts=True)
        cell = key >> z
        return (cell >> c << CTX_BITS) | (cell & ((np.uint64(1) << c) - np.uint64(1))), key & ((np.uint64(1) << z) - np.uint64(1)), n
    cells, inv = np.unique((word.astype(np.uint64) << CTX_BITS) | ctx.astype(np.uint64), return_inverse=True)
    key, n = np.unique((inv.astype(np.uint64) << z) | last.astype(np.uint64), return_counts=True)
    return cells[(key >> z).astype(np.int64)], key & ((np.uint64(1) << z) - np.uint64(1)), n


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, "<u4", 1, at)[0])
        kind = np.dtype(raw[at + 4:at + 8].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return out


def top_words(docs: DataFrame, frequent: int) -> list[int]:
    """Hashes of the most frequent training words, at most ``frequent``, as signed 64-bit numbers."""

    def run(batches):
        for b in batches_of(batches):
            counts = Counter()
            for raw in b:
                counts.update(raw.lower().split())
            counts[END] += len(b)
            keys = np.fromiter((word_hash(w) for w in counts), dtype=np.uint64, count=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(list(counts.values()), pa.int64())],
                                             ["word", "n"])

    def batches_of(batches, most=8_000_000):
        texts, size = [], 0
        for b in batches:
            part = b.filter(pa.array([not h for h in b.column("held_out").to_pylist()], pa.bool_())).column("text").to_pylist()
            texts += part
            size += sum(map(len, part))
            if size >= most:
                yield texts
                texts, size = [], 0
        if texts:
            yield texts

    counts = _map(docs, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(frequent).collect()]


def named(ctx: np.ndarray, hashes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, those from ``first`` on numbered anew, names of these)."""
    rare = ctx >= first
    used, number = np.unique(ctx[rare], return_inverse=True)
    out = ctx.astype("<u4")
    out[rare] = first + number
    return out, hashes[used.astype(np.int64) - first] | RARE


def counted_cells(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, cells): packed counts of (word, context) of a block's training documents; held-out ones add none,
    but name their rare contexts."""
    first = len(frequent) + 1

    def run(batches):
        for block in blocks(batches):
            hashes, _, word, ctx, doc = block.arrays(frequent)
            order, place, cuts = by_bucket(hashes, buckets)
            key, held, n = counted(place[word], ctx, np.array(block.held, dtype=bool)[doc],
                                   (len(hashes).bit_length(), (first + len(hashes)).bit_length(), 1))
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[at], np.add.reduceat(np.where(held == 0, n, 0), at)
            kept = (n > 0) | ((key & CTX_MASK) >= first)
            key, n = key[kept], n[kept]
            at = np.searchsorted(key >> CTX_BITS, cuts.astype(np.uint64))
            rows, ids = [], []
            for b in range(buckets):
                if at[b] < at[b + 1]:
                    k = key[at[b]:at[b + 1]]
                    used, sizes = np.unique((k >> CTX_BITS).astype(np.int64), return_counts=True)
                    c, names = named((k & CTX_MASK).astype(np.int64), hashes, first)
                    rows.append(pack(hashes[order[used]], narrow(sizes), narrow(c), narrow(n[at[b]:at[b + 1]]), names))
                    ids.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "cells"])

    return _map(docs, run, "bucket int, cells binary")


def _per_bucket(batches, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of sorted batches by bucket."""
    bucket, held = None, []
    for b in batches:
        for k, raw in zip(b.column("bucket").to_pylist(), b.column(column).to_pylist(), strict=True):
            if k != bucket and held:
                yield bucket, held
                held = []
            bucket = k
            held.append(raw)
    if held:
        yield bucket, held


def _grouped(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, cells of each, contexts) of sorted cells whose words are places in ``words``."""
    word = (key >> CTX_BITS).astype(np.int64)
    at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
    return words[word[at]], np.diff(np.append(at, len(word))), (key & CTX_MASK).astype(np.int64)


def _added(parts: list[list[np.ndarray]], contexts: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells by place of the word and context, counts, words, names) of the distinct cells, in order; names in order of their homes."""
    words, word = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    names, name = np.unique(np.concatenate([x[4] for x in parts]), return_inverse=True)
    order, place, _ = by_bucket(names, buckets)
    name, keys, i, j = place[name], [], 0, 0
    for h, sizes, c, _, own in parts:
        c = c.astype(np.uint64)
        rare = c >= contexts
        c[rare] = np.uint64(contexts) + name[j + c[rare].astype(np.int64) - contexts]
        keys.append(np.repeat(word[i:i + len(h)].astype(np.uint64) << CTX_BITS, sizes) | c)
        i, j = i + len(h), j + len(own)
    key = np.concatenate(keys)
    by = np.argsort(key)
    key, n = key[by], np.concatenate([x[3] for x in parts], dtype=np.int64, casting="unsafe")[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(n, at), words, names[order]


def merged_cells(parts: DataFrame, buckets: int, contexts: int) -> DataFrame:
    """One row per bucket: packed (word hashes, cells per word, contexts, counts), ``local``, and by frequent context
    the customers and cells, the bucket's words, tokens and cells.

    ``local``: the bucket's rare contexts, which follow the frequent ones in number, with customers and tables."""

    def run(batches):
        for bucket, raws in _per_bucket(batches, "cells"):
            held, size = [], 0
            for raw in raws:
                held.append(unpack(raw))
                size += len(held[-1][3])
                if size > max(MERGE_CELLS, len(held[0][3])):
                    key, n, words, names = _added(held, contexts, buckets)
                    words, sizes, ctx = _grouped(key, words)
                    held, size = [[words, sizes, ctx, n, names]], 0
            key, count, words, names = _added(held, contexts, buckets)
            _, _, cuts = by_bucket(names, buckets)
            words, sizes, ctx = _grouped(key[count > 0], words)
            count = count[count > 0]
            most = contexts + len(names)
            c_sum, t_sum = np.bincount(ctx, weights=count, minlength=most), np.bincount(ctx, minlength=most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()),
                 pa.array([pack(words, narrow(sizes), narrow(ctx), narrow(count))], pa.binary()),
                 pa.array([pack(names, cuts.astype("<i8"), narrow(c_sum[contexts:]),
                                t_sum[contexts:].astype("<f4"))], pa.binary()),
                 pa.array([c_sum[:contexts].astype(np.int64)], pa.list_(pa.int64())),
                 pa.array([t_sum[:contexts].astype(np.int64)], pa.list_(pa.int64())),
                 pa.array([len(words)], pa.int64()), pa.array([int(count.sum())], pa.int64()), pa.array([len(ctx)], pa.int64())],
                ["bucket", "cells", "local", "customers", "tables", "words", "tokens", "size"])

    rows = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return _map(rows, run, "bucket int, cells binary, local binary, customers array<long>, tables array<long>, "
                                  "words long, tokens long, size long")


def context_totals(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, home, totals): customers and tables of a bucket's rare contexts, summed over all buckets in each
    context's home; in order of home they follow the bucket's own order. A context is named once a bucket at most."""

    def send(batches):
        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("local").to_pylist(), strict=True):
                names, cuts, c, t = unpack(raw)
                homes = np.flatnonzero(cuts[1:] > cuts[:-1])
                bodies = [pack(*(x[cuts[k]:cuts[k + 1]] for x in (names, c, t))) for k in homes]
                yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array([bucket] * len(homes), pa.int32()),
                                                  pa.array(bodies, pa.binary())], ["bucket", "asker", "part"])

    def answer(batches):
        for home, got in _per_bucket(batches, "asked"):
            parts = [(x["asker"], *unpack(x["part"])) for x in got]
            names, inv = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
            c = np.bincount(inv, weights=np.concatenate([x[2] for x in parts]), minlength=len(names))
            t = np.bincount(inv, weights=np.concatenate([x[3] for x in parts]), minlength=len(names)).astype("<f4")
            ends = np.cumsum([0, *(len(x[1]) for x in parts)])
            for (asker, *_), i, j in zip(parts, ends[:-1], ends[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([asker], pa.int32()), pa.array([home], pa.int32()),
                                                  pa.array([pack(narrow(c[inv[i:j]]), t[inv[i:j]])], pa.binary())], ["bucket", "home", "totals"])

    asked = _map(rows.select("bucket", "local"), send, "bucket int, asker int, part binary")
    asked = asked.select("bucket", F.struct("asker", "part").alias("asked"))
    asked = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return _map(asked, answer, "bucket int, home int, totals binary")


def joined_totals(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(customers, tables) of a bucket's rare contexts from the answers in order of home."""
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0)
    c, t = zip(*map(unpack, parts), strict=True)
    return np.concatenate(c), np.concatenate(t).astype(float)


def seat(count: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float,
         rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log weight) after the customers of each cell sat down by the restaurant's rule.

    ``others``: tables of the restaurant outside the cell; ``parent``: the word's probability there.
    The weight is the product of the rule's normalisers, by which seatings are accepted.
    """
    tables = np.ones(len(count), dtype=np.int64)
    weight = np.log((strength + discount * others) * parent)
    alive = np.flatnonzero(count > 1)
    j = 1
    while len(alive):
        step = 1 if j < 64 else j // 16
        m = np.minimum(step, count[alive] - j)
        t = tables[alive]
        new = (strength + discount * (others[alive] + t)) * parent[alive]
        old = j - discount * t
        p = new / (new + old)
        tables[alive] = t + (rng.random(len(alive)) < p if step == 1 else rng.binomial(m, p))
        weight[alive] += m * np.log(new + old)
        j += step
        alive = alive[count[alive] > j]
    return tables, weight


def log_parent(c: np.ndarray, t: np.ndarray, total_c: float, total_t: float, kinds: float) -> np.ndarray:
    """The root's probability of words with ``c`` customers at ``t`` tables."""
    return (c - ROOT_DISCOUNT * t + (ROOT_STRENGTH + ROOT_DISCOUNT * total_t) / kinds) / (ROOT_STRENGTH + total_c)


def sample(cells: bytes, table_totals: np.ndarray, root_c: float, root_t: float, kinds: float, seed: int,
           burn_in: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (tables by cell, customers and tables at the root by word) over the samples of a bucket."""
    words, sizes, ctx, count = unpack(cells)
    count = count.astype(np.int64)
    rng = np.random.default_rng(seed)
    word = np.repeat(np.arange(len(words)), sizes)
    ctx = ctx.astype(np.int64)
    many = np.flatnonzero(count > 1)  # others have one table in every seating
    word_of, ctx_of, count = word[many], ctx[many], count[many]
    del ctx
    # the first seating: one table each
    tables, weight = np.ones(len(word), dtype=np.int64), np.full(len(many), -np.inf)
    top, top_weight = np.ones(len(words), dtype=np.int64), np.full(len(words), -np.inf)
    mean_t, mean_c0, mean_t0 = np.zeros(len(many)), np.zeros(len(words)), np.zeros(len(words))
    for sweep in range(burn_in + samples):
        c0 = np.bincount(word, weights=tables, minlength=len(words))
        p = log_parent(c0, top, root_c, root_t, kinds)
        others = np.maximum(0, table_totals[ctx_of] - tables[many])
        t, w = seat(count, others, p[word_of], DISCOUNT, STRENGTH, rng)
        accept = np.log(rng.random(len(many))) < w - weight
        tables[many[accept]], weight[accept] = t[accept], w[accept]
        c0 = np.bincount(word, weights=tables, minlength=len(words)).astype(np.int64)
        t, w = seat(c0, np.maximum(0, root_t - top), np.full(len(words), 1.0 / kinds), ROOT_DISCOUNT, ROOT_STRENGTH, rng)
        accept = (np.log(rng.random(len(words))) < w - top_weight) | (top > c0)
        top, top_weight = np.where(accept, t, top), np.where(accept, w, top_weight)
        if sweep >= burn_in:
            mean_t += tables[many]
            mean_c0 += c0
            mean_t0 += top
    mean = np.ones(len(word))
    mean[many] = mean_t / samples
    return mean, mean_c0 / samples, mean_t0 / samples


@dataclass
class Totals:
    """What all buckets share: sums over the corpus, by frequent context where arrays; a bucket adds its rare contexts."""

    n_tokens: int
    n_words: int
    customers: np.ndarray
    tables: np.ndarray
    root_c: float
    root_t: float

    @property
    def kinds(self) -> float:
        return self.n_words + 1.0

    def extended(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """With a bucket's rare contexts and, last, one that was never seen."""
        return replace(self, customers=np.concatenate([self.customers, customers, [0]]),
                       tables=np.concatenate([self.tables, tables, [0.0]]))

    def backoff(self) -> np.ndarray:
        return (STRENGTH + DISCOUNT * self.tables) / (STRENGTH + self.customers)

    def unknown(self) -> float:
        return float(log_parent(np.zeros(1), np.zeros(1), self.root_c, self.root_t, self.kinds)[0])

    def base(self, count: np.ndarray) -> np.ndarray:
        if self.n_words == 0:
            return np.zeros(len(count))
        return np.log10((count + 0.5) / (self.n_tokens + 0.5 * self.kinds))


def _by_context(df: DataFrame, column: str, contexts: int) -> np.ndarray:
    out = np.zeros(contexts)
    for r in df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


def sampled(cells: DataFrame, context: DataFrame, buckets: int, totals: Totals, seed: int, burn_in: int, samples: int,
            keep: bool) -> DataFrame:
    """Mean tables by context and at the root of every bucket; with ``keep`` the model's cells and customers too."""
    contexts = len(totals.customers)
    rows = cells.select("bucket", F.lit(-1).alias("home"), F.struct("cells", "local", F.lit(None).cast("binary").alias("totals")).alias("x"))
    rows = rows.union(context.select("bucket", "home", F.struct(F.lit(None).cast("binary").alias("cells"),
                                                                F.lit(None).cast("binary").alias("local"), "totals").alias("x")))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "home")

    def run(batches):
        for bucket, got in _per_bucket(batches, "x"):
            raw = got[0]["cells"]
            names, cuts, c_own, _ = unpack(got[0]["local"])
            if not keep:
                c_own = np.zeros(len(names), dtype="u1")  # only scoring asks for customers
            own = totals.extended(*joined_totals([x["totals"] for x in got[1:]]))
            t, c0, t0 = sample(raw, own.tables, totals.root_c, totals.root_t, totals.kinds,
                               (seed << 32) + bucket, burn_in, samples)
            words, sizes, ctx, count = unpack(raw)
            model = pack(words, sizes, ctx, count, t.astype("<f4"), c0.astype("<f8"), t0.astype("<f8")) if keep else b""
            sums = np.bincount(ctx.astype(np.int64), weights=t.astype("<f4").astype(float), minlength=contexts + len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([model], pa.binary()),
                 pa.array([pack(names, cuts, c_own, sums[contexts:].astype("<f4"))], pa.binary()),
                 pa.array([sums[:contexts]], pa.list_(pa.float64())),
                 pa.array([c0.sum()], pa.float64()), pa.array([t0.sum()], pa.float64())],
                ["bucket", "model", "local", "tables", "root_c", "root_t"])

    return _map(rows, run, "bucket int, model binary, local binary, tables array<double>, root_c double, root_t double")


class BucketModel:
    """Predictive probabilities of one bucket's words."""

    def __init__(self, raw: bytes | None, totals: Totals):
        self.totals, self.backoff = totals, totals.backoff()
        if raw:
            self.words, sizes, ctx, count, t, c0, t0 = unpack(raw)[:7]
            count = count.astype(np.int64)
            word = np.repeat(np.arange(len(self.words)), sizes)
            self.key = (word.astype(np.uint64) << CTX_BITS) | ctx.astype(np.uint64)
            self.gain = (count - DISCOUNT * t) / (STRENGTH + totals.customers[ctx.astype(np.int64)])
            self.count = np.bincount(word, weights=count, minlength=len(self.words))
            self.root = log_parent(c0, t0, totals.root_c, totals.root_t, totals.kinds)
        else:
            self.words, self.key, self.gain = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) == 0:
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def look_up(self, hashes: np.ndarray, word: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, ...]:
        """(known, base log10 probability) by word of ``hashes``; log10 P(word | context) by cell."""
        at, known = self.find(hashes)
        count = np.where(known, self.count[at], 0) if len(self.words) else np.zeros(len(hashes))
        root = np.where(known, self.root[at], self.totals.unknown()) if len(self.words) else np.full(
            len(hashes), self.totals.unknown())
        p = self.backoff[ctx] * root[word]
        if len(self.key):
            key = (at[word].astype(np.uint64) << CTX_BITS) | ctx.astype(np.uint64)
            cell = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            p = p + np.where(known[word] & (self.key[cell] == key), self.gain[cell], 0.0)
        if self.totals.n_words == 0:
            p = np.ones(len(p))
        return known, self.totals.base(count), np.log10(p)


def frequent_table(model: DataFrame, frequent: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(word | context), base log10 probability) of the frequent words after frequent ones: a bounded table."""

    def run(batches):
        for b in batches:
            for raw in b.column("model").to_pylist():
                rare = np.zeros(len(unpack(raw)[7]))
                m = BucketModel(raw, totals.extended(rare, rare))
                at, known = m.find(frequent)
                hit = np.flatnonzero(known)
                for i in hit:
                    ctx = np.arange(len(totals.customers))
                    _, base, lp = m.look_up(frequent[i:i + 1], np.zeros(len(ctx), dtype=np.int64), ctx)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(i)], pa.int32()), pa.array([lp.astype("<f8").tobytes()], pa.binary()),
                         pa.array([float(base[0])], pa.float64())], ["rank", "lp", "base"])

    lp, base = np.zeros((max(1, len(frequent)), len(totals.customers))), np.zeros(max(1, len(frequent)))
    for r in _map(model.select(F.concat("model", "local").alias("model")), run, "rank int, lp binary, base double").toLocalIterator():
        lp[r["rank"]], base[r["rank"]] = np.frombuffer(r["lp"], "<f8"), r["base"]
    return lp, base


def _sums(doc: np.ndarray, n_docs: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(doc, weights=v, minlength=n_docs).astype(float) for v in values]


def block_requests(docs: DataFrame, frequent: np.ndarray, table: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Rows (bucket, kind, block, body): kind 1, sums that the block knows; kind 2, cells to look up."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, *table))

    def run(batches):
        freq, lp, base = shared.value
        first = len(freq) + 1
        part = TaskContext.get().partitionId()
        for i, block in enumerate(blocks(batches)):
            name, n_docs = (part << 32) + i, len(block.ids)
            hashes, rank, word, ctx, doc = block.arrays(freq)
            r = rank[word]
            hot = (r >= 0) & (ctx < first)
            sums = _sums(doc[hot], n_docs, lp[r[hot], ctx[hot]], base[r[hot]], np.ones(int(hot.sum())))
            ids = np.array([0 if x is None else x for x in block.ids], dtype="<i8")
            none = np.array([x is None for x in block.ids], dtype="u1")
            rows = [(name % buckets, 1, pack(ids, none, np.array(block.held, dtype="u1"),
                                             np.array(block.lengths, dtype="<i8"), *sums))]
            order, place, cuts = by_bucket(hashes, buckets)
            cell, at_doc, n = counted(place[word[~hot]], ctx[~hot], doc[~hot],
                                      (len(hashes).bit_length(), (first + len(hashes)).bit_length(), DOC_BITS))
            at = np.searchsorted(cell >> CTX_BITS, cuts.astype(np.uint64))
            for b in range(buckets):
                if at[b] < at[b + 1]:
                    k = slice(at[b], at[b + 1])
                    used, sizes = np.unique((cell[k] >> CTX_BITS).astype(np.int64), return_counts=True)
                    c, names = named((cell[k] & CTX_MASK).astype(np.int64), hashes, first)
                    rows.append((b, 2, pack(hashes[order[used]], narrow(sizes), narrow(c), names,
                                            narrow(at_doc[k]), narrow(n[k]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()),
                 pa.array([name] * len(rows), pa.int64()), pa.array([x[2] for x in rows], pa.binary())],
                ["bucket", "kind", "block", "body"])

    return _map(docs, run, "bucket int, kind int, block long, body binary")


def answered(requests: DataFrame, model: DataFrame, context: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """(block, kind, body): sums of a block's documents (kind 1 as it came, kind 2 looked up, with the documents' numbers)."""
    rows = requests.union(model.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"),
                                       F.concat("model", "local").alias("body")))
    rows = rows.union(context.select("bucket", F.lit(-1).alias("kind"), F.col("home").cast("long").alias("block"),
                                     F.col("totals").alias("body")))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "block")
    first = len(totals.customers)
    none = totals.extended(np.empty(0, dtype=np.int64), np.empty(0))

    def run(batches):
        bucket, m, names, places, got = None, None, np.empty(0, np.uint64), np.empty(0, np.int64), []
        for b in batches:
            out = []
            for k, kind, block, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "block", "body")), strict=True):
                if k != bucket:
                    bucket, m, got = k, BucketModel(None, none), []
                    names, places = np.empty(0, np.uint64), np.empty(0, np.int64)
                if kind == -1:
                    got.append(body)
                elif kind == 0:
                    m = BucketModel(body, totals.extended(*joined_totals(got)))
                    names = unpack(body)[7]
                    places = np.argsort(names)
                    names, got = names[places], []
                elif kind == 1:
                    out.append((block, 1, body))
                else:
                    hashes, sizes, ctx, asked, doc, n = unpack(body)
                    word = np.repeat(np.arange(len(hashes)), sizes)
                    place = np.full(len(asked), len(names))  # the one never seen
                    if len(names):
                        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                        place = np.where(names[at] == asked, places[at], len(names))
                    ctx = ctx.astype(np.int64)
                    ctx[ctx >= first] = first + place[ctx[ctx >= first] - first]
                    known, base, lp = m.look_up(hashes, word, ctx)
                    docs, doc = np.unique(doc, return_inverse=True)
                    out.append((block, 2, pack(narrow(docs), *_sums(doc, len(docs), lp * n, base[word] * n, known[word] * n))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                                              pa.array([x[2] for x in out], pa.binary())], ["block", "kind", "body"])

    return _map(rows, run, "block long, kind int, body binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block's documents from its sums (a block's tokens at most)."""
    first = unpack(pdf.loc[pdf["kind"] == 1, "body"].iloc[0])
    ids, none, held, lengths, lp, base, known = first
    lp, base, known = lp.copy(), base.copy(), known.copy()
    for raw in pdf.loc[pdf["kind"] == 2, "body"]:
        at, a, b, c = unpack(raw)
        lp[at] += a
        base[at] += b
        known[at] += c
    out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": held.astype(bool), "n_tokens": lengths,
                        "n_known": known.round().astype(np.int64), "base_score": base, "score": lp})
    out.loc[none.astype(bool), "doc_id"] = pd.NA
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
                    burn_in: int = BURN_IN, samples: int = SAMPLES, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Perplexity of a text is 10^(-score / n_tokens).
    """
    with scratch():
        return _scored(documents_like(docs, id_col, text_col), frequent, burn_in, samples, held_fold)


def _scored(rows: DataFrame, frequent: int, burn_in: int, samples: int, held_fold: int) -> DataFrame:
    rows = as_bytes(rows.withColumn("held_out", crc_mod5(F.col("doc_id")) == held_fold))
    top = np.sort(np.array(top_words(rows, frequent), dtype=np.int64).view(np.uint64))
    contexts = len(top) + 1
    size = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(4, int(size // 6 // BUCKET_TOKENS) + 1)
    cells = written(merged_cells(counted_cells(rows, top, buckets), buckets, contexts), "py-cells")
    customers, tables = _by_context(cells, "customers", contexts), _by_context(cells, "tables", contexts)
    all_of = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "size")]).first()
    totals = Totals(all_of["tokens"], all_of["words"], customers, tables, float(all_of["size"]), float(all_of["words"]))
    first = written(sampled(cells, context_totals(cells, buckets), buckets, totals, 1, burn_in, 1, keep=False), "py-round")
    totals = _refreshed(first, totals)
    model = written(sampled(cells, context_totals(first, buckets), buckets, totals, 2, burn_in, samples, keep=True), "py-model")
    discard(cells, first)
    totals = _refreshed(model, totals)
    table = frequent_table(model, top, totals)
    context = written(context_totals(model, buckets), "py-context")
    rounds = min(ROUNDS, int(size // ROUND_BYTES) + 1)
    out = None
    for i in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i) if rounds > 1 else rows
        got = answered(block_requests(part, top, table, buckets), model, context, totals, buckets)
        scores = written(got.groupBy("block").applyInPandas(_gather, SCORES), "py-scores", keep=True)
        out = scores if out is None else out.union(scores)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")


def _refreshed(rounds: DataFrame, totals: Totals) -> Totals:
    s = rounds.agg(F.sum("root_c").alias("c"), F.sum("root_t").alias("t")).first()
    return Totals(totals.n_tokens, totals.n_words, totals.customers,
                  _by_context(rounds, "tables", len(totals.customers)), float(s["c"] or 0), float(s["t"] or 0))
