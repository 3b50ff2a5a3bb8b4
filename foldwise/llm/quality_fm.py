"""Quality classifier: a factorisation machine.

Features of a text: relative frequencies of hashed words, structure statistics
(in bins and as numbers) and metadata of the text itself (its length). The score
is a logistic of bias + linear terms + all pairwise interactions with low-rank
factors, summed in linear time: sum over pairs <v_i, v_j> x_i x_j =
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

The model is fitted on at most ``max_rows`` labelled documents, those with the
smallest crc32 of the id (a documented bound); only labelled rows outside the
held-out fifth are candidates. Every document is scored over its whole text.
Labels, language, source and ids are not features.

Defined results: null text counts as empty and scores like it (0 words); labels
that are null or of documents not in the table are not learned from; a document
labelled twice is learned from twice; without both labels to learn from every
score is the share of label 1 (0.5 without any); rows with a null id are scored
(held out by the crc32 of the empty text); further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, crc_mod5, documents_like, map_batches, worker_state

BUCKETS = 1 << 14
RANK = 6
MAX_ROWS = 6_000
THRESHOLD = 0.3
N_STATS = 16


def structure(raw: bytes, ws: list[bytes]) -> np.ndarray:
    """Statistics of form in about [0, 1]: letters, case, symbols, words, lines."""
    a = np.frombuffer(raw, dtype=np.uint8)
    n = max(1, len(a))
    count = np.bincount(a, minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    digits, spaces = count[48:58].sum(), count[32] + count[9:14].sum()
    high = count[128:].sum()
    symbols = max(0, n - upper - lower - digits - spaces - high) if len(a) else 0
    stops = count[46] + count[44]
    lines = raw.split(b"\n")
    w = max(1, len(ws))
    return np.array([
        1.0, np.log1p(len(ws)) / 10, upper / n, lower / n, digits / n, spaces / n, high / n,
        (symbols - stops) / n, stops / n, len(set(ws)) / w, len(set(lines)) / len(lines), np.log1p(len(lines)) / 8,
        min(1.0, len(raw) / w / 20), min(1.0, count[124] / w), min(1.0, count[33] / w),
        min(1.0, (count[35] + count[36] + count[37] + count[38] + count[42]) / w)])


def features(raw: bytes, hasher: WordHash, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words hashed into ``buckets``, then statistics and their bins."""
    ws = raw.lower().split()
    stats = structure(raw, ws)
    binned = buckets + N_STATS + 8 * np.arange(N_STATS) + np.minimum(7, (stats * 8).astype(np.int64))
    idx = [buckets + np.arange(N_STATS), binned]
    val = [stats, np.full(N_STATS, 0.25)]
    if ws:
        b, c = np.unique((hasher.of(ws) >> np.uint64(20)) % np.uint64(buckets), return_counts=True)
        idx.append(b.astype(np.int64))
        val.append(np.sqrt(c / len(ws)))
    return np.concatenate(idx), np.concatenate(val)


class FactorisationMachine:
    """Logistic FM over sparse rows, trained by AdaGrad."""

    def __init__(self, size: int = BUCKETS + 9 * N_STATS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0.0, 0.05, (size, rank))

    def raw_score(self, idx: np.ndarray, val: np.ndarray) -> float:
        """Linear time in the non-zero features, by the sum-of-squares identity."""
        vx = self.v[idx] * val[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def probability(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw_score(idx, val), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.1,
            decay: float = 1e-5, seed: int = 11) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                idx, val = rows[i]
                vx = self.v[idx] * val[:, None]
                s = vx.sum(axis=0)
                z = self.bias + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum())
                g = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[i]
                dw = g * val + decay * self.w[idx]
                dv = g * (val[:, None] * s - vx * val[:, None]) + decay * self.v[idx]
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                gb += g * g
                self.w[idx] -= rate * dw / np.sqrt(gw[idx])
                self.v[idx] -= 0.3 * rate * dv / np.sqrt(gv[idx])
                self.bias -= 0.1 * rate * g / np.sqrt(gb)
        return self


def _hasher() -> WordHash:
    return worker_state("fm-words", WordHash)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(idx, val, label) of the labelled documents that the model learns from, at most ``max_rows``."""
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    lab = (lab.where((crc_mod5(F.col("doc_id")) != 0) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
           .join(documents_like(docs).select("doc_id"), "doc_id", "left_semi")
           .orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "label").limit(max_rows))
    # bounded by max_rows
    rows = as_bytes(documents_like(docs).join(F.broadcast(lab), "doc_id"))

    def run(batches):
        h = _hasher()
        for b in batches:
            got = [features(raw, h) for raw in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.list_(pa.int64())),
                                              pa.array([v for _, v in got], pa.list_(pa.float64())), b.column("label"),
                                              b.column("doc_id")], ["idx", "val", "label", "doc_id"])

    return map_batches(rows.select("doc_id", "text", "label"), run, "idx array<long>, val array<double>, label int, doc_id long")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine | float:
    """The fitted machine; a constant where there are not both labels to learn from."""
    got = training_rows(docs, labels, max_rows).toArrow()  # at most max_rows rows
    order = np.lexsort((got.column("label").to_numpy(), got.column("doc_id").to_numpy()))
    idx, val = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    rows = [(idx[int(i)].values.to_numpy(), val[int(i)].values.to_numpy()) for i in order]
    y = got.column("label").to_numpy()[order].astype(float)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return FactorisationMachine().fit(rows, y)


def score_quality(docs: DataFrame, model: FactorisationMachine | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x (rank + 1) numbers

    def run(batches):
        m, h = shared.value, _hasher()
        for b in batches:
            s = [m if isinstance(m, float) else m.probability(*features(raw, h)) for raw in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                ["doc_id", "score", "predicted"])

    return map_batches(as_bytes(documents_like(docs)), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects; all columns stay as they are."""
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, h = shared.value, _hasher()
        for b in batches:
            ok = [(m if isinstance(m, float) else m.probability(*features((raw or "").encode(), h))) >= threshold
                  for raw in b.column("text").to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return map_batches(docs, run, docs.schema)
