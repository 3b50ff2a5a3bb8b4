"""Averaged proximal SGD for logistic regression on hashed tokens and numerics (ML7, ML8, SM3).

Rows carry the bucket numbers of their ``column=value`` tokens and their standardised
numerics. They are written in chunks, dealt by a hash of the id; one gradient step a chunk reads
that chunk alone. A step is one Spark job: tasks add up their rows' sparse gradients for all
configurations at once, and the driver moves the coefficients of
the features seen so far (at most ``dim`` and the numerics). Chunks grow with the table, so a pass has at most
``MAX_STEPS`` steps.

A fit takes many steps, each of which waits for the one before, so what a step costs besides its rows
counts most. A fit therefore packs the rows of every file once, as arrays in a persisted partition, and a step is a bare job over
its chunk's partitions, without a query to plan; the driver adds up their sums (at most ``MOST_PIECES`` of them). Chunks of
one file keep one task busy anyway: a partition holds several of them, up to ``FILE_ROWS`` rows, and its task takes their steps in turn.
Larger chunks and micro-batches are summed by feature in a query of Spark.

A step is ``w <- soft(w - eta (g + alpha (1 - r) w), eta alpha r)`` with g the chunk's mean
gradient, r the l1 ratio (0 for l2) and soft the shrinking towards 0; the intercept is not
penalised. The model is the mean of the coefficients after every step. Rates: ``optimal`` starts at the
inverse curvature 1 / L, L a quarter of the rows' mean squared length, and falls as
1 / (L + alpha t), t the rows seen; ``constant`` is ``eta0``. Balanced configurations weigh a row by
n / (2 n of its class).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cat_tokens
from ..operators.counts import class_counts
from ..operators.encode import fit_numeric_stats, numeric_policy
from ..session import scratch_path

HASH_DIM = 1 << 18
CHUNK_ROWS = 100_000
MAX_STEPS = 200
# A chunk's rows in one file, read by one task.
FILE_ROWS = 25_000
# A chunk of more files is summed by Spark, not by the driver.
MOST_PIECES = 32
LOSS_EPS = 1e-15


@dataclass(frozen=True)
class SgdConfig:
    alpha: float = 1e-5
    l1_ratio: float = 0.0
    schedule: str = "optimal"
    eta0: float = 0.0
    balanced: bool = False

    @property
    def penalty(self) -> str:
        return "elasticnet" if self.l1_ratio else "l2"


def sgd_grid() -> list[SgdConfig]:
    """The 24 tuning points: l2 and elastic-net strengths, each without and with balanced weights, and two constant rates."""
    # fixed values
    l2 = [(a, 0.0) for a in (1e-6, 3e-6, 1e-5, 3e-5, 1e-4)]
    elastic = [(a, r) for a in (1e-6, 1e-5, 3e-5) for r in (0.15, 0.5)]
    return [*(SgdConfig(a, r, balanced=b) for a, r in l2 + elastic for b in (False, True)),
            SgdConfig(1e-5, schedule="constant", eta0=0.02), SgdConfig(1e-5, schedule="constant", eta0=0.05, balanced=True)]


@dataclass
class SgdModel:
    """Averaged coefficients of the features seen: ``at`` (ascending) and ``coef``."""

    config: SgdConfig
    at: np.ndarray
    coef: np.ndarray
    intercept: float


@dataclass
class TokenFeatures:
    """How rows become features: hashed tokens of ``cat`` and ``num`` scaled by ``stats`` (nulls are 0 first)."""

    cat: list[str]
    num: list[str]
    stats: dict
    dim: int = HASH_DIM

    @classmethod
    def fit(cls, train: DataFrame, cat: list[str], num: list[str], dim: int = HASH_DIM) -> TokenFeatures:
        return cls(cat, num, fit_numeric_stats(train, num, "zero"), dim)

    def rows(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep``, idx array<int> (a token's bucket, as often as it stands there), num array<double>."""
        tokens = F.filter(F.split(F.trim(cat_tokens(self.cat)), " +"), lambda t: t != "")
        idx = F.transform(tokens, lambda t: F.pmod(F.hash(t), F.lit(self.dim)).cast("int"))
        num = [numeric_policy(c, self.stats[c], "zero").cast("double") for c in self.num]
        return df.select(*keep, idx.alias("idx"), (F.array(*num) if num else F.array().cast("array<double>")).alias("num"))


class Chunks(list):
    """The chunks as frames, and all of them as ``table`` of ``n`` rows with columns ``chunk`` and ``file`` (of ``files`` a chunk)."""

    def __init__(self, table: DataFrame, n: int, chunks: int, files: int):
        super().__init__(table.where(F.col("chunk") == c).drop("chunk", "file") for c in range(chunks))
        self.table, self.files = table, files
        self.together = max(1, FILE_ROWS * chunks // max(1, n)) if files == 1 else 1

    def pieces(self, dim: int) -> RDD:
        """The packed rows of every file, ``together`` consecutive files in a partition, in the order of chunks."""
        files = len(self) * self.files
        at = F.floor((F.col("chunk") * F.lit(self.files) + F.col("file")) / F.lit(self.together)).cast("int")
        dealt = self.table.repartitionById(-(-files // self.together), at).select("chunk", "y", "idx", "num")
        return dealt.mapInArrow(lambda batches: _pack(batches, dim), "piece binary").rdd.map(lambda r: bytes(r[0]))


def write_chunks(rows: DataFrame, id_col: str, chunk_rows: int = CHUNK_ROWS) -> Chunks:
    """The rows as chunks of about ``chunk_rows`` (more, if there would be over ``MAX_STEPS``), each its own folder
    of files of about ``FILE_ROWS`` rows, however many tasks the rows come from."""
    spark = rows.sparkSession
    n = rows.count()
    chunks = int(min(MAX_STEPS, max(1, -(-n // chunk_rows))))
    files = max(1, -(-n // (chunks * FILE_ROWS)))
    path = scratch_path(spark, "sgd-chunks")
    dealt = rows.withColumns({"chunk": F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(chunks)).cast("int"),
                              "file": F.pmod(F.xxhash64(id_col, F.lit(8)), F.lit(files)).cast("int")})
    dealt.repartition("chunk", "file").write.partitionBy("chunk").parquet(path)
    return Chunks(spark.read.schema(dealt.schema).parquet(path), n, chunks, files)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, length of each row)."""
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _entries(b: pa.RecordBatch, dim: int):
    """(features, values, first entry of each row) of the batch's tokens and numerics, row by row."""
    idx, count = _lists(b.column("idx"))
    num, width = _lists(b.column("num"))
    row = np.concatenate([np.repeat(np.arange(len(count)), count), np.repeat(np.arange(len(width)), width)])
    order = np.argsort(row, kind="stable")
    feature = np.concatenate([idx.astype(np.int64), dim + np.arange(len(num)) - np.repeat(np.cumsum(width) - width, width)])
    value = np.concatenate([np.ones(len(idx)), num])
    return feature[order], value[order], row[order]


def _margins(b: pa.RecordBatch, at: np.ndarray, coef: np.ndarray, intercept: np.ndarray, dim: int):
    """(margins rows x configurations, features and values and row of every entry of the batch)."""
    feature, value, row = _entries(b, dim)
    z = np.tile(intercept, (b.num_rows, 1)).astype(float)
    if len(at) and len(row):
        place = np.minimum(np.searchsorted(at, feature), len(at) - 1)
        part = coef[place] * np.where(at[place] == feature, value, 0.0)[:, None]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        z[row[first]] += np.add.reduceat(part, first, axis=0)
    return z, feature, value, row


@dataclass
class Piece:
    """Rows as arrays that no step changes: labels, entries a row, features, and of each entry, row by row, the place of its feature and its value."""

    y: np.ndarray
    width: np.ndarray
    which: np.ndarray
    place: np.ndarray
    value: np.ndarray


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """A pickled :class:`Piece` of each chunk, in their order."""
    of: dict[int, list[tuple]] = {}
    for whole in batches:
        chunk = whole.column("chunk").to_numpy()
        for c in np.unique(chunk).tolist():
            b = whole.filter(pa.array(chunk == c))
            feature, value, row = _entries(b, dim)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            of.setdefault(c, []).append((y, np.bincount(row, minlength=b.num_rows), feature, value))
    for c in sorted(of):
        y, width, feature, value = map(np.concatenate, zip(*of.pop(c), strict=True))
        which, place = np.unique(feature, return_inverse=True)
        piece = Piece(y, width.astype(np.min_scalar_type(width.max())), which, place.reshape(-1).astype(np.min_scalar_type(len(which))), value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(piece, 5)], pa.binary())], ["piece"])


def _piece_gradients(piece: Piece, at: np.ndarray, coef: np.ndarray, intercept: np.ndarray, class_weight: tuple[float, float],
                     balanced: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, features, their summed gradients, the intercepts') of a piece."""
    y, width, place, value = piece.y, piece.width.astype(np.int64), piece.place, piece.value
    row = np.repeat(np.arange(len(y)), width)
    z = np.tile(intercept, (len(y), 1)).astype(float)
    if len(at) and len(row):
        seen = np.minimum(np.searchsorted(at, piece.which), len(at) - 1)
        part = coef[seen][place] * np.where((at[seen] == piece.which)[place], value, 0.0)[:, None]
        some = width > 0
        z[some] += np.add.reduceat(part, (np.cumsum(width) - width)[some], axis=0)
    weight = np.where(balanced[None, :], np.where(y > 0, class_weight[1], class_weight[0])[:, None], 1.0)
    err = (_sigmoid(z) - y[:, None]) * weight
    g = [np.bincount(place, weights=e[row] * value, minlength=len(piece.which)) for e in np.ascontiguousarray(err.T)]
    return len(y), piece.which, np.stack(g, axis=1), err.sum(axis=0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


@dataclass
class AveragedSgd:
    """The state of all configurations; :meth:`step` takes any frame of (y, idx, num), of a batch job or a micro-batch."""

    configs: list[SgdConfig]
    dim: int
    curvature: float
    class_weight: tuple[float, float] = (1.0, 1.0)
    at: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    steps: int = 0
    rows_seen: int = 0

    def __post_init__(self):
        n = len(self.configs)
        self.coef, self.mean = np.empty((0, n)), np.empty((0, n))
        self.intercept, self.intercept_mean = np.zeros(n), np.zeros(n)

    def gradients(self, chunk: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, features, their summed gradients, the intercepts') of a chunk under the coefficients as they are."""
        spark, names = chunk.sparkSession, [f"g{i}" for i in range(len(self.configs))]
        state = spark.sparkContext.broadcast((self.at, self.coef, self.intercept, self.dim, self.class_weight,
                                              np.array([c.balanced for c in self.configs])))

        def run(batches):
            at, coef, intercept, dim, (w0, w1), balanced = state.value
            total: dict[int, np.ndarray] = {}
            n, bias = 0, np.zeros(len(intercept))
            for b in batches:
                y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
                z, feature, value, row = _margins(b, at, coef, intercept, dim)
                weight = np.where(balanced[None, :], np.where(y > 0, w1, w0)[:, None], 1.0)
                err = (_sigmoid(z) - y[:, None]) * weight
                n, bias = n + len(y), bias + err.sum(axis=0)
                which, inverse = np.unique(feature, return_inverse=True)
                inverse, scaled = inverse.reshape(-1), err[row] * value[:, None]
                g = np.stack([np.bincount(inverse, weights=x, minlength=len(which)) for x in scaled.T], axis=1)
                for f, x in zip(which.tolist(), g, strict=True):
                    total[f] = total[f] + x if f in total else x
            features = [-1, *total]
            g = np.vstack([bias, *total.values()])
            rows = [n] + [0] * len(total)
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(rows, pa.int64()),
                                              *[pa.array(g[:, i]) for i in range(g.shape[1])]], ["at", "n", *names])

        schema = "at long, n long, " + ", ".join(f"{x} double" for x in names)
        sums = chunk.select("y", "idx", "num").mapInArrow(run, schema).groupBy("at").agg(
            F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
        got = sums.toPandas().sort_values("at")  # at most the features and one row
        state.destroy()
        g = got[names].to_numpy(dtype=float)
        if not len(got) or int(got["n"].iloc[0]) == 0:
            return 0, np.empty(0, np.int64), np.empty((0, len(names))), np.zeros(len(names))
        return int(got["n"].iloc[0]), got["at"].to_numpy()[1:], g[1:], g[0]

    def piece_gradients(self, pieces: RDD, partitions: range) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`gradients`, of the packed rows in some partitions."""
        state = (self.at, self.coef, self.intercept, self.class_weight, np.array([c.balanced for c in self.configs]))
        got = pieces.context.runJob(pieces, lambda some: [_piece_gradients(pickle.loads(x), *state) for x in some], list(partitions))
        if not got:
            return 0, np.empty(0, np.int64), np.empty((0, len(self.configs))), np.zeros(len(self.configs))
        features = np.unique(np.concatenate([which for _, which, _, _ in got]))
        g = np.zeros((len(features), len(self.configs)))
        for _, which, part, _ in got:
            g[np.searchsorted(features, which)] += part
        return sum(n for n, *_ in got), features, g, sum(bias for *_, bias in got)

    def step(self, chunk: DataFrame) -> int:
        """One gradient step; the chunk's rows (an empty one changes nothing)."""
        return self._move(*self.gradients(chunk))

    def replay(self, pieces: RDD, chunks: Chunks) -> None:
        """One gradient step a chunk over its packed rows."""
        if chunks.files == 1:
            for i in range(pieces.getNumPartitions()):
                self._follow(pieces, i)
            return
        for c in range(len(chunks)):
            self._move(*self.piece_gradients(pieces, range(c * chunks.files, (c + 1) * chunks.files)))

    def _follow(self, pieces: RDD, partition: int) -> None:
        """The steps of a partition's chunks, each whole there, one after another in its task."""
        state, balanced = self, np.array([c.balanced for c in self.configs])

        def run(some):
            for x in some:
                state._move(*_piece_gradients(pickle.loads(x), state.at, state.coef, state.intercept, state.class_weight, balanced))
            return [state]

        self.__dict__.update(pieces.context.runJob(pieces, run, [partition])[0].__dict__)

    def _move(self, n: int, features: np.ndarray, g: np.ndarray, bias: np.ndarray) -> int:
        if n == 0:
            return 0
        fresh = np.setdiff1d(features, self.at)
        if len(fresh):
            at = np.union1d(self.at, fresh)
            for name in ("coef", "mean"):
                wide = np.zeros((len(at), len(self.configs)))
                wide[np.searchsorted(at, self.at)] = getattr(self, name)
                setattr(self, name, wide)
            self.at = at
        whole = np.zeros_like(self.coef)
        whole[np.searchsorted(self.at, features)] = g / n
        alpha = np.array([c.alpha for c in self.configs])
        ratio = np.array([c.l1_ratio for c in self.configs])
        eta = np.array([c.eta0 if c.schedule == "constant" else 1 / (self.curvature + c.alpha * self.rows_seen) for c in self.configs])
        w = self.coef - eta * (whole + alpha * (1 - ratio) * self.coef)
        self.coef = np.sign(w) * np.maximum(np.abs(w) - eta * alpha * ratio, 0)
        self.intercept = self.intercept - eta * bias / n
        self.steps += 1
        self.rows_seen += n
        self.mean = self.mean + (self.coef - self.mean) / self.steps
        self.intercept_mean = self.intercept_mean + (self.intercept - self.intercept_mean) / self.steps
        return n

    def models(self) -> list[SgdModel]:
        return [SgdModel(c, self.at, self.mean[:, i], float(self.intercept_mean[i])) for i, c in enumerate(self.configs)]


def mean_curvature(rows: DataFrame) -> float:
    """A quarter of the mean squared length of the rows, the intercept's 1 with it."""
    square = F.size("idx") + F.aggregate("num", F.lit(0.0), lambda s, x: s + x * x) + 1.0
    return 0.25 * float(rows.agg(F.avg(square)).first()[0] or 4.0)


def fit_sgd(rows: DataFrame, configs: list[SgdConfig], id_col: str = "id", passes: int = 2, dim: int = HASH_DIM,
            chunk_rows: int = CHUNK_ROWS) -> AveragedSgd:
    """All configurations over ``passes`` replays of the chunks of ``rows`` (id, y, idx, num)."""
    counts = {r["y"]: r["n"] for r in class_counts(rows, "y").collect()}
    n = sum(counts.values())
    state = AveragedSgd(configs, dim, mean_curvature(rows), (n / (2 * max(1, counts[0])), n / (2 * max(1, counts[1]))))
    chunks = write_chunks(rows.select(id_col, "y", "idx", "num"), id_col, chunk_rows)
    if chunks.files > MOST_PIECES:
        for _ in range(passes):
            for chunk in chunks:
                state.step(chunk)
        return state
    pieces = chunks.pieces(dim).persist(StorageLevel.MEMORY_AND_DISK)
    pieces.count()  # all are packed at once, not chunk by chunk
    for _ in range(passes):
        state.replay(pieces, chunks)
    pieces.unpersist()
    return state


def _stacked(models: list[SgdModel]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return models[0].at, np.stack([m.coef for m in models], axis=1), np.array([m.intercept for m in models])


def sgd_losses(rows: DataFrame, models: list[SgdModel], dim: int = HASH_DIM) -> list[float]:
    """Mean log-loss of each model (of one fit) on ``rows``, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(_stacked(models))
    names = [f"l{i}" for i in range(len(models))]

    def run(batches):
        total, n = np.zeros(len(names)), 0
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)[:, None]
            p = np.clip(_sigmoid(_margins(b, *shared.value, dim)[0]), LOSS_EPS, 1 - LOSS_EPS)
            total, n = total - np.where(y > 0, np.log(p), np.log1p(-p)).sum(axis=0), n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([x]) for x in total]], ["n", *names])

    r = rows.select("y", "idx", "num").mapInArrow(run, "n long, " + ", ".join(f"{x} double" for x in names)).agg(
        F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).first()
    return [r[x] / max(1, r["n"] or 0) if r[x] is not None else float("nan") for x in names]


def sgd_scores(rows: DataFrame, model: SgdModel, id_col: str = "id", dim: int = HASH_DIM) -> DataFrame:
    """``id, p`` of every row; works on streams too."""
    shared = rows.sparkSession.sparkContext.broadcast(_stacked([model]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _sigmoid(_margins(b, *shared.value, dim)[0])[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(p)], [id_col, "p"])

    return rows.select(id_col, "idx", "num").mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, p double")


def tune_sgd(train: DataFrame, valid: DataFrame, configs: list[SgdConfig], id_col: str = "id", passes: int = 2,
             dim: int = HASH_DIM, chunk_rows: int = CHUNK_ROWS) -> tuple[SgdConfig, DataFrame]:
    """ML8: (the configuration with the least hold-out loss, the first one of ties; a row per trial)."""
    models = fit_sgd(train, configs, id_col, passes, dim, chunk_rows).models()
    losses = sgd_losses(valid, models, dim)
    best = min(range(len(configs)), key=lambda i: (losses[i], i))
    rows = [(i, c.penalty, c.alpha, c.l1_ratio, c.schedule, c.eta0, c.balanced, float(v), i == best)
            for i, (c, v) in enumerate(zip(configs, losses, strict=True))]
    trials = train.sparkSession.createDataFrame(rows, "trial int, penalty string, alpha double, l1_ratio double, schedule string, "
                                                      "eta0 double, balanced boolean, val_logloss double, best boolean")
    return configs[best], trials


def best_row(config: SgdConfig, loss: float) -> dict:
    """What a tuning run keeps of its best trial."""
    return {"val_logloss": loss, "penalty": config.penalty, **asdict(config)}
