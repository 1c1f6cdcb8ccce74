"""Quality scores: kernel ridge regression on document statistics, with isotonic calibration.

Statistics of every whole text are computed in one pass and written once. Random
Fourier features of the standardised statistics approximate a Gaussian kernel, each
partition sums its share of the normal equations, and the sums alone (fixed in size) reach the driver.
Two half models score each other's rows; their scores, counted in fixed bins,
give the isotonic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import add_columns, column
from massloom.llm.bytehash import prefix, slices, space_table, span_hash, words
from massloom.session import written

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digit", "punct", "symbol", "bang", "bar", "beyond_ascii",
    "line_rate", "distinct", "adjacent", "top_word", "caps_words", "end_marks",
)
FEATURES = 256
BINS = 1000
_WORD = space_table()


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _class(b"0123456789")
_PUNCT = _class(b".,;:?'\"()-")
_SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{}~")
#: second byte of upper-case Latin-1 letters in UTF-8, after 0xC3
_UPPER_TAIL = _class(bytes(range(0x80, 0x9F)))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; all 0 but for the logs where a text has no words."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    start, end, row = words(buf, offsets, _WORD)
    count = np.bincount(row, minlength=n)
    some = np.maximum(size, 1)
    many = np.maximum(count, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    upper = _UPPER[buf]
    if len(buf) > 1:
        upper[1:] |= (buf[:-1] == 0xC3) & _UPPER_TAIL[buf[1:]]
    upper_sums = np.concatenate([[0], np.cumsum(upper)])
    letter_sums = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    length = end - start
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(count)
    out[:, 2] = np.minimum(np.bincount(row, weights=length, minlength=n) / many, 40)
    out[:, 3] = np.bincount(row, weights=length > 16, minlength=n) / many
    out[:, 4] = share(upper) / some
    for k, flags in ((5, _DIGIT[buf]), (6, _PUNCT[buf]), (7, _SYMBOL[buf]), (8, buf == 33), (9, buf == 124), (10, buf > 127)):
        out[:, k] = share(flags) / some
    out[:, 11] = share(buf == 10) / many
    if len(start):
        sums = prefix(buf)
        key = span_hash(sums, start, end)
        order = np.lexsort((key, row))
        k, r = key[order], row[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(k)))
        out[:, 12] = np.bincount(r[first], minlength=n) / many ** 0.9
        top = np.zeros(n)
        np.maximum.at(top, r[first], times)
        out[:, 14] = top / many
        out[:, 13] = np.bincount(row[1:], weights=(key[1:] == key[:-1]) & (row[1:] == row[:-1]), minlength=n) / many
        capital = (upper_sums[end] - upper_sums[start]) >= 2
        letters = letter_sums[end] - letter_sums[start]
        out[:, 15] = np.bincount(row, weights=capital & (letters > 1), minlength=n) / many
        last = buf[end - 1]
        out[:, 16] = np.bincount(row, weights=(last == 46) | (last == 44), minlength=n) / many
    return out


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Append the statistics of every whole text (null counts as empty) as an array of doubles."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            parts = [statistics(buf, offsets) for _, _, buf, offsets in slices(column(batch, text))]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            bounds = np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)
            return {out: pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))}

        return step

    return add_columns(docs, make, [T.StructField(out, T.ArrayType(T.DoubleType()))])


@dataclass
class RidgeModel:
    mean: np.ndarray
    spread: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None
    constant: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        out = np.ones((len(x), len(self.phase) + 1))
        out[:, 1:] = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        raw = self.features(x) @ self.weights
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing values nearest to ``y`` by weighted squares."""
    level: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level.pop()
            level.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in level]) if level else np.zeros(0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(known: DataFrame, statistics: str = "statistics", label: str = "y", fold: str = "fold", ridge: float = 1e-1, seed: int = 11, reducers: int = 8) -> RidgeModel:
    """Fit on all rows of ``known`` (statistics, label 0/1, fold 0/1).

    Without labels of both kinds the model scores every text with the labels' mean (0 without any rows).
    """
    n = len(STATISTICS)
    first = known.select(F.avg(label).alias("m"), F.count(label).alias("n"), *(F.avg(F.col(statistics)[k]).alias(f"a{k}") for k in range(n)), *(F.stddev_pop(F.col(statistics)[k]).alias(f"s{k}") for k in range(n))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([first[f"a{k}"] or 0.0 for k in range(n)])
    spread = np.array([first[f"s{k}"] or 0.0 for k in range(n)])
    model = RidgeModel(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / np.sqrt(n / 2), (n, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), constant=float(first.m or 0.0))
    if not first.n or first.m in (0.0, 1.0):
        return model
    d = FEATURES + 1
    shape = (2, d, d + 1)

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            z = model.features(_matrix(batch, statistics))
            y = column(batch, label).to_numpy(zero_copy_only=False).astype(float)
            f = column(batch, fold).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k, :, :d] += z[f == k].T @ z[f == k]
                total[k, :, d] += z[f == k].T @ y[f == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = known.select(statistics, label, fold).mapInArrow(partial, "sums binary").repartition(reducers).mapInArrow(added, "sums binary")
    halves = sum(np.frombuffer(r.sums).reshape(shape) for r in sums.collect())  # one fixed-size row of each reducer

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :d] + ridge * np.eye(d), s[:, d])

    half = [solve(halves[k]) for k in (0, 1)]
    model.weights = solve(halves.sum(0))

    def crossed(batches):
        for batch in batches:
            z = model.features(_matrix(batch, statistics))
            f = column(batch, fold).to_numpy(zero_copy_only=False)
            raw = np.where(f == 0, z @ half[1], z @ half[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)), column(batch, label).cast(pa.int64())], names=["bin", "y"])

    bins = known.select(statistics, label, fold).mapInArrow(crossed, "bin long, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()  # BINS rows at most
    weight = np.array([b.n for b in bins], dtype=float)
    model.knots = (np.array([b.bin for b in bins]) + 0.5) * 2 / BINS - 0.5
    model.levels = pool_adjacent(np.array([b.s for b in bins]) / weight, weight)
    return model


def score(docs: DataFrame, model: RidgeModel, statistics: str = "statistics", out: str = "score") -> DataFrame:
    """Append the calibrated score, from 0 to 1, of rows that carry their statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by FEATURES and BINS

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {out: pa.array(shared.value.scores(_matrix(batch, statistics)))}

        return step

    return add_columns(docs, make, [T.StructField(out, T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, train: F.Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``; labels are learnt from rows where ``train`` (on the id) holds.

    Null labels and ids are not learnt from; an id labelled more than once takes its largest label.
    """
    stats = written(with_statistics(docs.select(F.col(doc_id), F.col(text).alias("text")), "text").select(doc_id, "statistics"), "statistics")
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & train).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("y"))
    joined = written(stats.join(known, doc_id).select("statistics", "y", F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int").alias("fold")), "labelled")
    return score(stats, fit(joined)).drop("statistics")
