"""Operator 10, quality classifier.

Random Fourier features approximate a Gaussian kernel over document statistics. Each task sums its part of the normal
equations, sums of a bounded number of blocks reach the driver, ridge scores come from one solve of D x D, and isotonic
regression on rows held out of the fit turns scores into probabilities.

Defined results: null and empty texts have the statistics of an empty text; rows with a null doc_id or copies of a row
are scored like any other; labels with a null or a missing document are ignored; without labels of both kinds nothing
can be learned, so every document is kept with null score and probability. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.session import materialise

FEATURES = 256
GAMMA = 0.04
RIDGE = 1e-3
REJECT_BELOW = 0.5
HOLD_OUT = 5  # one labelled row in so many calibrates
BLOCKS = 16  # sums that reach the driver
BINS = 2000

# classes of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 common mark, 6 rare mark, 7 beyond ASCII, 8 control, 9 bar
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[:32] = 8
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[124] = 9
_CLASS[128:] = 7
N_CLASS = 10
STATS = N_CLASS + 9


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS numbers for each text."""
    buf, offsets = C.raw(texts)
    n = len(texts)
    size = np.diff(offsets)
    kind = _CLASS[buf]
    row = np.repeat(np.arange(n, dtype=np.int32) * N_CLASS, size)
    count = np.bincount(row + kind, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float64)
    solid = (kind != 3) & (kind != 4)
    ws, we = C.runs(solid, offsets)
    first = np.searchsorted(ws, offsets)
    words = np.diff(first).astype(np.float64)
    length = (we - ws).astype(np.float64)
    word_row = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(word_row, length, n)
    square = np.bincount(word_row, length**2, n)
    last = buf[we - 1] if len(we) else buf[:0]
    marked = np.bincount(word_row, (_CLASS[last] == 6), n)
    lone = np.bincount(word_row, (length == 1) & (_CLASS[last] == 9), n)
    hashes = C.hash_runs(buf, ws, we)
    doubled = np.bincount(word_row[1:], (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1]), n) if len(ws) > 1 else np.zeros(n)
    ls, le = C.runs(kind != 4, offsets)
    line_row = np.searchsorted(offsets, ls, "right") - 1
    key = C.hash_runs(buf, ls, le) ^ C.mix(line_row.astype(np.uint64))
    lines = np.bincount(line_row, minlength=n).astype(np.float64)
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(line_row[at], minlength=n)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    mean = total / w
    out = np.empty((n, STATS))
    out[:, :N_CLASS] = np.sqrt(count / b[:, None])
    out[:, N_CLASS:] = np.stack(
        [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, square / w - mean**2)), marked / w, lone / w, doubled / w, 1 - distinct / np.maximum(lines, 1), np.log1p(w / np.maximum(lines, 1))], axis=1
    )
    return out


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stats binary) for each row of docs."""

    def work(batches):
        for batch, texts in C.sliced(batches):
            s = statistics(texts).astype(np.float32)
            yield C.table(doc_id=batch.column(0), stats=C.pack(s, np.arange(len(texts) + 1) * STATS, 4))

    return C.each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, stats binary")


def unpack(column: pa.Array, width: int, kind=np.float32) -> np.ndarray:
    buf, _ = C.raw(column.cast(pa.large_binary()))
    return buf.view(kind).reshape(len(column), width)


def _sum_blocks(df: DataFrame, width: int) -> np.ndarray | None:
    """Sum of the binary vectors of float64 in df(s): first in BLOCKS groups, then here."""

    def add(batches):
        total = None
        for batch in batches:
            for x in unpack(batch.column(batch.schema.get_field_index("s")), width, np.float64):
                total = x.copy() if total is None else total + x
        if total is not None:
            yield C.table(s=pa.array([total.tobytes()], pa.binary()))

    rows = df.repartition(BLOCKS).mapInArrow(add, "s binary").collect()
    return sum(np.frombuffer(r[0], np.float64) for r in rows) if rows else None


class Model:
    """Scores for statistics; what it holds doesn't grow with the input."""

    def __init__(self, mean, scale, weights, shift, beta, knots, levels):
        self.mean, self.scale, self.weights, self.shift, self.beta, self.knots, self.levels = mean, scale, weights, shift, beta, knots, levels

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(((stats - self.mean) / self.scale) @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.levels)


def isotonic(x: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over x in ascending order; knots and levels."""
    blocks: list[list[float]] = []
    for a, w, g in zip(x, weight, good):
        blocks.append([a, a, w, g])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, b, w2, g2 = blocks.pop()
            blocks[-1][1:] = [b, blocks[-1][2] + w2, blocks[-1][3] + g2]
    knots, levels = [], []
    for a, b, w, g in blocks:
        for k in {a, b}:
            knots.append(k)
            levels.append(g / w)
    order = np.argsort(knots, kind="stable")
    return np.asarray(knots)[order], np.maximum.accumulate(np.asarray(levels)[order])


def fit(stats: DataFrame, labels: DataFrame, n_features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 7) -> Model | None:
    """Fit on all labelled rows; None without labels of both kinds.

    One row in HOLD_OUT by hash of its id is left out of the fit and calibrates; where that leaves none, as in very small
    tables, all labelled rows calibrate.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__label_id")).agg(F.max("quality").cast("double").alias("__good"))
    rows = stats.join(known, stats["doc_id"] == known["__label_id"]).select("stats", "__good", (F.pmod(F.xxhash64("__label_id"), F.lit(HOLD_OUT)) == 0).alias("__held"))
    rows = materialise(rows, "quality-labelled")

    def moments(batches):
        total = np.zeros(2 * STATS + 1)
        for batch in batches:
            s = unpack(batch.column(0), STATS).astype(np.float64)
            total += np.concatenate([s.sum(0), (s**2).sum(0), [len(s)]])
        yield C.table(s=pa.array([total.tobytes()], pa.binary()))

    both = rows.agg(F.min("__good"), F.max("__good"), F.sum(F.col("__held").cast("int"))).first()
    if both[0] is None or not both[0] < 0.5 <= both[1]:
        return None
    m = _sum_blocks(stats.select("stats").mapInArrow(moments, "s binary"), 2 * STATS + 1)
    mean = m[:STATS] / m[-1]
    scale = np.sqrt(np.maximum(m[STATS:-1] / m[-1] - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (STATS, n_features)), rng.uniform(0, 2 * np.pi, n_features), None, None, None)
    d = n_features + 1

    def equations(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            z = model.features(unpack(batch.column(0), STATS).astype(np.float64)[~held])
            z = np.concatenate([z, batch.column(1).to_numpy(zero_copy_only=False)[~held][:, None]], axis=1)
            total += z.T @ z
        yield C.table(s=pa.array([total.tobytes()], pa.binary()))

    g = _sum_blocks(rows.mapInArrow(equations, "s binary"), (d + 1) ** 2).reshape(d + 1, d + 1)
    penalty = ridge * max(g[0, 0], 1.0) * np.eye(d) / d
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(g[:d, :d] + penalty, g[:d, d])

    def scored(batches):
        for batch in batches:
            s = model.score(unpack(batch.column(0), STATS).astype(np.float64))
            yield C.table(bin=np.clip(np.round(s * BINS), -BINS, 2 * BINS).astype(np.int64), good=batch.column(1))

    held = rows.where("__held") if both[2] else rows
    bins = held.mapInArrow(scored, "bin long, good double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("good").alias("g")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(np.array([r[0] / BINS for r in bins]), np.array([float(r[1]) for r in bins]), np.array([float(r[2]) for r in bins]))
    return model


def classify(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW, **params) -> DataFrame:
    """(doc_id, quality_score, quality_prob, keep) for each row of docs."""
    stats = materialise(measure(docs), "quality-stats")
    model = fit(stats, labels, **params)
    if model is None:
        return stats.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("double").alias("quality_prob"), F.lit(True).alias("keep"))

    def score(batches):
        for batch in batches:
            s = model.score(unpack(batch.column(1), STATS).astype(np.float64))
            p = model.probability(s)
            yield C.table(doc_id=batch.column(0), quality_score=s, quality_prob=p, keep=p >= reject_below)

    return stats.mapInArrow(score, "doc_id long, quality_score double, quality_prob double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW, **params) -> DataFrame:
    """The rows of docs that the classifier keeps, with all columns of docs."""
    stats = materialise(measure(docs), "quality-stats")
    model = fit(stats, labels, **params)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = C.strings(batch.column(at))
            good = np.concatenate([model.probability(model.score(statistics(texts.slice(a, b - a)).astype(np.float32).astype(np.float64))) >= reject_below for a, b in C.slices(texts)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(good))

    return C.each(docs, keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
