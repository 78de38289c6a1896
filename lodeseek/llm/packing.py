"""Operator 3, best-fit packing of documents into sequences of a fixed capacity, by linear grouping.

Lengths are words, cut into pieces of at most ``capacity``. All decisions are made on the histogram of lengths, whose
size is bounded by the capacity and doesn't grow with the corpus:

1. pieces of exactly the capacity have a sequence each;
2. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its greatest;
3. configurations (how many of each of the few sizes) are optimised by linear programming with columns from a knapsack;
   whole multiples are kept, the rest is packed by best fit on the rounded sizes;
4. actual documents take the places of their group, longest first, so the true room left is known;
5. small lengths go, longest first, to the fullest sequence that has room (best fit), or to a new one.

The plan says, for ranges of ranks within a length, where they go; a broadcast of the plan places the documents. Ranks
come from a window over (length, salt) and counts; salts grow with the table, so no window holds all documents of a length.

Result: (bin_id, doc_id, piece, start_word, length, position): words start_word.. of the document are at
position.. of the sequence bin_id.

Defined results: texts without a word and null texts have one row with null bin_id and length 0; rows with a null
doc_id are packed too, copies of a row are packed each; columns besides doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.session import materialise

CAPACITY = 2048
SMALL = 1 / 8  # lengths up to this share of the capacity are small
GROUPS = 24
SALTED = 1 << 20  # pieces that one window ranks, about, where lengths are spread
MAX_BROADCAST = 1_000_000  # rows of the counts by length and salt
MAX_COLUMNS = 400


# ---- configurations -------------------------------------------------------------------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes by value within the capacity."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        fit = sizes <= c
        got = np.where(fit, best[np.maximum(c - sizes, 0)] + values, -1)
        j = int(got.argmax())
        best[c], take[c] = (got[j], j) if got[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = MAX_COLUMNS) -> list[tuple[int, np.ndarray]]:
    """(times, counts) of the configurations that pack ``demand`` pieces of each of a few sizes.

    Revised simplex on the covering problem, columns generated by ``knapsack``; then whole multiples, then best fit.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.float64)
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        value, column = knapsack(np.maximum(inverse.sum(0), 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ demand, inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand.astype(np.float64))
    left = demand.astype(np.int64).copy()
    out = []
    for j in np.argsort(-x, kind="stable"):
        counts = np.round(basis[:, j]).astype(np.int64)
        some = counts > 0
        times = int(min(np.floor(max(x[j], 0) + 1e-9), (left[some] // counts[some]).min())) if some.any() else 0
        if times > 0:
            out.append((times, counts))
            left -= times * counts
    while left.any():  # the rest: fill one configuration after another, largest first
        counts, room = np.zeros(m, np.int64), capacity
        for j in np.argsort(-sizes, kind="stable"):
            n = int(min(left[j] - counts[j], room // sizes[j]))
            counts[j] += n
            room -= n * sizes[j]
        some = counts > 0
        times = int((left[some] // counts[some]).min())
        out.append((times, counts))
        left -= times * counts
    return out


def groups(lengths: np.ndarray, counts: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """Large lengths, longest first, in up to n groups of equal cardinality: lists of (length, first rank, pieces)."""
    each = max(1, -(-int(counts.sum()) // n))
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for length, count in zip(lengths[::-1], counts[::-1]):
        rank = 0
        while rank < count:
            if not room:
                out.append([])
                room = each
            k = min(room, int(count) - rank)
            out[-1].append((int(length), rank, k))
            rank, room = rank + k, room - k
    return out


class Plan:
    """Ranges: pieces of ``length`` with ranks from..to - 1 go to sequences from ``bin``, ``per`` to each (the first may hold ``skip`` already)."""

    def __init__(self, capacity: int, small: float = SMALL, n_groups: int = GROUPS):
        self.capacity, self.small, self.n_groups = capacity, small, n_groups
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, from, to, bin, per, skip
        self.bins = 0

    def solve(self, histogram: dict[int, int]) -> Plan:
        whole = histogram.get(self.capacity, 0)
        if whole:
            self.rows.append((self.capacity, 0, whole, 0, 1, 0))
        self.bins = whole
        lengths = np.array(sorted(k for k, v in histogram.items() if 0 < k < self.capacity and v), np.int64)
        counts = np.array([histogram[int(k)] for k in lengths], np.int64)
        large = lengths > self.capacity * self.small
        runs = self._large(lengths[large], counts[large]) if large.any() else []
        self._small(lengths[~large], counts[~large], runs)
        return self

    def _large(self, lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """Place large pieces; (first bin, bins, room) of the sequences made."""
        grouped = groups(lengths, counts, self.n_groups)
        merged: dict[int, list[tuple[int, int, int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)  # groups with one greatest length are one size
        sizes = np.array(list(merged))
        members = list(merged.values())
        demand = np.array([sum(k for _, _, k in g) for g in members])
        used = np.zeros(len(sizes), np.int64)
        ends = [np.cumsum([k for _, _, k in g]) for g in members]
        out = []
        for times, config in configurations(sizes, demand, self.capacity):
            first = self.bins
            self.bins += times
            filled = [np.array([0])]
            for g in np.flatnonzero(config):
                per, a = int(config[g]), int(used[g])
                used[g] += per * times
                at = 0
                for (length, rank, k), end in zip(members[g], ends[g]):
                    lo, hi = max(a, int(end) - k), min(int(used[g]), int(end))  # places of this length among those of the configuration
                    if lo < hi:
                        begin = rank + lo - (int(end) - k)
                        self.rows.append((length, begin, begin + hi - lo, first + (lo - a) // per, per, (lo - a) % per))
                        filled += [np.array([(lo - a) // per, (lo - a) // per + 1, (hi - a) // per, (hi - a) // per + 1])]
                    at = hi
            cuts = np.unique(np.concatenate([*filled, [times]]))
            cuts = cuts[cuts <= times]
            fill = np.zeros(len(cuts) - 1, np.int64)  # words in each sequence of a run
            for g in np.flatnonzero(config):
                per = int(config[g])
                a = int(used[g]) - per * times
                for s in range(per):
                    which = np.searchsorted(ends[g], a + cuts[:-1] * per + s, "right")
                    fill += np.array([x[0] for x in members[g]])[which]
            out += [(first + int(c), int(e - c), int(self.capacity - f)) for c, e, f in zip(cuts[:-1], cuts[1:], fill)]
        return out

    def _small(self, lengths: np.ndarray, counts: np.ndarray, runs: list[tuple[int, int, int]]) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}
        for first, n, room in runs:
            rooms.setdefault(room, []).append((first, n))
        for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
            rank = 0
            while rank < count:
                fit = [r for r in rooms if r >= length]
                if not fit:
                    per = self.capacity // length
                    n = -(-(count - rank) // per)
                    rooms.setdefault(self.capacity, []).append((self.bins, n))
                    self.bins += n
                    continue
                room = min(fit)
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                per = room // length  # best fit keeps filling the sequence it has just made the fullest
                take = min(n * per, count - rank)
                full, rest = divmod(take, per)
                self.rows.append((length, rank, rank + take, first, per, 0))
                rank += take
                if full:
                    rooms.setdefault(room - per * length, []).append((first, full))
                if rest:
                    rooms.setdefault(room - rest * length, []).append((first + full, 1))
                if n > full + (rest > 0):
                    rooms.setdefault(room, []).append((first + full + (rest > 0), n - full - (rest > 0)))

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return ((rows[:, 0] << 44) | rows[:, 1], *rows[:, 2:].T)

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return bins_of(self.arrays(), length, rank)


def bins_of(arrays: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    key, _, first, per, skip = arrays
    at = np.searchsorted(key, (length << 44) | rank, "right") - 1
    return first[at] + (skip[at] + rank - (key[at] & ((1 << 44) - 1))) // per[at]


def measure(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, length) of the pieces of each row of docs; a row without words has one of length 0."""

    def work(batches):
        for batch, texts in C.sliced(batches):
            n = np.diff(C.Words(texts).first)
            pieces = np.maximum(-(-n // capacity), 1)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield C.table(doc_id=batch.column(0).take(pa.array(row)), piece=piece.astype(np.int32), length=np.minimum(n[row] - piece * capacity, capacity))

    return C.each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, piece int, length long")


def pack(docs: DataFrame, capacity: int = CAPACITY, small: float = SMALL, n_groups: int = GROUPS) -> DataFrame:
    pieces = materialise(measure(docs, capacity), "packing-pieces")
    salts = 1 + pieces.count() // SALTED
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    some = pieces.where("length > 0")
    counts = materialise(some.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    plan = Plan(capacity, small, n_groups).solve({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()})
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = some.withColumn("own", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    before = before.select("length", "salt", "before")
    ranked = ranked.join(F.broadcast(before) if salts * capacity <= MAX_BROADCAST else before, ["length", "salt"]).select("doc_id", "piece", "length", (F.col("own") + F.col("before")).alias("rank"))

    arrays = plan.arrays()

    def place(batches):
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            yield C.table(bin_id=bins_of(arrays, length, batch.column(3).to_numpy(zero_copy_only=False)), doc_id=batch.column(0), piece=batch.column(1), length=batch.column(2))

    placed = ranked.mapInArrow(place, "bin_id long, doc_id long, piece int, length long")
    within = W.partitionBy("bin_id").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("position", F.coalesce(F.sum("length").over(within), F.lit(0)))
    empty = pieces.where("length = 0").select(F.lit(None).cast("long").alias("bin_id"), "doc_id", "piece", "length", F.lit(None).cast("long").alias("position"))
    return placed.union(empty).select("bin_id", "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), "length", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))
