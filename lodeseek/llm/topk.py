"""Operator 5, exact top-k search by pivot-table elimination. The query asks for every vector whose id is divisible by
EVERY, against all vectors; ``top_k`` takes every vector as a query unless told otherwise.

Distances of all vectors to many pivots are computed once. |d(q, p) - d(x, p)| bounds d(q, x) from below for each pivot
p, and the largest bound counts. Vectors go to cells by nearest pivot, cells to blocks of bounded size; each block has
the range of its distances to each pivot. A query first searches its own block, which gives its first k-th distance;
then only blocks whose bound doesn't exceed that are visited, and in a block candidates are evaluated in the order of
their bounds, a tile of queries at a time, until the next bound exceeds the k-th distance so far. What is left out can't
be among the k nearest, so the result is exact: distances to pivots come from differences, and bounds give way by their
rounding (``slack``), at any scale of the vectors. Ranges of blocks are compared in groups. Queries travel, in the matrices of their block, only to blocks that their bound lets in; a
candidate block travels once. Only pivots are broadcast.

Result: (query_id, neighbor_id, rank, distance), Euclidean, ties by neighbor_id, never the query itself.

Defined results: rows with a null id or vector, with a null, NaN or infinite component, or with another length than most vectors
(the greater where two are as common) are left out; rows that share an id are one vector, the least; fewer than k
others give fewer rows; equal vectors are neighbours at distance 0. Ranks go by distances rounded to 9 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.session import materialise

K = 10
EVERY = 50  # ids that this divides are queries
PIVOTS = 32
BLOCK = 4096
PIVOT_POOL = 4096  # rows that pivots are chosen from; any pivots give exact results
TILE = 256  # queries that search together
MERGE = 4096  # queries that reach a block and are searched together, about
GROUP = 512  # blocks whose ranges are compared together
SCHEMA = "query_id long, neighbor_id long, distance double"


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that count."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    v = v.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").groupBy("id").agg(F.min("v").alias("v"))
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (most[0] if most else 0))


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the pool."""
    chosen = [int(np.argmax(((pool - pool.mean(0)) ** 2).sum(1)))]
    far = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(pool)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances [x x points] from differences, so that their error is relative to each distance."""
    out = np.empty((len(x), len(points)))
    for p, point in enumerate(points):
        out[:, p] = np.sqrt(((x - point) ** 2).sum(1))
    return out


def slack(most: float, kind=np.float64) -> float:
    """What a bound from distances of at most ``most`` can be too large by: rounding of both terms, and of ranks to 9 digits."""
    return 1e-9 + 8 * float(np.finfo(kind).eps) * most + 1e-14 * most


class Best:
    """The k nearest so far of each of n queries, as (rounded distance, id)."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None):
        self.d, self.i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.limit = np.full(n, np.inf) if limit is None else limit.copy()

    def add(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of any rows at once."""
        if not len(row):
            return
        k, touched = self.d.shape[1], np.unique(row)
        every = np.concatenate([np.repeat(touched, k), row])
        d, ids = np.concatenate([self.d[touched].ravel(), d]), np.concatenate([self.i[touched].ravel(), ids])
        by = np.lexsort((ids, d, every))
        begin = np.searchsorted(every[by], touched)
        by = by[(begin[:, None] + np.arange(k)).ravel()]
        self.d[touched], self.i[touched] = d[by].reshape(-1, k), ids[by].reshape(-1, k)
        self.limit[touched] = np.minimum(self.limit[touched], self.d[touched, -1])


def search_block(best: Best, queries: np.ndarray, q_pivot: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, ids: np.ndarray) -> int:
    """Search one block for all queries, TILE of them at a time; evaluated distances.

    Bounds of a tile are a matrix. Candidates come in the order of their least bound in the tile; a query takes part
    only where its own bound lets a candidate in, and it stops as no bound that is left does. Distances come from a
    matrix product, and those near the limit again from differences.
    """
    done, flat = 0, np.ascontiguousarray(pivot.T)
    x2, q2 = (vectors * vectors).sum(1), (queries * queries).sum(1)
    k, rounding = best.d.shape[1], 4e-16 * (vectors.shape[1] + 8)
    far = max(float(q_pivot.max(initial=0)), float(pivot.max(initial=0)))
    kind = np.float32 if far < 1e37 else np.float64
    spare = slack(far, kind)
    narrow = flat.astype(kind)
    for at in range(0, len(queries), TILE):
        rows = slice(at, at + TILE)
        limit, qp = best.limit[rows], q_pivot[rows]
        outside = np.maximum(qp.min(0)[:, None] - flat, flat - qp.max(0)[:, None]).max(0)
        cols = np.flatnonzero(outside <= limit.max() + spare)
        bound = np.zeros((len(qp), len(cols)), kind)
        for p in range(len(flat)):  # pivots drop candidates one after another
            gap = narrow[p, cols] - qp[:, p, None].astype(kind)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
            if p % 8 == 7:
                keep = (bound <= (limit + spare)[:, None].astype(kind) * kind(1 + 1e-6)).any(0)
                if keep.mean() < 0.7:
                    cols, bound = cols[keep], np.ascontiguousarray(bound[:, keep])
        least = bound.min(0, initial=np.inf)
        order, start, step = np.argsort(least, kind="stable"), 0, TILE
        while start < len(order) and least[order[start]] <= best.limit[rows].max() + spare:
            part = order[start : start + step]
            start, step = start + step, 2 * step
            limit = best.limit[rows]
            let_in = bound[:, part] <= (limit + spare)[:, None]
            live, some = np.flatnonzero(let_in.any(1)), np.flatnonzero(let_in.any(0))
            if not len(live):
                continue
            let_in, c = let_in[np.ix_(live, some)], cols[part[some]]
            let_in &= q_ids[at + live, None] != ids[c]
            d2 = q2[at + live, None] + x2[c] - 2 * (queries[at + live] @ vectors[c].T)
            d2[~let_in] = np.inf
            done += int(let_in.sum())
            error = rounding * (q2[at + live] + x2[c].max())
            cut = (limit[live] + 1e-9) ** 2 * (1 + 1e-12) + error
            if d2.shape[1] > k:
                cut = np.minimum(cut, (np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1] + error) + 1e-9) ** 2 * (1 + 1e-12) + error)
            r, j = np.nonzero((d2 <= cut[:, None]) & let_in)
            d = np.round(np.sqrt(((queries[at + live[r]] - vectors[c[j]]) ** 2).sum(1)), 9)
            near = d <= best.limit[at + live[r]]
            best.add(at + live[r[near]], d[near], ids[c[j[near]]])
    return done


def _matrix(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def top_k(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, every: int = 1) -> DataFrame:
    spark = C.prepare(vectors.sparkSession)
    rows = materialise(clean(vectors, key, vector), "topk-vectors")
    pool = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_POOL).select("v").collect()]
    if not pool or k < 1:
        return spark.createDataFrame([], "query_id long, neighbor_id long, rank int, distance double")
    chosen = choose_pivots(np.array(pool, np.float64), pivots)
    dim, n_pivots = chosen.shape[1], len(chosen)
    centres = chosen[: max(1, min(n_pivots, rows.count() // block))]  # about as many cells as blocks
    unit = max(float(distances(chosen, chosen[:1]).max()) / 128, 1e-30)  # the width of a ring

    def cells(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            d = distances(x, centres)
            yield C.table(id=batch.column(0), cell=d.argmin(1).astype(np.int32), near=d.min(1), v=C.pack(x.astype(np.float32), np.arange(len(x) + 1) * dim, 4))

    placed = rows.select("id", "v").mapInArrow(cells, "id long, cell int, near double, v binary")
    # blocks of bounded size: cells are cut by ranges of the distance to their pivot, from the counts of rings of one width
    placed = materialise(placed.withColumn("ring", F.floor(F.least(F.col("near") / unit, F.lit(1e6))).cast("long")), "topk-cells")
    rings = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"))
    before = W.partitionBy("cell").orderBy("ring").rowsBetween(W.unboundedPreceding, -1)
    rings = rings.withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block)).withColumn("parts", F.ceil(F.col("n") / block))
    numbered = placed.join(rings.select("cell", "ring", "first", "parts"), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def build(key_, t):
        ids = t.column("id").to_numpy()
        x = np.stack([np.frombuffer(b, np.float32) for b in t.column("v").to_pylist()])
        by = np.argsort(ids)
        d = distances(x[by].astype(np.float64), chosen)
        return pa.table({"name": pa.array(["-".join(str(c.as_py()) for c in key_)]), "ids": [ids[by].tobytes()], "vectors": [x[by].tobytes()], "pivot": [d.tobytes()], "low": [d.min(0).tobytes()], "high": [d.max(0).tobytes()]}, schema=pa.schema([("name", pa.string()), *((c, pa.binary()) for c in ("ids", "vectors", "pivot", "low", "high"))]))

    blocks = materialise(numbered.select("cell", "first", "ring", "parts", "part", "id", "v").withColumn("ring", F.when(F.col("parts") > 1, F.col("ring")).otherwise(-1)).groupBy("cell", "first", "ring", "part").applyInArrow(build, "name string, ids binary, vectors binary, pivot binary, low binary, high binary"), "topk-blocks")

    def arrays(ids, vectors, pivot):
        i = np.frombuffer(ids, np.int64)
        return i, np.frombuffer(vectors, np.float32).reshape(len(i), dim).astype(np.float64), np.frombuffer(pivot, np.float64).reshape(len(i), n_pivots)

    def own(batches):
        for batch in batches:
            for name, ids, vectors, pivot in zip(*(batch.column(c).to_pylist() for c in range(4))):
                i, x, p = arrays(ids, vectors, pivot)
                ask = i % every == 0
                if not ask.any():
                    continue
                q = i[ask]
                best = Best(len(q), k)
                search_block(best, x[ask], p[ask], q, x, p, i)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([q.tobytes()], pa.binary()), pa.array([x[ask].astype(np.float32).tobytes()], pa.binary()), pa.array([p[ask].min(0).tobytes()], pa.binary()), pa.array([p[ask].max(0).tobytes()], pa.binary()), pa.array([np.where(np.isfinite(best.d), best.i, -1).tobytes()], pa.binary()), pa.array([best.d.tobytes()], pa.binary()), pa.array([float(best.limit.max())])], names=["name", "q_ids", "q_vectors", "q_low", "q_high", "best_ids", "best", "limit"])

    first = materialise(blocks.select("name", "ids", "vectors", "pivot").mapInArrow(own, "name string, q_ids binary, q_vectors binary, q_low binary, q_high binary, best_ids binary, best binary, limit double"), "topk-own")
    asking = first.select("name", F.col("q_low").alias("low"), F.col("q_high").alias("high"), "limit")
    asked_of = blocks.select("name", "low", "high", F.lit(0.0).alias("limit"))

    def group(key_, t):
        low, high = (np.stack(_matrix(t.column(c).combine_chunks(), np.float64)) for c in ("low", "high"))
        limit = t.column("limit").to_numpy()
        return pa.table({"names": pa.array([t.column("name").to_pylist()]), "low": [low.tobytes()], "high": [high.tobytes()], "limits": [limit.tobytes()]}, schema=pa.schema([("names", pa.list_(pa.string())), *((c, pa.binary()) for c in ("low", "high", "limits"))]))

    def grouped(ranges, n):
        return ranges.groupBy(F.pmod(F.xxhash64("name"), F.lit(max(1, -(-n // GROUP))))).applyInArrow(group, "names array<string>, low binary, high binary, limits binary")

    def bound(batches):
        """Pairs of blocks in groups: first the groups' ranges, then the blocks'."""
        for batch in batches:
            for q_names, q_low, q_high, limits, names, low, high in zip(*(batch.column(c).to_pylist() for c in range(7))):
                q_low, q_high, low, high = (np.frombuffer(x, np.float64).reshape(-1, n_pivots) for x in (q_low, q_high, low, high))
                limits = np.frombuffer(limits, np.float64)
                spare = slack(max(q_high.max(), high.max()))
                if np.maximum(low.min(0) - q_high.max(0), q_low.min(0) - high.max(0)).max() > limits.max() + spare:
                    continue
                gap = np.full((len(q_low), len(low)), -np.inf)
                for p in range(n_pivots):
                    np.maximum(gap, low[:, p] - q_high[:, p, None], out=gap)
                    np.maximum(gap, q_low[:, p, None] - high[:, p], out=gap)
                r, c = np.nonzero(gap <= (limits + spare)[:, None])
                yield C.table(q_name=pa.array([q_names[k] for k in r], pa.string()), name=pa.array([names[k] for k in c], pa.string()))

    a, b = grouped(asking, first.count()).toDF("q_names", "q_low", "q_high", "q_limits"), grouped(asked_of, blocks.count()).select("names", "low", "high")
    pairs = a.crossJoin(b).mapInArrow(bound, "q_name string, name string").where("q_name <> name")
    q = first.select(F.col("name").alias("q_name"), "q_ids", "q_vectors", "best")
    asked = pairs.join(q, "q_name").join(blocks.select("name", "low", "high"), "name").select("name", "q_ids", "q_vectors", "best", "low", "high")

    def send(batches):
        """Of each query block the queries that a block can have news for."""
        for batch in batches:
            for name, ids, vectors, best, low, high in zip(*(batch.column(c).to_pylist() for c in range(6))):
                i = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors, np.float32).reshape(len(i), dim)
                limit = np.frombuffer(best, np.float64).reshape(len(i), k)[:, -1]
                p = distances(x.astype(np.float64), chosen)
                low, high = np.frombuffer(low, np.float64), np.frombuffer(high, np.float64)
                go = np.maximum(low - p, p - high).max(1) <= limit + slack(max(p.max(), high.max()))
                if go.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([1], pa.int32()), *(pa.array([a[go].tobytes()], pa.binary()) for a in (i, x, limit))], names=["name", "kind", "ids", "vectors", "extra"])

    sent = asked.mapInArrow(send, "name string, kind int, ids binary, vectors binary, extra binary")
    both = blocks.select("name", F.lit(0).alias("kind"), "ids", "vectors", F.col("pivot").alias("extra")).union(sent)

    def others(batches):
        here, block_, held = None, None, []
        for batch in batches:
            for name, kind, ids, vectors, extra in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if name != here or sum(len(i) for i, _, _ in held) >= 8 * MERGE:
                    yield from answer(block_, held)
                    here, held = name, []
                if kind == 0:
                    block_ = arrays(ids, vectors, extra)
                else:
                    held.append((ids, vectors, extra))
        yield from answer(block_, held)

    def answer(block_, held):
        """The queries that reach a block, searched together."""
        if not held:
            return
        i, x, p = block_
        qi, qx, limit = (np.frombuffer(b"".join(part), kind) for part, kind in zip(zip(*held), (np.int64, np.float32, np.float64)))
        qx = qx.reshape(len(qi), dim).astype(np.float64)
        best = Best(len(qi), k, limit)
        search_block(best, qx, distances(qx, chosen), qi, x, p, i)
        row, col = np.nonzero(np.isfinite(best.d))
        if len(row):
            yield C.table(query_id=qi[row], neighbor_id=best.i[row, col], distance=best.d[row, col])

    def unfold(batches):
        for batch in batches:
            for ids, best_ids, best in zip(*(batch.column(c).to_pylist() for c in range(3))):
                i = np.frombuffer(ids, np.int64)
                d = np.frombuffer(best, np.float64).reshape(len(i), k)
                row, col = np.nonzero(np.isfinite(d))
                yield C.table(query_id=i[row], neighbor_id=np.frombuffer(best_ids, np.int64).reshape(len(i), k)[row, col], distance=d[row, col])

    mine = first.select("q_ids", "best_ids", "best").mapInArrow(unfold, SCHEMA)
    ranked = mine.union(both.repartition("name").sortWithinPartitions("name", "kind").mapInArrow(others, SCHEMA)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", F.round("distance", 6).alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.read(spark, sf_dir, "embeddings"), every=EVERY)


def oracle(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_distance(a.e::DOUBLE[], b.e::DOUBLE[]), 9) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT query_id, neighbor_id, rank, round(d, 6) AS distance FROM r WHERE rank <= {k}"""
