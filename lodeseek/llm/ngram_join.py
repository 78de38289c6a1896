"""Operator 7, n-gram Jaccard join: every pair of documents whose sets of word n-grams have Jaccard similarity >= threshold.

Tokens (n-grams) are put in one global order, rare first, by their exact counts over the whole corpus. The counts come
from one exchange: documents are gathered in chunks of about a million tokens, written once; each chunk sends its sorted
distinct tokens to the ranges of the token space, each range adds them up and sends a code of one byte a token back.
A token that occurs in one document is in no pair and is never indexed. With o = the overlap that a partner needs at
least, two sets share two tokens among the first |x| - o + 2 of each, so a document indexes

* each rare token (at most RARE documents have it) among these, singly; two matches make a candidate; and
* if a frequent token is among these, combinations of frequent tokens: the prefix is extended to |x| - o + k tokens, of
  which a partner has at least k, and at least k - 1 of those are frequent, or two rare ones meet anyway; frequent
  tokens fall into k - 2 hash classes, so two common ones fall into one class, and every pair of tokens of one class is
  indexed; one match makes a candidate. k grows with the size level of the larger document, so classes stay small and
  the number of pairs linear.

Partners meet by index key; length and position filters and a rule that drops a key whose predecessors are common too
(then the pair was met there often enough) leave candidates, which are counted and verified by intersecting whole sets:
the sets of a neighbourhood travel once to one place. Documents with equal sets are one entity, indexed once.

Crowds, groups of many near copies, would meet at hundreds of keys, pair by pair. They are found by a MinHash key, and of
each the tokens that most of a sample have are its centre. Distance 1 - Jaccard is a metric: with members within r of the
centre, whatever is linked to one of them is within r + 1 - threshold of it. So one pass over all sets compares each with
the centres exactly; members leave the index, and meet one another and the visitors within that bound block by block,
where shared tokens come from matrix products. What makes no crowd stays in the index, so results don't depend on them.

Result: ``classes`` gives (doc_id, class_id, n_links), one row a document: the least doc_id of the documents connected by
pairs, and the number of documents that it is paired with. ``all_pairs`` gives every pair (doc_a, doc_b, jaccard), doc_a <
doc_b. ``join`` gives them compressed: of documents with equal sets the least doc_id stands for all in pairs with others,
and each other one is paired with it at 1.0.

Defined results: texts without a word, null texts and rows with a null doc_id are in no pair; a text of fewer than n
words has one n-gram of all its words; rows that share a doc_id never pair with each other; in n_links the texts of one doc_id add up;
columns besides doc_id and text are never read. Tokens are compared by 44 bits of their hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.session import discard, materialise

N = 2
THRESHOLD = 0.65
RARE = 32  # documents that have a rare token, at most
CHUNK = 1 << 20  # tokens gathered in a chunk, and counted in a range
TAGS = 3  # predecessors that a key carries
FEW = 4  # a token of so few documents carries none
BLOCK = 1 << 17  # tokens of a chunk that are indexed at once
COPIES = 1024  # copies of one set held in one row
MAX_BROADCAST_ENTITIES = 4_000_000
CROWD = 64  # different sets with one MinHash key that make a crowd
CROWDS = 256  # crowds at most, largest first
CENTRES = 1 << 20  # tokens of all centres, at most
SAMPLE = 32  # sets that a centre comes from
SIDE = 2048  # sets of a block of a crowd
SIDE_TOKENS = 1 << 21  # and their tokens, about
MIN_HASHES = tuple(C.U(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
LOW = C.U((1 << 44) - 1)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(x, 9)).astype(np.int64)


def _tokens(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token of 44 bits) of every n-gram of a slice."""
    grams, begin = C.Words(texts).grams(n)
    return np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begin)), grams >> C.U(20)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _entities(row: np.ndarray, token: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Entity (a hash of the set) and size of each row, from distinct (row, token)."""
    begin = np.searchsorted(row, np.arange(n_rows + 1, dtype=row.dtype))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(token + C.U(1)))])
    size = np.diff(begin)
    return C.mix((sums[begin[1:]] - sums[begin[:-1]]) ^ C.mix(size.astype(np.uint64))).view(np.int64), begin


def _marks(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A MinHash key of each set; first: where it begins."""
    out = np.zeros(len(first), np.uint64)
    for by in MIN_HASHES if len(first) else ():
        out = C.mix(out + np.minimum.reduceat(token * by, first))
    return out.view(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The bytes of integers, all lowest ones first; high ones are mostly 0 and shrink as they are written."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).ravel()


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def _sorted_bytes(tokens: np.ndarray) -> bytes:
    """Sorted distinct tokens as differences."""
    return _planes(np.diff(tokens, prepend=C.U(0)), 6)


def _sorted_tokens(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, 6), dtype=np.uint64)


class Chunk:
    """Documents' sets, token by token: (docs, sizes, entities) by ref; each token's refs follow each other."""

    SCHEMA = "chunk long, n_tokens long, docs binary, entities binary, marks binary, tokens binary, times binary, refs binary"

    @staticmethod
    def pack(name: int, docs: np.ndarray, entities: np.ndarray, marks: np.ndarray, ref: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(token << C.U(12) | ref)
        token, ref = keys >> C.U(12), keys & C.U(4095)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(token)])
        columns = (docs.tobytes(), entities.tobytes(), marks.tobytes(), _squeeze(_sorted_bytes(token[first])), _squeeze(_planes(times, 2)), _squeeze(_planes(ref, 2)))
        return C.table(chunk=pa.array([name], pa.int64()), n_tokens=pa.array([len(token)], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip(("docs", "entities", "marks", "tokens", "times", "refs"), columns)})


def gather(docs: DataFrame, n: int) -> DataFrame:
    """Chunks of all documents that have words, numbered by task, of at most 4,095 documents."""

    def work(batches):
        held, rows, size, name = [], 0, 0, TaskContext.get().partitionId() << 20
        for batch, texts in C.sliced(batches):
            row, token = _tokens(texts, n)
            keys = _distinct((row << C.U(44)) | token)
            row, token = keys >> C.U(44), keys & LOW
            entity, begin = _entities(row, token, len(texts))
            some = np.diff(begin) > 0
            n_some = int(some.sum())
            if rows + n_some > 4095 or size + len(token) > CHUNK and rows:
                yield flush(name, held)
                held, rows, size, name = [], 0, 0, name + 1
            ref = (np.cumsum(some) - 1)[row.astype(np.int64)] + rows
            held.append((C.ids(batch)[some], entity[some], _marks(token, begin[:-1][some]), ref.astype(np.uint64), token))
            rows, size = rows + n_some, size + len(token)
        if rows:
            yield flush(name, held)

    def flush(name, held):
        return Chunk.pack(name, *(np.concatenate(x) for x in zip(*held)))

    return materialise(C.each(docs, work, Chunk.SCHEMA), "ngram-chunks", **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4})


def members_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, entity, number) of every document; its number is chunk << 12 | ref."""

    def work(batches):
        for batch in batches:
            for chunk, docs, entities in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc = np.frombuffer(docs, np.int64)
                yield C.table(doc_id=doc, entity=np.frombuffer(entities, np.int64), number=(chunk << 12) + np.arange(len(doc)))

    return C.each(chunks.select("chunk", "docs", "entities"), work, "doc_id long, entity long, number long")


def _sets(tokens, times, refs, wanted: np.ndarray) -> list[np.ndarray]:
    """The sorted sets of the wanted refs of a chunk, from its unpacked columns."""
    place = np.full(4096, -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    own = place[refs.astype(np.int64)]
    keys = np.sort(own[own >= 0].astype(np.uint64) << C.U(44) | np.repeat(tokens, times)[own >= 0])
    return np.split(keys & LOW, np.searchsorted(keys >> C.U(44), np.arange(1, len(wanted), dtype=np.uint64)))


def _unpacked(batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, times, refs = (_unsqueeze(batch.column(batch.schema.get_field_index(c))[k].as_py()) for c in ("tokens", "times", "refs"))
    return _sorted_tokens(tokens), _from_planes(times, 2).astype(np.int64), _from_planes(refs, 2)


def centres(chunks: DataFrame, radius: float, crowd: int) -> list[np.ndarray]:
    """The centre of each crowd: tokens that most of a sample of its sets have. Any sets as centres give the same result."""

    def marked(batches):
        for batch in batches:
            for chunk, entities, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                mark = np.frombuffer(marks, np.int64)
                yield C.table(mark=mark, entity=np.frombuffer(entities, np.int64), number=(chunk << 12) + np.arange(len(mark)))

    rows = C.each(chunks.select("chunk", "entities", "marks"), marked, "mark long, entity long, number long")
    big = rows.select("mark", "entity").distinct().groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= crowd)
    big = [r["mark"] for r in big.orderBy(F.desc("n"), "mark").limit(CROWDS).collect()]
    if not big:
        return []
    some = rows.where(F.col("mark").isin(big)).groupBy("mark", "entity").agg(F.min("number").alias("number"))
    some = some.groupBy("mark").agg(F.slice(F.sort_array(F.collect_list("number")), 1, SAMPLE).alias("numbers")).collect()
    mark_of = {number: r["mark"] for r in some for number in r["numbers"]}
    wanted = np.array(sorted(mark_of), np.int64)

    def sample(batches):
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):
                here = wanted[(wanted >> 12) == chunk]
                sets = _sets(*_unpacked(batch, k), here & 4095)
                yield C.table(mark=np.array([mark_of[x] for x in here.tolist()]), tokens=pa.array([x.tobytes() for x in sets], pa.binary()))

    def most(key, t):
        token, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]), return_counts=True)
        return pa.table({"mark": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([token[2 * n > t.num_rows].tobytes()], pa.binary())})

    held = chunks.where(F.col("chunk").isin(np.unique(wanted >> 12).tolist())).select("chunk", "tokens", "times", "refs")
    found = {r["mark"]: np.frombuffer(r["tokens"], np.uint64) for r in C.each(held, sample, "mark long, tokens binary").groupBy("mark").applyInArrow(most, "mark long, tokens binary").collect()}
    out, size = [], 0
    for mark in big:
        x = found[mark]
        shared = [len(np.intersect1d(x, y, assume_unique=True)) for y in out]
        if len(x) and size + len(x) <= CENTRES and not any(n >= (1 - radius / 2) * (len(x) + len(y) - n) for n, y in zip(shared, out)):
            out.append(x)
            size += len(x)
    return out


def near_centres(chunks: DataFrame, found: list[np.ndarray], least: float) -> DataFrame:
    """(centre, number, near, tokens) of every document whose set has at least that Jaccard similarity with a centre."""
    every, whose = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
    by = np.argsort(every, kind="stable")
    every, whose, sizes = every[by], whose[by], np.array([len(x) for x in found])

    def work(batches):
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):
                tokens, times, refs = _unpacked(batch, k)
                a, b = np.searchsorted(every, tokens, "left"), np.searchsorted(every, tokens, "right")
                n = np.repeat(b - a, times)
                some = np.flatnonzero(n)
                size, n = np.bincount(refs.astype(np.int64)), n[some]
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.repeat(a, times)[some], n)
                shared = np.bincount(np.repeat(refs[some].astype(np.int64), n) * len(found) + whose[at], minlength=len(size) * len(found)).reshape(-1, len(found))
                near = shared / (size[:, None] + sizes - shared)
                ref, centre = np.nonzero(near >= least - 1e-9)
                if len(ref):
                    own, place = np.unique(ref, return_inverse=True)
                    packed = [x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in _sets(tokens, times, refs, own)]
                    yield C.table(centre=centre, number=(chunk << 12) + ref, near=near[ref, centre], tokens=pa.array([packed[p] for p in place], pa.binary()))

    return C.each(chunks.select("chunk", "tokens", "times", "refs"), work, "centre long, number long, near double, tokens binary")


def _shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of xs shares with each of ys: rare tokens pair by pair, frequent ones by matrix products."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    row, col = np.repeat(np.arange(len(xs)), [len(s) for s in xs]), np.repeat(np.arange(len(ys)), [len(s) for s in ys])
    token = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(token):
        return out
    kept = []
    for t, at in ((x, row), (y, col)):
        place = np.minimum(np.searchsorted(token, t), len(token) - 1)
        same = token[place] == t
        by = np.argsort(place[same], kind="stable")
        kept += [place[same][by], at[same][by]]
    x, row, y, col = kept
    nx, ny = np.bincount(x, minlength=len(token)), np.bincount(y, minlength=len(token))
    rare = nx * ny < max(1, out.size // 256)
    begin, n = np.cumsum(ny) - ny, np.where(rare, ny, 0)[x]
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) >> 22)) + 1, len(x)]
    for a, b in zip(cuts, cuts[1:]):
        m = n[a:b]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[x[a:b]], m)
        if len(at):
            out += np.bincount(np.repeat(row[a:b], m) * len(ys) + col[at], minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(~rare)
    for c in range(0, len(often), 2048):
        part = often[c : c + 2048]
        column = np.full(len(token), -1)
        column[part] = np.arange(len(part))
        sides = []
        for t, at, height in ((x, row, len(xs)), (y, col, len(ys))):
            side = np.zeros((height, len(part)), np.float32)
            live = column[t] >= 0
            side[at[live], column[t[live]]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _mates(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that connect what all of hit's do."""
    new_row, new_col, out = np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool), []
    for start in range(hit.shape[0]):
        rows = np.array([start]) if new_row[start] else ()
        while len(rows):
            new_row[rows] = False
            first = hit[rows]
            cols = np.flatnonzero(first.any(0) & new_col)
            new_col[cols] = False
            out.append((rows[first[:, cols].argmax(0)], cols))
            back = hit[np.ix_(new_row, cols)]
            some = back.any(1)
            rows = np.flatnonzero(new_row)[some]
            out.append((rows, cols[back[some].argmax(1)] if len(rows) else rows))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def crowded(held: DataFrame, t: float, pairs: bool) -> DataFrame:
    """Links of members of crowds, from (centre, number, weight, member, tokens): as pairs (a, b, jaccard), or as (a, b, links).

    In the second form rows with links null are edges that connect what all links do, and in the others b is null and
    links adds up to the documents that a is linked to.
    """
    sides = held.groupBy("centre").agg(*(F.greatest(F.ceil(F.sum(c) / SIDE), F.ceil(F.sum(F.when(c > 0, F.length("tokens"))) / (6 * SIDE_TOKENS)), F.lit(0)).alias(name) for name, c in (("inner", F.col("member").cast("int")), ("outer", 1 - F.col("member").cast("int")))))
    held = held.join(F.broadcast(sides.where("inner > 0")), "centre").withColumn("side", F.when(F.col("member"), F.pmod(F.xxhash64("number"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("number"), F.greatest("outer", F.lit(1)))))
    held = held.withColumn("other", F.explode(F.when(F.col("member"), F.sequence(F.lit(0).cast("long"), F.col("inner") + F.col("outer") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("inner") - 1))))
    held = held.select("centre", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "number", "weight", "tokens")

    def meet(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        side, number, weight = (table.column(c).to_numpy() for c in ("side", "number", "weight"))
        sets = []
        for raw in table.column("tokens").to_pylist():
            wide = np.zeros((len(raw) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            sets.append(wide.view(np.uint64).ravel())
        x, y = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b, links, near = [], [], [], []
        if len(x) and len(y):
            shared = _shared([sets[k] for k in x], [sets[k] for k in y]).astype(np.float64)
            size = np.array([len(s) for s in sets])
            shared /= size[x][:, None] + size[y] - shared
            hit = shared >= t - 1e-12
            if i == j:
                np.fill_diagonal(hit, False)
            if pairs:
                r, c = np.nonzero(np.triu(hit) if i == j else hit)
                a, b, near = number[x[r]], number[y[c]], shared[r, c]
            else:
                r, c = _mates(hit)
                n = hit @ weight[y].astype(np.float64)
                m = weight[x].astype(np.float64) @ hit if i != j else np.zeros(0)
                x_, y_ = np.flatnonzero(n), np.flatnonzero(m)
                nothing = np.full(len(x_) + len(y_), None)
                a = np.concatenate([number[x[r]], number[x[x_]], number[y[y_]]])
                b = np.concatenate([number[y[c]], nothing]).tolist()
                links = np.full(len(r), None).tolist() + n[x_].astype(np.int64).tolist() + m[y_].astype(np.int64).tolist()
        if pairs:
            return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "jaccard": pa.array(near, pa.float64())})
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return held.groupBy("centre", "i", "j").applyInArrow(meet, "a long, b long, " + ("jaccard double" if pairs else "links long"))


def _code(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1.0 + count))).astype(np.uint8)


ONCE = int(_code(np.array(1)))


def codes_of(chunks: DataFrame) -> DataFrame:
    """(chunk, part, codes): the code of the count of each distinct token of a chunk, range by range."""
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // CHUNK))
    edges = np.array([(p << 44) // parts for p in range(parts + 1)], np.uint64)

    def send(batches):
        for batch in batches:
            for chunk, tokens, times in zip(*(batch.column(k).to_pylist() for k in range(3))):
                token, times = _sorted_tokens(_unsqueeze(tokens)), _from_planes(_unsqueeze(times), 2)
                at = np.searchsorted(token, edges)
                some = np.flatnonzero(np.diff(at))
                yield C.table(part=some, chunk=np.full(len(some), chunk), tokens=pa.array([_sorted_bytes(token[at[p] : at[p + 1]]) for p in some], pa.binary()), times=pa.array([_planes(times[at[p] : at[p + 1]], 2) for p in some], pa.binary()))

    def add(batches):
        here, held = None, []
        for batch in batches:
            for part, chunk, tokens, times in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if part != here and held:
                    yield sums(here, held)
                    held = []
                here = part
                held.append((chunk, tokens, times))
        if held:
            yield sums(here, held)

    def sums(part, held):
        tokens = [_sorted_tokens(x) for _, x, _ in held]
        every = np.concatenate(tokens)
        by = np.argsort(every)
        token = every[by]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.add.reduceat(np.concatenate([_from_planes(x, 2) for _, _, x in held])[by].astype(np.int64), first)
        code = np.empty(len(every), np.uint8)
        code[by] = np.repeat(_code(count), np.diff(np.r_[first, len(token)]))
        cuts = np.cumsum([0, *map(len, tokens)])
        return C.table(chunk=np.array([c for c, _, _ in held]), part=np.full(len(held), part), codes=pa.array([_squeeze(code[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary()))

    sent = C.each(chunks.select("chunk", "tokens", "times"), send, "part long, chunk long, tokens binary, times binary")
    return materialise(sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "chunk long, part long, codes binary"), "ngram-codes")


class Levels:
    """Size levels and the combinations' k at each."""

    def __init__(self, t: float, most: int = 1 << 40):
        self.low = [1]
        while self.low[-1] < most:
            self.low.append(max(self.low[-1] + 1, math.ceil(round((1 / t) ** len(self.low), 9))))
        self.low = np.array(self.low)
        self.k = np.array([1 + max(0, min(int(x) // 4 or 1, math.ceil(round(t * int(x), 9)) - 1)) for x in self.low])

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1


def _tags(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The TAGS items before each one of x, 0 where there are fewer; pos: the place in the list that each is in."""
    out = np.zeros((len(x), TAGS), np.uint64)
    for k in range(1, TAGS + 1):
        out[k:, k - 1] = x[:-k]
        out[pos < k, k - 1] = 0
    return out


def _combinations(token: np.ndarray, size: int, t: float, levels: Levels, first: int):
    """(key, may stand for the smaller, TAGS predecessors) for the frequent tokens at positions first, first + 1, ... of a document."""
    level = levels.of(size)
    out = []
    for at, whole in ((level, True), (level + 1, False)):
        k = int(levels.k[at])
        small = size - math.ceil(round(2 * t / (1 + t) * size, 9)) + k
        end = min(size, size - math.ceil(round(t * size, 9)) + k if whole else small)
        tok = token[first:end]
        if not len(tok):
            continue
        pos = np.arange(first, end)
        salt = C.U((at + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        if k <= 2:
            a = b = np.arange(len(tok))
        else:
            kind = (tok * C.U(0xD6E8FEB86659FD93) >> C.U(33)).astype(np.int64) % (k - 2)
            by = np.lexsort((pos, kind))
            kind = kind[by]
            left, right, d = [], [], 1
            live = np.arange(len(kind) - 1)
            while True:
                live = live[live + d < len(kind)]
                live = live[kind[live] == kind[live + d]]
                if not len(live):
                    break
                left.append(by[live])
                right.append(by[live + d])
                d += 1
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
        key = C.mix(tok[a] * C.U(0xC2B2AE3D27D4EB4F) + C.mix(tok[b] + salt))
        able = np.maximum(pos[a], pos[b]) < small
        by = np.lexsort((key, ~able))
        key, able = key[by], able[by]
        out.append((key, able, _tags(key, np.arange(len(key)))))
    return out


def signatures(chunks: DataFrame, codes: DataFrame, copies: DataFrame, t: float, rare: int) -> DataFrame:
    """(key, number, place, tag0, ...): place = size << 32 | position << 2 | by itself << 1 | may stand for the smaller of a pair.

    copies: (chunk, refs) of documents whose set another one stands for.
    """
    levels, most, few = Levels(t), int(_code(np.array(rare))), int(_code(np.array(FEW)))

    def work(batches):
        codes_, gone = [], np.zeros(0, np.int32)
        for batch in batches:
            for chunk, kind, codes, refs, docs, times, tokens, ref in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "kind", "codes", "gone", "docs", "times", "tokens", "refs"))):
                if kind.as_py() == 0:
                    codes_.append(_unsqueeze(codes.as_py()))
                elif kind.as_py() == 1:
                    gone = refs.values.to_numpy()
                else:
                    code = np.frombuffer(b"".join(codes_), np.uint8)
                    yield from index(code, gone, (chunk.as_py() << 12) + np.arange(len(docs.as_py()) // 8), *(_unsqueeze(x.as_py()) for x in (times, tokens, ref)))
                    codes_, gone = [], np.zeros(0, np.int32)

    def index(code, gone, number, times, tokens, ref):
        times = _from_planes(times, 2).astype(np.int64)
        ref = _from_planes(ref, 2)
        alive = np.ones(len(number), bool)
        alive[gone] = False
        alive = alive[ref.astype(np.int64)]
        keys = (ref << C.U(52) | np.repeat(code.astype(np.uint64) << C.U(44) | _sorted_tokens(tokens), times))[alive]
        keys.sort()
        begin = np.searchsorted(keys >> C.U(52), np.arange(len(number) + 1, dtype=np.uint64))
        first = 0
        while first < len(number):  # some documents at once
            last = max(first + 1, int(np.searchsorted(begin, begin[first] + BLOCK, "right")) - 1)
            yield from block(keys[begin[first] : begin[last]], number[first:last], begin[first : last + 1] - begin[first])
            first = last

    def block(keys, number, begin):
        size = np.diff(begin)
        row, token, code = np.repeat(np.arange(len(number)), size), keys & LOW, (keys >> C.U(44)) & C.U(255)
        pos = np.arange(len(keys)) - begin[:-1][row]
        p1 = size - _ceil(t * size) + 2
        small = size - _ceil(2 * t / (1 + t) * size) + 2
        seldom = code <= most
        at = np.flatnonzero(seldom & (code > ONCE) & (pos < p1[row]))
        tags = _tags(token, pos)[at]
        tags[code[at] <= few] = 0
        r = row[at]
        yield rows_of(token[at] << C.U(20), number[r], size[r] << 32 | pos[at] << 2 | (pos[at] < small[r]), tags)
        seldom_count = np.bincount(row[seldom], minlength=len(number))
        out, held = [], 0
        for r in np.flatnonzero((seldom_count < p1) & (seldom_count < size)):
            for key, able, prev in _combinations(token[begin[r] : begin[r + 1]], int(size[r]), t, levels, int(seldom_count[r])):
                out.append((key, np.full(len(key), number[r]), (int(size[r]) << 32) | 2 | able.astype(np.int64), prev))
                held += len(key)
            if held > 100_000:
                yield flush(out)
                out, held = [], 0
        if out:
            yield flush(out)

    def flush(out):
        return rows_of(*(np.concatenate(x) for x in zip(*out)))

    def rows_of(key, number, place, tags):
        return C.table(key=key.view(np.int64), number=number, place=place, **{f"tag{k}": np.ascontiguousarray(tags[:, k]).view(np.int64) for k in range(TAGS)})

    none = F.lit(None)
    bodies = chunks.select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("part"), none.cast("binary").alias("codes"), none.cast("array<int>").alias("gone"), "docs", "tokens", "times", "refs")
    blank = [none.cast("binary").alias(c) for c in ("docs", "tokens", "times", "refs")]
    rows = codes.select("chunk", F.lit(0).alias("kind"), "part", "codes", none.cast("array<int>").alias("gone"), *blank)
    rows = rows.union(copies.select("chunk", F.lit(1), F.lit(0).cast("long"), none.cast("binary"), "refs", *blank)).union(bodies)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(work, "key long, number long, place long, " + ", ".join(f"tag{k} long" for k in range(TAGS)))


def _grouped(batches, *names):
    """Column arrays of sorted batches, cut so that no run of the first column is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut == 0 and (not held or held[-1][0][-1] == now[0][0]):
            held.append(now)
            continue
        held.append([x[:cut] for x in now])
        yield [np.concatenate(x) for x in zip(*held)]
        held = [[x[cut:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def candidates(signed: DataFrame, t: float) -> DataFrame:
    """Distinct (a, b) of documents' numbers, a < b, that meet often enough and pass the filters where they meet."""

    def work(batches):
        for key, entity, place, *tags in _grouped(batches, "key", "number", "place", *(f"tag{k}" for k in range(TAGS))):
            first = np.r_[True, (key[1:] != key[:-1]) | (entity[1:] != entity[:-1])]
            key, entity, place, tags = key[first], entity[first], place[first], np.stack(tags, 1)[first]
            size, pos, alone, able = place >> 32, (place & 0xFFFFFFFF) >> 2, (place & 2) > 0, (place & 1) > 0
            live, d, out, held = np.flatnonzero(key[1:] == key[:-1]), 1, [], 0
            while len(live):
                i, j = live, live + d
                j_small = (size[j] < size[i]) | ((size[j] == size[i]) & (entity[j] < entity[i]))
                y, x = np.where(j_small, j, i), np.where(j_small, i, j)
                need = _ceil(t / (1 + t) * (size[x] + size[y]))
                most = np.minimum(pos[x], pos[y]) + np.minimum(size[x] - pos[x], size[y] - pos[y])
                ok = able[y] & (size[y] >= t * size[x] - 1e-9) & (most >= need)
                x, y, need = x[ok], y[ok], need[ok]
                common, tx, ty = np.zeros(len(x), np.int8), tags[x], tags[y]
                for k in range(TAGS):
                    common += (tx[:, k, None] == ty).any(1) & (tx[:, k] != 0)
                ok = common < np.where(alone[x], 1, 2)  # else they met at those
                x, y, need = x[ok], y[ok], need[ok]
                if len(x):
                    a, b = entity[x], entity[y]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.where(alone[x] | (need < 2), 2, 1)]))
                    held += out[-1].shape[1]
                if held > 400_000:
                    yield _pairs(out)
                    out, held = [], 0
                d += 1
                live = live[live + d < len(key)]
                live = live[key[live] == key[live + d]]
            if held:
                yield _pairs(out)

    met = signed.repartition("key").sortWithinPartitions("key", "number").mapInArrow(work, "a long, b long, times long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times")).where("times >= 2").select("a", "b")


def _pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    a, b, times = np.concatenate(parts, axis=1)
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return C.table(a=a[new], b=b[new], times=np.add.reduceat(times[by], new))


def verify(docs: DataFrame, pairs: DataFrame, least: DataFrame, n: int, t: float, max_broadcast: int) -> DataFrame:
    """(a, b, jaccard) of the pairs of numbers that hold; sets meet at the least candidate neighbour of a pair's document.

    least: (number, entity, doc_id), the documents that stand for entities; only their sets travel.
    """
    home = pairs.groupBy(F.col("b").alias("e")).agg(F.min("a").alias("home"))
    placed = pairs.join(home, pairs["a"] == home["e"], "left").select(F.coalesce("home", "a").alias("site"), "a", "b")
    placed = materialise(placed, "ngram-placed")
    wanted = placed.select("site", F.col("a").alias("number")).union(placed.select("site", "b")).distinct().join(least, "number").select("site", "number", "entity", "doc_id")
    wanted = materialise(wanted, "ngram-wanted")
    at_hand = wanted.count() <= max_broadcast
    if at_hand:
        got = wanted.toArrow()
        entity, site, number, stands = (got.column(c).to_numpy() for c in ("entity", "site", "number", "doc_id"))
        by = np.argsort(entity, kind="stable")
        entity, site, number, stands = entity[by], site[by], number[by], stands[by]

    def sets(batches):
        for batch, texts in C.sliced(batches):
            doc = C.ids(batch)
            row, token = _tokens(texts, n)
            keys = _distinct((row << C.U(44)) | token)
            row, token = keys >> C.U(44), keys & LOW
            own, begin = _entities(row, token, len(texts))
            if at_hand:
                a, b = np.searchsorted(entity, own, "left"), np.searchsorted(entity, own, "right")
                rows = [(r, site[k], number[k]) for r in np.flatnonzero(b > a) if stands[a[r]] == doc[r] for k in range(a[r], b[r])]
            else:
                rows = [(r, 0, 0) for r in np.flatnonzero(np.diff(begin) > 0)]
            if rows:
                packed = [token[begin[r] : begin[r + 1]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for r, _, _ in rows]
                r = np.array([r for r, _, _ in rows])
                yield C.table(site=np.array([s for _, s, _ in rows], np.int64), number=np.array([x for _, _, x in rows], np.int64), entity=own[r], doc_id=doc[r], tokens=pa.array(packed, pa.binary()))

    shipped = C.each(docs if at_hand else docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), sets, "site long, number long, entity long, doc_id long, tokens binary")
    if not at_hand:
        shipped = shipped.drop("site", "number").join(wanted, ["entity", "doc_id"])
    none = F.lit(None).cast("binary")
    both = shipped.select("site", F.lit(0).alias("kind"), F.col("number").alias("a"), F.lit(0).cast("long").alias("b"), "tokens").union(placed.select("site", F.lit(1), "a", "b", none))

    def check(batches):
        here, known = None, {}
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            tokens, out = batch.column(4), []
            for k, (s, kind, a, b) in enumerate(zip(*columns)):
                if s != here:
                    here, known = s, {}
                if kind == 0:
                    raw = np.frombuffer(tokens[k].as_buffer(), np.uint8).reshape(-1, 6)
                    wide = np.zeros((len(raw), 8), np.uint8)
                    wide[:, :6] = raw
                    known[a] = wide.view(np.uint64).ravel()
                else:
                    x, y = known[a], known[b]
                    if len(x) > len(y):
                        x, y = y, x
                    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    j = shared / (len(x) + len(y) - shared)
                    if j >= t - 1e-12:
                        out.append((a, b, j))
            if out:
                yield C.table(a=np.array([o[0] for o in out]), b=np.array([o[1] for o in out]), jaccard=np.array([o[2] for o in out]))

    return both.repartition("site").sortWithinPartitions("site", "kind").mapInArrow(check, "a long, b long, jaccard double")


class Found:
    """What the join finds. near: pairs (a, b, jaccard) of numbers outside crowds; crowds: what ``crowded`` takes, or None;
    members: (doc_id, entity) of every document, an entity being named by the number of its least document."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, rare: int, max_broadcast_entities: int, crowd: int):
        self.threshold = threshold
        docs = C.known(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        chunks = gather(docs, n)
        members = materialise(members_of(chunks), "ngram-members")
        least = members.groupBy("entity").agg(F.min(F.struct("doc_id", "number")).alias("least"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("weight"))
        least = materialise(least.select("entity", "least.doc_id", "least.number", "n", "weight"), "ngram-least")
        rest = members.join(least.where("n > 1").select("entity", F.col("number").alias("least")), "entity").where("number <> least").select("number")
        radius, self.crowds = min(1 - threshold, threshold / 2), None
        found = centres(chunks, radius, crowd) if crowd else []
        if found:
            held = materialise(near_centres(chunks, found, threshold - radius), "ngram-crowds")
            held = held.join(least.select("number", "weight"), "number")
            own = held.where(F.col("near") >= 1 - radius).groupBy("number").agg(F.min(F.struct(-F.col("near"), "centre")).alias("own")).select("number", F.col("own.centre").alias("own"))
            own = materialise(own, "ngram-own")
            rest = rest.union(own.select("number"))
            held = held.join(own, "number", "left").where("own IS NULL OR own >= centre")
            self.crowds = held.select("centre", "number", "weight", F.coalesce(F.col("own") == F.col("centre"), F.lit(False)).alias("member"), "tokens")
        copies = rest.groupBy(F.shiftright("number", 12).alias("chunk")).agg(F.collect_list(F.col("number").bitwiseAND(4095).cast("int")).alias("refs"))
        codes = codes_of(chunks)
        signed = materialise(signatures(chunks, codes, copies, threshold, rare), "ngram-index")
        discard(chunks, codes)
        pairs = materialise(candidates(signed, threshold), "ngram-pairs")
        discard(signed)
        self.near = verify(docs, pairs, least.select("entity", "doc_id", "number"), n, threshold, max_broadcast_entities)
        self.members = members.join(least.select("entity", F.col("number").alias("least")), "entity").select("doc_id", F.col("least").alias("entity")).distinct()
        self.least = least.select(F.col("number").alias("entity"), F.col("doc_id").alias("doc_a"), F.col("weight").alias("__n"))

    def pairs(self) -> DataFrame:
        """(a, b, jaccard) of all entities."""
        return self.near if self.crowds is None else self.near.union(crowded(self.crowds, self.threshold, True))

    def compressed(self, pairs: DataFrame) -> DataFrame:
        """Pairs of entities as pairs of their least documents, and each other document of an entity with its least."""
        first, second = self.least.select(F.col("entity").alias("a"), F.col("doc_a").alias("x")), self.least.select(F.col("entity").alias("b"), F.col("doc_a").alias("y"))
        near = pairs.join(first, "a").join(second, "b").where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
        equal = self.members.join(self.least.where("__n > 1"), "entity").where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
        return near.union(equal)

    def edges(self) -> tuple[DataFrame, DataFrame]:
        """Edges (u, v) of documents that connect what all pairs do, and (entity, links) that add up to each entity's linked documents but its own, in linear size."""
        near, weight = materialise(self.near, "ngram-near"), self.least.select(F.col("entity").alias("a"), "__n")
        both = near.select(F.col("b").alias("a"), F.col("a").alias("entity")).union(near.select("a", F.col("b").alias("entity")))
        links, pairs = both.join(weight, "a").select("entity", F.col("__n").alias("links")), near
        if self.crowds is not None:
            met = materialise(crowded(self.crowds, self.threshold, False), "ngram-met")
            links = links.union(met.where("links IS NOT NULL").select("a", "links"))
            pairs = near.union(met.where("links IS NULL").select("a", "b", F.lit(1.0)))
        return self.compressed(pairs).select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")), links


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rare: int = RARE, max_broadcast_entities: int = MAX_BROADCAST_ENTITIES, crowd: int = CROWD) -> DataFrame:
    """(doc_a, doc_b, jaccard), compressed as the module says."""
    found = Found(docs, n, threshold, rare, max_broadcast_entities, crowd)
    return found.compressed(found.pairs())


def all_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rare: int = RARE, max_broadcast_entities: int = MAX_BROADCAST_ENTITIES, crowd: int = CROWD) -> DataFrame:
    """(doc_a, doc_b, jaccard) of every pair: entities are joined back to all their documents, which travel as lists of up to about COPIES."""
    found = Found(docs, n, threshold, rare, max_broadcast_entities, crowd)
    near, members = found.pairs(), found.members
    count = members.groupBy("entity").agg(F.ceil(F.count("*") / COPIES).alias("__lists"))
    lists = members.join(count, "entity").groupBy("entity", F.pmod(F.xxhash64("doc_id"), "__lists").alias("__list")).agg(F.collect_list("doc_id").alias("docs"))
    lists = materialise(lists, "ngram-lists")
    first, second = lists.select(F.col("entity").alias("a"), F.col("docs").alias("xs")), lists.select(F.col("entity").alias("b"), F.col("docs").alias("ys"))
    near = near.join(first, "a").join(second, "b").select(F.explode("xs").alias("x"), "ys", "jaccard").select("x", F.explode("ys").alias("y"), "jaccard").where("x <> y")
    near = near.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    several = count.where("__lists > 1").select(F.col("entity").alias("b"))
    equal = lists.where("size(docs) > 1").select(F.col("docs").alias("xs"), F.col("docs").alias("ys"))
    equal = equal.union(first.join(second.join(several, "b", "left_semi"), (F.col("a") == F.col("b")) & (F.col("xs") != F.col("ys"))).select("xs", "ys"))
    equal = equal.select(F.explode("xs").alias("doc_a"), "ys").select("doc_a", F.explode("ys").alias("doc_b")).where("doc_a < doc_b")
    return near.union(equal.withColumn("jaccard", F.lit(1.0)))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rare: int = RARE, max_broadcast_entities: int = MAX_BROADCAST_ENTITIES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, class_id, n_links) of every doc_id but null: the least doc_id connected with it by pairs, and how many documents it is paired with."""
    found = Found(docs, n, threshold, rare, max_broadcast_entities, crowd)
    edges, links = found.edges()
    root = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))
    links = links.union(found.least.select("entity", F.col("__n") - 1)).groupBy("entity").agg(F.sum("links").alias("links"))
    per = found.members.join(links, "entity").groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    every = C.known(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return every.join(root, "doc_id", "left").join(per, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (u, v) with the least node of its component, by large-star and small-star steps."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star")
    last = None
    while True:
        old = edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, large["u"] == low["w"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "star")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        last = now


def keep_one(docs: DataFrame, max_broadcast_ids: int = 4_000_000, n: int = N, threshold: float = THRESHOLD, rare: int = RARE, max_broadcast_entities: int = MAX_BROADCAST_ENTITIES, crowd: int = CROWD) -> DataFrame:
    """The rows of docs without all but the least doc_id of each group of near copies (groups: connected pairs).

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    """
    edges, _ = Found(docs, n, threshold, rare, max_broadcast_entities, crowd).edges()
    gone = materialise(components(edges).select(F.col("node").alias("__gone_id")), "ngram-gone")
    if gone.limit(max_broadcast_ids + 1).count() <= max_broadcast_ids:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.read(spark, sf_dir, "documents"))


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for classes and links from every pair, by brute force over shared n-grams."""
    word = r"'[a-z0-9\x{80}-\x{10FFFF}]+'"
    return f"""
WITH RECURSIVE g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram
 FROM (SELECT doc_id, regexp_extract_all(lower(text), {word}) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT s.doc_a, s.doc_b FROM shared s JOIN sets a ON a.doc_id = s.doc_a JOIN sets b ON b.doc_id = s.doc_b WHERE s.n / (a.size + b.size - s.n) >= {threshold} - 1e-12),
links AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
root AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
linked AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(least(r.y, d.doc_id), d.doc_id) AS class_id, coalesce(n.n, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN root r ON r.x = d.doc_id LEFT JOIN linked n ON n.x = d.doc_id"""
