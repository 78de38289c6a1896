"""Operator 2, benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of its distinct word n-grams occur there. Items are put in
classes by their number of n-grams, (m/2, m] for powers of two m. For class m a document is cut into windows of 3m/2
consecutive n-grams that begin every m/2, so a passage of up to m n-grams lies whole in one of them and the Jaccard
similarity of a matching item and window has a lower bound; the number of MinHash permutations follows from that bound
and the wanted recall (bands of one row). Minima of blocks of m/2 n-grams are computed once for the smallest class and
combined for the larger. Candidates are verified by counting the item's n-grams in the whole document, exactly.

The items' index is held by every worker while it has at most MAX_BROADCAST_ITEMS items of MAX_BROADCAST_BYTES; beyond that, window minima
that pass a sieve of the item minima meet these in a shuffle join, and verification joins texts to candidates. Both give the same rows.

Defined results: null or empty texts and items, and rows with null ids, match nothing; an item of fewer than n words
has one n-gram of all its words and so matches only documents with just these words; copies of a document or an item
each match; columns besides ids and texts are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.session import materialise

N = 3
THRESHOLD = 0.6
RECALL = 0.998
MAX_BROADCAST_ITEMS = 100_000
MAX_BROADCAST_BYTES = 32 << 20
SIEVE_BITS = 28  # of the sieve of item keys in the shuffle path, 32 MB at most
SCHEMA = "doc_id long, item_id long, n_shared long, n_grams long, containment double"


def permutations(threshold: float, recall: float) -> int:
    """Bands of one row that find the worst-placed match of a class with probability ``recall``."""
    j = threshold / 2 / (1.5 + 0.5 - threshold / 2)  # q = m/2 against a window of 3m/2
    return math.ceil(math.log(1 - recall) / math.log(1 - j))


class Scheme:
    def __init__(self, n: int, threshold: float, recall: float, seed: int = 11):
        self.n, self.threshold = n, threshold
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, permutations(threshold, recall), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def item_class(self, size: int) -> int:
        return max(1, math.ceil(math.log2(size))) if size > 1 else 1

    def item_minima(self, grams: np.ndarray) -> np.ndarray:
        return (grams[:, None] * self.factors).min(0)

    def windows(self, grams: np.ndarray, begin: np.ndarray, classes: list[int]):
        """For each class k (m = 2^k): minima of the windows [windows x permutations] and their rows."""
        counts = np.diff(begin)
        step = 1 << (classes[0] - 1)
        blocks = -(-counts // step)
        row = np.repeat(np.arange(len(counts)), blocks)
        at = np.cumsum(blocks) - blocks
        starts = begin[row] + (np.arange(len(row)) - at[row]) * step
        if not len(starts):
            return
        minima = np.empty((len(starts), len(self.factors)), np.uint64)
        for p, f in enumerate(self.factors):
            minima[:, p] = np.minimum.reduceat(grams * f, starts)
        for k in range(classes[0], classes[-1] + 1):
            if k in classes:
                window = minima.copy()
                for ahead in (1, 2):
                    same = row[ahead:] == row[:-ahead]
                    np.minimum(window[:-ahead], np.where(same[:, None], minima[ahead:], window[:-ahead]), out=window[:-ahead])
                yield k, window, row
            if k < classes[-1]:  # join blocks two by two
                place = np.arange(len(row)) - np.searchsorted(row, row)
                even = np.flatnonzero(place % 2 == 0)
                nxt = np.minimum(even + 1, len(row) - 1)
                paired = (row[nxt] == row[even]) & (nxt > even)
                minima = np.where(paired[:, None], np.minimum(minima[even], minima[nxt]), minima[even])
                row = row[even]


def _item_grams(texts: pa.Array, n: int) -> list[np.ndarray]:
    grams, begin = C.Words(texts).grams(n)
    return [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:])]


class Index:
    """What a worker needs to find and verify items."""

    def __init__(self, scheme: Scheme, ids: list[int], texts: list[str]):
        self.scheme = scheme
        sets = _item_grams(pa.array([t or "" for t in texts], pa.large_string()), scheme.n)
        kept = [(i, s) for i, s in zip(ids, sets) if i is not None and len(s)]
        self.ids, self.sets = np.array([i for i, _ in kept], np.int64), [s for _, s in kept]
        self.by_class: dict[int, tuple[np.ndarray, list]] = {}
        kinds = np.array([scheme.item_class(len(s)) for s in self.sets], np.int64)
        for k in np.unique(kinds):
            members = np.flatnonzero(kinds == k)
            minima = np.array([scheme.item_minima(self.sets[m]) for m in members])
            sorted_by = []
            for p in range(minima.shape[1]):
                o = np.argsort(minima[:, p], kind="stable")
                sorted_by.append((minima[o, p], members[o]))
            self.by_class[int(k)] = sorted_by
        self.classes = sorted(self.by_class)

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared n-grams) of the matches in a slice."""
        grams, begin = C.Words(texts).grams(self.scheme.n)
        found: list[np.ndarray] = []
        m = len(self.sets)
        if self.classes and len(grams):
            for k, window, row in self.scheme.windows(grams, begin, self.classes):
                for p, (values, members) in enumerate(self.by_class[k]):
                    a = np.searchsorted(values, window[:, p], "left")
                    hit = np.flatnonzero(values[np.minimum(a, len(values) - 1)] == window[:, p])
                    if len(hit):
                        b = np.searchsorted(values, window[hit, p], "right")
                        many = b - a[hit]
                        pos = np.repeat(a[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        found.append(np.unique(np.repeat(row[hit], many) * m + members[pos]))
        rows, items, shared = [], [], []
        if found:
            pairs = np.unique(np.concatenate(found))
            last, own = -1, None
            for r, i in zip(pairs // m, pairs % m):
                if r != last:
                    last, own = r, np.unique(grams[begin[r] : begin[r + 1]])
                s = self.sets[i]
                n = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if n >= self.scheme.threshold * len(s) - 1e-9:
                    rows.append(r), items.append(i), shared.append(n)
        return np.array(rows, np.int64), np.array(items, np.int64), np.array(shared, np.int64)


def _plain(df: DataFrame, name: str) -> DataFrame:
    return C.known(df, name, "text").select(F.col(name).cast("long").alias(name), "text")


def _small(items: DataFrame, most: int, most_bytes: int = MAX_BROADCAST_BYTES):
    """The rows of items if there are at most ``most`` of at most ``most_bytes`` together."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return items.collect() if n <= most and size <= most_bytes else None


def find(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_broadcast_items: int = MAX_BROADCAST_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_grams, containment) of every item found in a document."""
    docs, items = _plain(docs, "doc_id"), _plain(items, "item_id")
    scheme = Scheme(n, threshold, recall)
    rows = _small(items, max_broadcast_items)
    if rows is None:
        return _find_by_shuffle(docs, items, scheme)
    index = Index(scheme, [r[0] for r in rows], [r[1] for r in rows])
    sizes = np.array([len(s) for s in index.sets], np.int64)

    def work(batches):
        for batch, texts in C.sliced(batches):
            r, i, shared = index.search(texts)
            if len(r):
                yield C.table(doc_id=C.ids(batch)[r], item_id=index.ids[i], n_shared=shared, n_grams=sizes[i], containment=shared / sizes[i])

    return C.each(docs, work, SCHEMA)


def _sieve(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of a key, eight bits a key or SIEVE_BITS in all, packed; and how many bits of a hash name one.

    Blocks of bits are made by the executors; only whole blocks reach the driver. A full sieve lets all through.
    """
    bits = min(SIEVE_BITS, max(10, math.ceil(math.log2(8 * keys.count() + 1))))
    low = min(bits, 20)  # bits of a block

    def places(batches):
        for batch in batches:
            at = C.mix(batch.column(0).to_numpy().view(np.uint64)) >> C.U(64 - bits)
            yield C.table(block=(at >> C.U(low)).astype(np.int32), bit=(at & C.U((1 << low) - 1)).astype(np.int32))

    def fill(batches):
        here: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(block):
                here.setdefault(int(k), np.zeros(1 << low, bool))[bit[block == k]] = True
        for k, x in here.items():
            yield C.table(block=pa.array([k], pa.int32()), bits=pa.array([np.packbits(x).tobytes()], pa.binary()))

    marked = C.each(keys.select("key"), places, "block int, bit int").distinct().repartition("block").mapInArrow(fill, "block int, bits binary")
    out = np.zeros(((1 << bits) + 7) // 8, np.uint8)
    each = (1 << low) // 8
    for k, data in marked.collect():
        out[k * each : (k + 1) * each] = np.frombuffer(data, np.uint8)
    return out, bits


def _find_by_shuffle(docs: DataFrame, items: DataFrame, scheme: Scheme) -> DataFrame:
    def item_keys(batches):
        for batch, texts in C.sliced(batches):
            for i, s in zip(C.ids(batch, "item_id"), _item_grams(texts, scheme.n)):
                if len(s):
                    k = scheme.item_class(len(s))
                    key = C.mix(scheme.item_minima(s) + np.arange(len(scheme.factors), dtype=np.uint64) * C.U(64) + C.U(k)).view(np.int64)
                    yield C.table(key=key, item_id=np.full(len(key), i), k=np.full(len(key), k, np.int32))

    keys = materialise(C.each(items, item_keys, "key long, item_id long, k int"), "item-keys")
    classes = sorted(r[0] for r in keys.select("k").distinct().collect())
    sieve, bits = _sieve(keys)

    def doc_keys(batches):
        for batch, texts in C.sliced(batches):
            grams, begin = C.Words(texts).grams(scheme.n)
            doc = C.ids(batch)
            for k, window, row in scheme.windows(grams, begin, classes) if classes and len(grams) else ():
                key = C.mix(window + np.arange(len(scheme.factors), dtype=np.uint64) * C.U(64) + C.U(k))
                at = C.mix(key) >> C.U(64 - bits)
                r, c = np.nonzero(sieve[(at >> C.U(3)).astype(np.int64)] >> (C.U(7) - (at & C.U(7))).astype(np.uint8) & 1)
                if len(r):
                    yield C.table(key=key[r, c].view(np.int64), doc_id=doc[row[r]])

    candidates = C.each(docs, doc_keys, "key long, doc_id long").join(keys.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()
    pairs = candidates.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches):
        for batch, texts in C.sliced(batches):
            grams, begin = C.Words(texts).grams(scheme.n)
            sets = _item_grams(C.strings(batch.column(batch.schema.get_field_index("item_text"))), scheme.n)
            shared = np.array([np.isin(s, grams[a:b]).sum() for s, a, b in zip(sets, begin[:-1], begin[1:])], np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            good = shared >= scheme.threshold * size - 1e-9
            if good.any():
                yield C.table(doc_id=C.ids(batch)[good], item_id=C.ids(batch, "item_id")[good], n_shared=shared[good], n_grams=size[good], containment=(shared / size)[good])

    return C.each(pairs, verify, SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_broadcast_items: int = MAX_BROADCAST_ITEMS) -> DataFrame:
    """The rows of docs in which no item is found, with all columns of docs; each is judged by its own text, whatever its doc_id.

    Beyond max_broadcast_items, rows are told apart by 64 bits of a hash of their text.
    """
    plain = _plain(items, "item_id")
    rows = _small(plain, max_broadcast_items)
    if rows is None:
        key = F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"]))
        bad = find(docs.select(key.alias("doc_id"), "text"), items, n, threshold, recall, max_broadcast_items).select(F.col("doc_id").alias("__found_id")).distinct()
        return docs.join(bad, key == bad["__found_id"], "left_anti")
    index = Index(Scheme(n, threshold, recall), [r[0] for r in rows], [r[1] for r in rows])
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            texts = C.strings(batch.column(at))
            good = np.ones(len(texts), bool)
            for a, b in C.slices(texts):
                good[a + index.search(texts.slice(a, b - a))[0]] = False
            yield batch.filter(pa.array(good))

    return C.each(docs, work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    word = r"'[a-z0-9\x{80}-\x{10FFFF}]+'"

    def grams(tab: str, key: str) -> str:
        return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram
 FROM (SELECT {key}, regexp_extract_all(lower(text), {word}) AS w FROM {tab} WHERE {key} IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0)"""

    return f"""
WITH d AS {grams("documents", "doc_id")}, b AS {grams("benchmark", "item_id")},
s AS (SELECT item_id, count(*) AS n_grams FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, any_value(s.n_grams) AS n_grams, count(*) / any_value(s.n_grams) AS containment
FROM d JOIN b ON d.gram = b.gram JOIN s ON s.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING count(*) >= {threshold} * any_value(s.n_grams) - 1e-9"""
