"""Operator 9, suffix dedup: every passage of at least ``length`` words that occurs more than once in the corpus.

Suffixes are words' suffixes, cut after ``length`` words. A difference cover D modulo v makes any two positions i, j meet:
some d < v has i + d and j + d in the sample {p : p mod v in D}. So if two suffixes share ``length`` words, the sample
suffixes at i + d and j + d share the first m = length - v + 1 words and what follows, and have the same d words before.

Blockwise construction: sample suffixes are bucketed by their first m words, and only tied ones, in a bucket of two or more,
go on (``tied``). A bucket is sorted at a time: its suffixes get ranks by the words that follow (one rank for each depth up
to v - 1, equal for those that share so many) and, in the same way, by the words before (``ranks``). Any other suffix i is
never sorted itself: for each tied sample suffix at i + d its tie with others is resolved by two ranks, that of d words
before and that of v - 1 - d words after (``resolve``). A worker holds one bucket at a time. A bucket of more than ``hot``
suffixes is not held at all: its windows of ``length`` words are grouped by hash, a batch at a time, with the same result.

Result: (doc_id, start_word, end_word, n_words, is_first). Words count from 0, end is exclusive. A span with is_first
holds the passages' first occurrences by (doc_id, position), which dedup keeps; the others are to be cut.

Defined results: null and short texts and rows with a null doc_id have no span; rows that share a doc_id are one document,
so equal words at equal positions there are one occurrence; overlapping repeats within a document count as repeats;
columns besides doc_id and text are never read. The first m words are compared by 64 bits of a hash of the run, each of the
others by 32 bits of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C
from lodeseek.llm.ngram_join import _grouped
from lodeseek.session import materialise

LENGTH = 50
#: Perfect difference sets: every residue modulo v is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (0, 1, 3, 8, 12, 18)}
HOT = 200_000  # suffixes of a bucket that a worker holds
SCHEMA = "doc_id long, start_word long, end_word long, n_words long, is_first boolean"


def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that leaves at least two thirds of ``length`` to the sample's first words; all positions for short ones.

    A sparser one has fewer suffixes, but each takes more words around it along.
    """
    fit = [v for v in COVERS if length - v + 1 >= max(2, 2 * length // 3)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _windows(words: C.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n words from each position that has so many; its row and position."""
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    power = C._power(C._BASE, len(words.hashes) + 1)
    np.cumsum(words.hashes * power[: len(words.hashes)], out=sums[1:])
    have = np.maximum(np.diff(words.first) - n + 1, 0)
    row = np.repeat(np.arange(len(have)), have)
    pos = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
    at = words.first[row] + pos
    inverse = C._power(C._INV, len(words.hashes) + 1)
    return C.mix((sums[at + n] - sums[at]) * inverse[at]), row, pos


def tied(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, pos) of the sample suffixes whose first words occur at another place too."""
    v, d = cover(length)
    member = np.zeros(v, bool)
    member[[x % v for x in d]] = True

    def emit(batches):
        for batch, texts in C.sliced(batches):
            key, row, pos = _windows(C.Words(texts), length - v + 1)
            s = member[pos % v]
            yield C.table(key=key[s].view(np.int64), doc_id=C.ids(batch)[row[s]], pos=pos[s].astype(np.int32))

    def ties(batches):
        for key, doc, pos, _ in _repeated(batches):
            yield C.table(key=key, doc_id=doc, pos=pos)

    suffixes = C.each(docs, emit, "key long, doc_id long, pos int")
    return suffixes.repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(ties, "key long, doc_id long, pos int")


def _repeated(batches):
    """(key, doc, pos, first) of the distinct rows whose key has at least two; rows come sorted by all three.

    One batch is held at a time, however many rows a key has: of a key that goes on only the last row, and whether it
    waits for a second one, are carried over.
    """
    last, waits = None, False
    for batch in batches:
        key, doc, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "pos"))
        if not len(key):
            continue
        if last is not None:
            key, doc, pos = np.r_[last[0], key], np.r_[last[1], doc], np.r_[last[2], pos]
        new_key = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new_key | np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
        begin = np.flatnonzero(new_key[at])
        size = np.diff(np.r_[begin, len(at)])
        first, many = new_key[at], np.repeat(size > 1, size)
        if last is not None and not waits:  # the row carried over has been given, and its key has others
            many[: size[0]], first[0] = True, False
            many[0] = False
        goes_on = size[-1] == 1 and (last is None or waits or len(begin) > 1)
        last, waits = (key[at[-1:]], doc[at[-1:]], pos[at[-1:]]), bool(goes_on)
        keep = at[many]
        if len(keep):
            yield key[keep], doc[keep], pos[keep], first[many]


def ranks(bucket: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """A rank for each depth 0, 1, ...: suffixes have one rank if they are of one bucket and share so many words."""
    out = [bucket]
    for column in words.T:
        _, rank = np.unique(out[-1].astype(np.uint64) << np.uint64(32) | column, return_inverse=True)
        out.append(rank)
    return out


def resolve(key, doc, pos, left, right, words) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, late) of tied sample suffixes in order of (key, doc, pos): bit d is about the window that begins d words before;
    late ones aren't the first of their passage. left, right: how many words there are on either side."""
    reach = words.shape[1] // 2
    bucket = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    before, after = ranks(bucket, words[:, :reach]), ranks(bucket, words[:, reach:])
    repeated, late = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for d in range(reach + 1):
        rows = np.flatnonzero((left >= d) & (right >= reach - d))
        pair = before[d][rows].astype(np.int64) * (len(key) + 1) + after[reach - d][rows]
        rows = rows[np.argsort(pair, kind="stable")]
        pair = np.sort(pair)
        _, keep, first = _occurrences(pair, doc[rows], pos[rows])
        repeated[rows[keep]] |= 1 << d
        late[rows[keep[~first]]] |= 1 << d
    return repeated, late


def _occurrences(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: the distinct ones, those with a key of at least two of them, and which of the latter come first."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    new_key = np.r_[True, key[1:] != key[:-1]]
    distinct = np.flatnonzero(new_key | np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
    begin = np.flatnonzero(new_key[distinct])
    size = np.diff(np.r_[begin, len(distinct)])
    many = np.repeat(size > 1, size)
    return distinct, distinct[many], new_key[distinct[many]]


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Maximal repeated spans, as the module says."""
    docs = C.known(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    v, _ = cover(length)
    head, reach = length - v + 1, v - 1
    sample = materialise(tied(docs, length), "suffix-ties")
    large = np.sort(np.array([r[0] for r in sample.groupBy("key").count().where(F.col("count") > hot).collect()], np.int64))
    anchors = sample.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("anchors"))
    source = docs.join(anchors, "doc_id").select("doc_id", "text", "anchors")

    def placed(batch, texts):
        """The words of a slice, and key, row and position of its tied sample suffixes."""
        words = C.Words(texts)
        lists = batch.column(2)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        pos = lists.flatten().to_numpy(zero_copy_only=False)
        count = np.diff(words.first)
        inside = pos + head <= count[row]
        row, pos = row[inside], pos[inside]
        have = np.maximum(count - head + 1, 0)
        key = _windows(words, head)[0][(np.cumsum(have) - have)[row] + pos].view(np.int64)
        return words, count, key, row, pos

    def contexts(batches):
        near = np.r_[-1 - np.arange(reach), head + np.arange(reach)]
        for batch, texts in C.sliced(batches):
            words, count, key, row, pos = placed(batch, texts)
            cold = np.flatnonzero(~np.isin(key, large))
            code = np.concatenate([np.zeros(reach, np.uint32), (words.hashes >> C.U(32)).astype(np.uint32), np.zeros(length, np.uint32)])
            for k in range(0, len(cold), 8192):
                some = cold[k : k + 8192]
                r, p = row[some], pos[some]
                left, right = np.minimum(p, reach), np.minimum(count[r] - p - head, reach)
                around = code[(words.first[r] + p + reach)[:, None] + near]
                around[np.r_[np.arange(reach), np.arange(reach)] >= np.where(np.arange(2 * reach) < reach, left[:, None], right[:, None])] = 0
                yield C.table(key=key[some], doc_id=C.ids(batch)[r], pos=p.astype(np.int32), sides=(left << 8 | right).astype(np.int32), words=C.pack(around, np.arange(len(some) + 1) * 2 * reach, 4))

    def sort(batches):
        for key, doc, pos, sides, words in _grouped(batches, "key", "doc_id", "pos", "sides", "words"):
            words = np.frombuffer(b"".join(words.tolist()), np.uint32).reshape(len(key), 2 * reach)
            repeated, late = resolve(key, doc, pos, sides >> 8, sides & 255, words)
            some = repeated > 0
            yield C.table(doc_id=doc[some], pos=pos[some], repeated=repeated[some], late=late[some])

    kind = "doc_id long, pos int, repeated long, late long"
    buckets = C.each(source, contexts, "key long, doc_id long, pos int, sides int, words binary")
    found = buckets.repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(sort, kind)

    def windows(batches):
        for batch, texts in C.sliced(batches):
            words, count, key, row, pos = placed(batch, texts)
            own = np.isin(key, large)
            row, pos = row[own], pos[own]
            every = np.repeat(row, reach + 1), np.repeat(pos, reach + 1) - np.tile(np.arange(reach + 1), len(pos))
            ok = (every[1] >= 0) & (every[1] + length <= count[every[0]])
            row, pos = every[0][ok], every[1][ok]
            have = np.maximum(count - length + 1, 0)
            name = _windows(words, length)[0][(np.cumsum(have) - have)[row] + pos]
            yield C.table(key=name.view(np.int64), doc_id=C.ids(batch)[row], pos=pos.astype(np.int32))

    def streamed(batches):
        for _, doc, pos, first in _repeated(batches):
            yield C.table(doc_id=doc, pos=pos, repeated=np.ones(len(doc), np.int64), late=(~first).astype(np.int64))

    if len(large):
        rows = C.each(source, windows, "key long, doc_id long, pos int")
        found = found.union(rows.repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(streamed, kind))

    def join(batches):
        for doc, pos, repeated, late in _grouped(batches, "doc_id", "pos", "repeated", "late"):
            parts = []
            for d in range(reach + 1):
                some = np.flatnonzero(repeated >> d & 1)
                parts.append((doc[some], pos[some].astype(np.int64) - d, late[some] >> d & 1))
            doc, start, late = (np.concatenate(x) for x in zip(*parts))
            by = np.lexsort((start, doc))
            doc, start, late = doc[by], start[by], late[by]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
            doc, start, late = doc[new], start[new], np.maximum.reduceat(late, new)
            for first in (True, False):
                own = (late == 0) == first
                d_, p = doc[own], start[own]
                if not len(p):
                    continue
                a = np.flatnonzero(np.r_[True, (d_[1:] != d_[:-1]) | (p[1:] > p[:-1] + 1)])
                b = np.r_[a[1:], len(p)] - 1
                begin, end = p[a], p[b] + length
                yield C.table(doc_id=d_[a], start_word=begin, end_word=end, n_words=end - begin, is_first=np.full(len(a), first))

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(join, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(C.read(spark, sf_dir, "documents"))


def oracle(length: int = LENGTH) -> str:
    word = r"'[a-z0-9\x{80}-\x{10FFFF}]+'"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {word}) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, i AS pos, array_to_string(w[i + 1:i + {length}], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(len(w) - {length - 1})) AS i FROM w WHERE len(w) >= {length})),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) = 1 AS is_first, count(*) OVER (PARTITION BY passage) AS n FROM p),
m AS (SELECT doc_id, pos, is_first, pos - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY pos) AS island FROM r WHERE n > 1)
SELECT doc_id, min(pos) AS start_word, max(pos) + {length} AS end_word, max(pos) + {length} - min(pos) AS n_words, is_first FROM m GROUP BY doc_id, is_first, island"""
