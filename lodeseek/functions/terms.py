"""Term counts inside rows: tokens are found with numpy over the bytes of a batch and counted by Arrow dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeseek.session import prepare

SLICE = 1 << 20  # bytes of text worked on at once
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123)]] = True
CELLS = 1 << 19  # scores worked on at once
SOLID = np.ones(256, bool)
SOLID[[*range(9, 14), 32]] = False


def tokens_of(texts: pa.Array, spaces: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of every token of a slice of large strings without nulls: runs of ASCII letters and digits of the lowered text;
    spaces: what stands between ASCII white space of texts that are lowered already."""
    low = texts if spaces else pc.utf8_lower(pc.replace_substring(texts, "İ", "i̇"))
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1]
    data = low.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if n and data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else offsets
    mask = (SOLID if spaces else LETTER)[buf]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    first = offsets[:-1][offsets[:-1] < len(mask)]
    start[first] = mask[first]  # a row's first letter begins a token, whatever stands before it
    at = np.flatnonzero(start)
    inside = np.cumsum(mask, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    ends = np.r_[inside[at] - 1, inside[-1] if len(mask) else 0].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[mask]))])
    return np.searchsorted(offsets, at, "right") - 1, words


def _slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of about SLICE bytes, and of at most so many rows; nulls are empty texts. Only a slice is copied."""
    keys, texts = batch.column(0), batch.column(1)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        end = min(end, at + (most or end))
        yield keys.slice(at, end - at), pc.fill_null(texts.slice(at, end - at).cast(pa.large_string()), "")
        at = end


def _counted(row: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct (row, code) with their counts, and the words of the codes."""
    coded = pc.dictionary_encode(words)
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
    return pair // n, pair % n, tf, coded.dictionary


def term_counts(docs: DataFrame, key: str, text: str = "text", vocabulary: list[str] | None = None, totals: bool = False) -> DataFrame:
    """(key, term, dl, tf) of each row of docs, without an exchange; dl: all its tokens.

    vocabulary: only these terms are given. totals: each task adds a row without key and term that has the number of
    documents with a token as tf, and their tokens as dl.
    """
    known = None if vocabulary is None else pa.array(vocabulary, pa.large_string())
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        n_docs = n_tokens = 0
        for batch in batches:
            for keys, texts in _slices(batch):
                row, words = tokens_of(texts)
                dl = np.bincount(row, minlength=len(texts))
                n_docs, n_tokens = n_docs + int((dl > 0).sum()), n_tokens + len(row)
                if known is not None:
                    ours = pc.is_in(words, known)
                    row, words = row[ours.to_numpy(zero_copy_only=False)], words.filter(ours)
                r, code, tf, terms = _counted(row, words)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), terms.take(pa.array(code)), pa.array(dl[r]), pa.array(tf)], names=[key, "term", "dl", "tf"])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, keys_type[0]), pa.nulls(1, pa.large_string()), pa.array([n_tokens]), pa.array([n_docs])], names=[key, "term", "dl", "tf"])

    keys_type = [to_arrow_type(docs.schema[key].dataType)]
    prepare(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(work, f"`{key}` {kind}, term string, dl long, tf long")


def corpus_counts(docs: DataFrame, text: str = "text", spaces: bool = False) -> DataFrame:
    """(term, df, cf) of each slice of docs, to be summed: what travels is one row a term and slice."""

    def work(batches):
        for batch in batches:
            for _, texts in _slices(batch):
                _, code, tf, terms = _counted(*tokens_of(texts, spaces))
                n = len(terms)
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(code, tf, n).astype(np.int64))], names=["term", "df", "cf"])

    prepare(docs.sparkSession)
    return docs.select(F.lit(0), F.col(text)).mapInArrow(work, "term string, df long, cf long")


def vocabulary_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """(term, df, cf) of these terms in each task, to be summed; a row without term has the documents with a token and their tokens."""
    known = pa.array(vocabulary, pa.large_string())

    def work(batches):
        n_docs = n_tokens = 0
        df, cf = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            for _, texts in _slices(batch):
                row, words = tokens_of(texts)
                n_docs, n_tokens = n_docs + len(np.unique(row)), n_tokens + len(row)
                _, code, tf = _known(row, words, known)
                df += np.bincount(code, minlength=len(df))
                cf += np.bincount(code, tf, len(cf)).astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([known.take(pa.array(at)), pa.nulls(1, pa.large_string())]), pa.array(np.r_[df[at], n_docs]), pa.array(np.r_[cf[at], n_tokens])], names=["term", "df", "cf"])

    prepare(docs.sparkSession)
    return docs.select(F.lit(0), F.col(text)).mapInArrow(work, "term string, df long, cf long")


def _known(row: np.ndarray, words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, place in known) with their counts, of the words that are known."""
    code = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
    ours = code >= 0
    pair, tf = np.unique(row[ours] * max(1, len(known)) + code[ours], return_counts=True)
    return pair // max(1, len(known)), pair % max(1, len(known)), tf


def _greatest(row: np.ndarray, code: np.ndarray, tf: np.ndarray, terms: pa.Array, most: int) -> np.ndarray:
    """Which of the pairs, in order of row, are among the most frequent terms of their row; ties by term."""
    size = np.bincount(row)
    if size.max(initial=0) <= most:
        return np.ones(len(row), bool)
    place = np.empty(len(terms), np.int64)
    place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    order = np.lexsort((place[code], -tf, row))
    first = np.cumsum(size) - size
    keep = np.zeros(len(row), bool)
    keep[order[np.arange(len(row)) - first[row[order]] < most]] = True
    return keep


def score_documents(docs: DataFrame, queries: DataFrame, names: list, weights: list[tuple[int, str, float]], part: Callable, k: int, spaces: bool = False, every: bool = False, most: int | None = None) -> DataFrame:
    """(query_id, dataset_id, score) of docs (dataset_id without nulls or repeats, text): each task's k best documents of each query, and some more.

    names: the ids of queries; weights: (place in names, term, weight); a score is the sum of weight * part(tf, dl) over the
    terms that both have, to nine digits. Documents are scored in the one pass, some at a time, and only those travel that
    are no worse than the k best so far; equal ones go by id. every: documents that share no term count too, with 0;
    otherwise those of a score above 0. most: only so many terms of a document count, the most frequent.
    """
    vocabulary = sorted({t for _, t, _ in weights})
    place = {t: i for i, t in enumerate(vocabulary)}
    by_term = np.array([place[t] for _, t, _ in weights], np.int64)
    order = np.argsort(by_term, kind="stable")
    ours, weight = np.array([q for q, _, _ in weights], np.int64)[order], np.array([w for _, _, w in weights], np.float64)[order]
    fan = np.bincount(by_term, minlength=len(vocabulary))
    first = np.cumsum(fan) - fan
    known = pa.array(vocabulary, pa.large_string())
    ids, n_q, k = pa.array(names, to_arrow_type(queries.schema["query_id"].dataType)), len(names), max(1, k)
    rows_at_once = max(1, CELLS // max(1, n_q))

    def sums(row, code, value, n):
        out = np.zeros(n_q * n)
        wide = fan[code]
        upto, at = np.cumsum(wide), 0
        while at < len(code):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
            f, c = wide[at:end], code[at:end]
            entry = np.repeat(first[c] - (np.cumsum(f) - f), f) + np.arange(f.sum())
            out += np.bincount(ours[entry] * n + np.repeat(row[at:end], f), weight[entry] * np.repeat(value[at:end], f), n_q * n)
            at = end
        return out.reshape(n_q, n)

    def work(batches):
        best = np.full((n_q, k), -np.inf)
        for batch in batches:
            for keys, texts in _slices(batch, rows_at_once):
                n = len(texts)
                row, words = tokens_of(texts, spaces)
                dl = np.bincount(row, minlength=n)
                if most is None:
                    row, code, tf = _known(row, words, known)
                else:
                    row, code, tf, terms = _counted(row, words)
                    keep = _greatest(row, code, tf, terms, most)
                    code = pc.fill_null(pc.index_in(terms, known), -1).to_numpy(zero_copy_only=False)[code]
                    keep &= code >= 0
                    row, code, tf = row[keep], code[keep], tf[keep]
                by_id = pc.sort_indices(keys).to_numpy()
                rank = np.empty(n, np.int64)
                rank[by_id] = np.arange(n)
                score = np.floor(sums(rank[row], code, part(tf, dl[row]), n) * 1e9 + 0.5) / 1e9
                if not every:
                    score[score <= 0] = -np.inf
                q, r = np.nonzero((score >= best[:, :1]) & (score > -np.inf))
                if not len(q):
                    continue
                order = np.lexsort((r, -score[q, r], q))
                q, r = q[order], r[order]
                start = np.searchsorted(q, np.arange(n_q))
                nth = np.arange(len(q)) - start[q]
                q, r, nth = q[nth < k], r[nth < k], nth[nth < k]
                value = score[q, r]
                now = np.full((n_q, k), -np.inf)
                now[q, nth] = value
                best = np.sort(np.concatenate([best, now], axis=1), axis=1)[:, k:]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(by_id[r])), pa.array(value)], names=["query_id", "dataset_id", "score"])

    prepare(docs.sparkSession)
    return docs.select("dataset_id", "text").mapInArrow(work, f"query_id {queries.schema['query_id'].dataType.simpleString()}, dataset_id {docs.schema['dataset_id'].dataType.simpleString()}, score double")
