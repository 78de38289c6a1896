"""Operator 1, license scan: an exact set-similarity join of text blocks with license templates.

A block is a line or, with ``wrapped``, also a run of lines. Template T matches block B when |T & B| / |T| >= threshold over distinct words. Tokens are put in
one global order, rarest in the whole corpus first (ties by hash); a block can only match T if it has one of the first
|T| - ceil(threshold |T|) + 1 tokens of T (prefix filter), at least ceil(threshold |T|) tokens (length filter), and
enough tokens of T left after the first common one (positional filter). What passes is counted exactly.

Wrapped blocks: where no line alone matches T, a run of consecutive lines is a block if some run of words in it,
at most as many as T has, divided by threshold, has enough tokens of T: else strange lines together would match. Lines that match T alone are in no wrapped block of T. Blocks are taken
from the top, each from the last word that it can begin with to the end of as many words as T has; two of one template
may share a line, not a word. block_no is the first line. Documents are filtered by the same join first, each as one block.

The template table is broadcast: it doesn't grow with the corpus, and its size is checked.

Defined results: null and empty texts and rows with a null doc_id have no match; a line that occurs twice matches twice
(block_no differs) and copies of a row each give their matches; several templates that match one block are all
returned; templates without a word are ignored; columns besides doc_id and text are never read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C

THRESHOLD = 0.8
MAX_TEMPLATE_BYTES = 64 << 20
SCHEMA = "doc_id long, block_no long, template_id string, overlap long, template_tokens long, containment double"

TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("gpl-freedom", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
    ("all-rights-notice", "All rights reserved."),
]


def _ceil(threshold: float, n: int) -> int:
    return math.ceil(round(threshold * n, 9))


class Templates:
    """Templates over a vocabulary of word hashes in global order."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if sum(len(t) for _, t in templates) > MAX_TEMPLATE_BYTES:
            raise ValueError("the template table is too large to broadcast; split it")
        words = C.Words(pa.array([t or "" for _, t in templates], pa.large_string()))
        sets = [np.unique(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        self.words = np.diff(words.first)[[len(s) > 0 for s in sets]]
        kept = [(name, s) for (name, _), s in zip(templates, sets) if len(s)]
        self.names, self.sets, self.threshold = [n for n, _ in kept], [s for _, s in kept], threshold
        self.vocabulary = np.unique(np.concatenate(self.sets)) if kept else np.zeros(0, np.uint64)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes in the vocabulary, and their numbers there."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == hashes)
        return found, at[found]

    def order(self, counts: dict[int, int]) -> None:
        """Fix the global order from corpus counts by number in the vocabulary; build the prefix index."""
        n, v = len(self.names), len(self.vocabulary)
        by = np.lexsort((self.vocabulary, [counts.get(i, 0) for i in range(v)]))
        self.rank = np.empty(v, np.int64)
        self.rank[by] = np.arange(v)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.array([_ceil(self.threshold, len(s)) for s in self.sets], np.int64)
        self.member = np.zeros((n, v), bool)  # by rank
        self.place = np.zeros((n, v), np.int64)
        self.prefix = np.zeros((n, v), bool)
        for t, s in enumerate(self.sets):
            ranks = np.sort(self.rank[np.searchsorted(self.vocabulary, s)])
            self.member[t, ranks] = True
            self.place[t, ranks] = np.arange(len(ranks))
            self.prefix[t, ranks[: len(ranks) - max(self.need[t], 1) + 1]] = True
        self.in_prefix = self.prefix.any(0)

    def match(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of the matches; block, rank: distinct pairs in ascending order."""
        hot = np.zeros(len(block), bool)
        hot[:] = self.in_prefix[rank]
        live = np.unique(block[hot])
        keep = np.isin(block, live)
        block, rank = block[keep], rank[keep]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        length = np.diff(np.r_[starts, len(block)])
        place_in_block = np.arange(len(block)) - np.repeat(starts, length)
        number = np.repeat(np.arange(len(starts)), length)
        out = []
        for t in range(len(self.names)):
            need = max(self.need[t], 1)
            hit = np.flatnonzero(self.prefix[t, rank])
            if not len(hit):
                continue
            cand, at = np.unique(number[hit], return_index=True)  # the first common token of each block
            first = hit[at]
            left = np.minimum(self.size[t] - self.place[t, rank[first]], length[cand] - place_in_block[first])
            cand = cand[(length[cand] >= need) & (left >= need)]
            if len(cand):
                overlap = np.add.reduceat(self.member[t, rank].astype(np.int64), starts)[cand]
                good = overlap >= need
                out.append((block[starts[cand[good]]], np.full(good.sum(), t), overlap[good]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _wrapped(word: np.ndarray, rank: np.ndarray, line: np.ndarray, alone: set[int], need: int, words: int, most: int) -> list[tuple[int, int, int]]:
    """(first line, last line, overlap) of the wrapped blocks; word, rank, line: of a document's words that are in the template."""
    out, held, a, b = [], {}, 0, 0
    word, rank, line = word.tolist(), rank.tolist(), line.tolist()
    while b < len(word):
        if line[b] in alone:
            held, a = {}, b + 1
        else:
            held[rank[b]] = held.get(rank[b], 0) + 1
            while held[rank[a]] > 1 or word[b] - word[a] >= most:
                held[rank[a]] -= 1
                if not held[rank[a]]:
                    del held[rank[a]]
                a += 1
            if len(held) >= need:
                while b + 1 < len(word) and word[b + 1] - word[a] < words and line[b + 1] not in alone:
                    b += 1
                low, high = bisect_left(line, line[a]), bisect_right(line, line[b])
                out.append((line[a], line[b], len(set(rank[low:high]))))
                held, a = {}, b + 1
        b += 1
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """Every (block, template) with containment of at least ``threshold``; wrapped: over line breaks too."""
    docs = C.known(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = Templates(templates, threshold)

    def count(batches):
        total = np.zeros(len(index.vocabulary), np.int64)
        for _, texts in C.sliced(batches):
            total += np.bincount(index.look_up(C.Words(texts).hashes)[1], minlength=len(total))
        yield C.table(token=np.arange(len(total), dtype=np.int32), n=total)

    counted = C.each(docs.select("text"), count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    index.order({r[0]: r[1] for r in counted.collect()})

    def work(batches):
        for batch, texts in C.sliced(batches):
            words = C.Words(texts)
            at, token = index.look_up(words.hashes)
            rank = index.rank[token]
            newlines = np.flatnonzero(words.buf == 10)
            line = np.searchsorted(newlines, words.starts[at])  # of the slice; rows are told apart below
            row = np.searchsorted(words.first, at, "right") - 1
            key = np.unique(((line + row) << 24) | rank)  # line + row differs wherever line or row does, as both ascend
            block, t, overlap = index.match(key >> 24, key & ((1 << 24) - 1))
            lines_before = np.searchsorted(newlines, words.offsets)  # newlines before each row
            begin = lines_before[:-1] + np.arange(len(texts))
            doc = np.searchsorted(begin, block, "right") - 1
            if wrapped:
                whole = np.unique((row << 24) | rank)
                more = []
                for r, k, _ in zip(*index.match(whole >> 24, whole & ((1 << 24) - 1))):
                    if lines_before[r + 1] > lines_before[r]:
                        a, b = np.searchsorted(row, [r, r + 1])
                        own = np.flatnonzero(index.member[k, rank[a:b]]) + a
                        alone = set((block[(doc == r) & (t == k)] - r).tolist())
                        more += [(first + r, k, n, r) for first, _, n in _wrapped(at[own], rank[own], line[own], alone, max(int(index.need[k]), 1), int(index.words[k]), int(index.words[k] / max(threshold, 1e-9) + 1e-9))]
                if more:
                    block, t, overlap, doc = (np.concatenate([x, y]) for x, y in zip((block, t, overlap, doc), np.array(more, np.int64).T))
            if not len(block):
                continue
            size = index.size[t]
            yield C.table(
                doc_id=pa.array(C.ids(batch)[doc]), block_no=block - begin[doc], template_id=pa.array(np.array(index.names, object)[t], pa.string()), overlap=overlap, template_tokens=size, containment=overlap / size
            )

    return C.each(docs, work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"), wrapped=True)


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates)
    word = r"'[a-z0-9\x{80}-\x{10FFFF}]+'"
    return f"""
WITH templates(template_id, body) AS (VALUES {rows}),
t AS (SELECT DISTINCT template_id, unnest(regexp_extract_all(lower(body), {word})) AS token FROM templates),
sizes AS (SELECT template_id, count(*) AS template_tokens FROM t GROUP BY template_id),
docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
blocks AS (SELECT rid, doc_id, unnest(range(len(lines))) AS block_no, unnest(lines) AS line FROM docs),
tokens AS (SELECT DISTINCT rid, doc_id, block_no, unnest(regexp_extract_all(lower(line), {word})) AS token FROM blocks)
SELECT b.doc_id, b.block_no, t.template_id, count(*) AS overlap, any_value(s.template_tokens) AS template_tokens, count(*) / any_value(s.template_tokens) AS containment
FROM tokens b JOIN t ON t.token = b.token JOIN sizes s ON s.template_id = t.template_id
GROUP BY b.rid, b.doc_id, b.block_no, t.template_id
HAVING count(*) >= ceil(round({threshold} * any_value(s.template_tokens), 9))"""
