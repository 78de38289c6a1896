"""Operator 6, token counts of every prefix.

For each text the exact number of byte-pair tokens of each of its prefixes (in characters) is found by dynamic
programming over prefixes and stored, so that truncation and budget questions need no further encoding. Within a piece
of the tokenizer's pattern, the last token of the encoding of a prefix is the only one that is compatible with the last
token of what stands before it; its count follows from the shorter prefix. Pieces recur, so their tables are kept.
A prefix may end inside a piece or inside white space whose split depends on what follows; both are accounted for.

The table is a binary: one byte with the width of an item (1 or 2), then deflated differences of consecutive counts.
``counts``, ``tokens_at`` and ``cut`` read it.

Defined results: null and empty texts have 0 tokens and an empty table; special tokens in a text are ordinary text;
copies of a row and rows with a null doc_id are counted like any other; columns besides doc_id and text are never read.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C

VOCABULARY = os.environ.get("LODESEEK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGETS = (512, 2048)
BLANK, LETTER, NUMBER, OTHER = range(4)
SHORT = np.array([ord(c) for c in "stmd"], np.uint32)
LONG = np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
MEMO = 400_000  # pieces whose tables a worker keeps; as they are full, those that the last slices lacked go
MOST_PAIRS = 2_000_000  # pairs of tokens whose fit a worker keeps
MOST_STATES = 600_000  # prefixes whose states a worker keeps
SHARED = 40  # bytes of a piece whose prefixes are kept, at most
STEP = {d: bytes([d & 255]) for d in range(-SHARED, SHARED + 1)}
SEGMENT = 1 << 20  # characters of a long text that are worked on at once


class Counter:
    """Prefix tables for one vocabulary (the content of a file of base64 tokens and ranks)."""

    def __init__(self, content: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("prefixes", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.encode_piece = self.encoding._core_bpe.encode_single_piece
        self.split = regex.compile(PATTERN).findall
        self.blank = regex.compile(r"\s{2,}").finditer
        self.longest = max(map(len, self.ranks))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.fits: dict[int, bool] = {}
        self.state: dict[bytes, tuple[int, int, bytes]] = {b"": (-1, 0, b"")}  # of prefixes, see _state
        self.ends: dict[bytes, int] = {}  # the longest token that ends in these four bytes
        for token in self.ranks:
            if len(token) > 3:
                self.ends[token[-4:]] = max(len(token), self.ends.get(token[-4:], 0))
        self.cuts = regex.compile(r"\S(?= \S)").search
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for run in regex.finditer(name, every):
                a, b = (ord(c) for c in (every[run.start()], every[run.end() - 1]))
                self.kinds[a : b + 1] = kind
        self.known: dict[int, int] = {}  # numbers of pieces by hash; their steps are table[place[number]:], their letters beside
        self.place = array("q")
        self.table, self.letters, self.wide, self.used = bytearray(), bytearray(), set(), []

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of tokens a and b in a row is [a, b]; kept."""
        fits = self.fits
        if len(fits) > MOST_PAIRS:
            fits.clear()
        known = fits[a << 32 | b] = self.encode_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _state(self, data: bytes) -> tuple[int, int, bytes]:
        """The last token of a short piece, its count, and the differences of its prefixes' counts, by bytes.

        States of prefixes are kept and shared between pieces: only what follows the longest known one is worked out.
        """
        state, rank, fit, ends = self.state, self.ranks.get, self.fits.get, self.ends.get
        known = state.get(data)
        if known is not None:
            return known
        if len(state) > MOST_STATES:
            state.clear()
            state[b""] = (-1, 0, b"")
        n = len(data)
        at = n - 1
        while (known := state.get(data[:at])) is None:
            at -= 1
        for j in range(at + 1, n + 1):
            i = j - (ends(data[j - 4 : j], 3) if j > 3 else 3)
            for i in range(i if i > 0 else 0, j):
                token = rank(data[i:j])
                if token is not None:
                    if i == 0:
                        count = 1
                        break
                    before, count, _ = state[data[:i]]
                    good = fit(before << 32 | token)
                    if good or good is None and self._compatible(before, token):
                        count += 1
                        break
            known = state[data[:j]] = token, count, known[2] + STEP[count - known[1]]
        return known

    def _dp(self, data: bytes) -> list[int]:
        """Counts of the prefixes 0..len(data) of one piece, by bytes."""
        if len(data) <= SHARED:
            return [0, *np.cumsum(np.frombuffer(self._state(data)[2], np.int8), dtype=np.int64).tolist()]
        rank, fit, longest = self.ranks.get, self.fits.get, self.longest
        last, counts = [-1], [0]
        for j in range(1, len(data) + 1):
            for i in range(max(0, j - longest), j):
                token = rank(data[i:j])
                if token is not None:
                    good = i == 0 or fit(last[i] << 32 | token)
                    if good or good is None and self._compatible(last[i], token):
                        last.append(token)
                        counts.append(counts[i] + 1)
                        break
        return counts

    def _piece(self, piece: str) -> bytes | None:
        """Differences of the counts of a piece's prefixes, by characters, as int8; None where they need more."""
        if piece in ("'re", "'ve", "'ll"):  # the prefix of two characters isn't one piece
            count = self._by_chars(piece)
            count[2] = 2
        else:
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) == len(piece) <= SHARED:
                return self._state(data)[2]
            count = self._by_chars(piece)
        try:
            return bytes([(b - a) & 255 if -128 <= b - a < 128 else 256 for a, b in zip(count, count[1:])])
        except ValueError:
            return None

    def _wide(self, text: str) -> np.ndarray:
        """Differences for any text, slowly."""
        out = []
        for piece in self.split(text):
            count = self._by_chars(piece)
            if piece in ("'re", "'ve", "'ll"):
                count[2] = 2
            out.append(np.diff(count))
        return np.concatenate(out)

    def _segments(self, text: str) -> list[str]:
        """A long text cut before blanks that begin a piece whatever stands around."""
        out, at = [], 0
        while len(text) - at > SEGMENT:
            found = self.cuts(text, at + SEGMENT)
            if not found:
                break
            out.append(text[at : found.start() + 1])
            at = found.start() + 1
        return [*out, text[at:]]

    def steps(self, text: str) -> np.ndarray:
        """Differences of the token counts of consecutive prefixes."""
        return np.concatenate([self.batch([x])[0] for x in self._segments(text)])

    def pieces(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin, as PATTERN finds them in each; codes: code points, cut into texts at offsets."""
        kind = self.kinds[codes]
        new = np.r_[True, kind[1:] != kind[:-1]]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        run = np.flatnonzero(new)
        end = np.r_[run[1:], len(codes)]
        k, size = kind[run], end - run
        last = np.zeros(len(codes) + 1, bool)
        last[offsets[1:]] = True
        closes = last[end]  # the run ends its text
        blank = k == BLANK
        joined = np.r_[False, (blank & ~closes & (codes[end - 1] == 32))[:-1]]  # a blank before it is part of the piece
        begins = np.zeros(len(codes) + 1, bool)
        begins[run[blank & (closes | (size > 1))]] = True
        begins[end[blank & ~closes] - 1] = True
        begins[run[~blank & ~joined]] = True
        quote = np.flatnonzero((k[:-1] == OTHER) & (size[:-1] == 1) & ~joined[:-1] & ~closes[:-1] & (k[1:] == LETTER) & (codes[run[:-1]] == 39))
        if len(quote):
            at, many = run[quote] + 1, size[quote + 1]
            one = np.isin(codes[at], SHORT)
            pair = codes[at].astype(np.int64) << 32 | codes[np.minimum(at + 1, len(codes) - 1)]
            two = (many > 1) & np.isin(pair, LONG)
            for some, n in ((one, 1), (two, 2)):
                begins[at[some]] = False
                begins[(at + n)[some & (many > n)]] = True
        return np.flatnonzero(begins[:-1])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """``steps`` of each text: pieces are found and looked up all at once."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        if not len(codes):
            return [np.zeros(0, np.int8) for _ in texts]
        starts = self.pieces(codes, offsets)
        length = np.diff(np.r_[starts, len(codes)])
        terms = C.mix(codes.astype(np.uint64) + C.U(1)) * C._power(C._BASE, len(codes) + 1)[: len(codes)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        names = C.mix((sums[starts + length] - sums[starts]) * C._power(C._INV, len(codes) + 1)[starts] + length.astype(np.uint64))
        names, first, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) > MEMO or len(self.table) > 20 * MEMO:
            self._forget()
        known, number = self.known, np.empty(len(names), np.int64)
        for i, name in enumerate(names.tolist()):
            at = known.get(name, -1)
            if at < 0:
                a = starts[first[i]]
                at = self._learn(name, codes[a : a + length[first[i]]].tobytes())
            number[i] = at
        self.used = [*self.used[-31:], number]
        place = np.repeat(np.frombuffer(self.place, np.int64)[number][which] - starts, length) + np.arange(len(codes))
        steps = np.frombuffer(self.table, np.int8)[place]
        wide = self.wide & set(number.tolist()) if self.wide else ()
        if wide or (np.frombuffer(self.letters, np.uint32)[place] != codes).any():  # two pieces of one name
            steps = np.concatenate([self._wide(x) for x in texts if x])
        double = (self.kinds[codes[1:]] == BLANK) & (self.kinds[codes[:-1]] == BLANK)
        doubled = np.add.reduceat(np.r_[double, False], np.minimum(offsets[:-1], len(codes) - 1)) > 0
        return [self._blanks(text, steps[a:b]) if some else steps[a:b] for text, a, b, some in zip(texts, offsets, offsets[1:], doubled)]

    def _learn(self, name: int, raw: bytes) -> int:
        """The number of a new piece, whose steps and letters are put at the end of the tables."""
        piece = raw.decode("utf-32-le", "surrogatepass")
        steps, number = self._piece(piece), len(self.place)
        if steps is None:
            self.wide.add(number)
        self.place.append(len(self.table))
        self.table += steps or bytes(len(piece))
        self.letters += raw
        self.known[name] = number
        return number

    def _forget(self) -> None:
        """Keep the pieces of the last slices only."""
        recent, n = set(), 0
        for number in reversed(self.used):
            recent |= set(number.tolist())
            n += 1
            if len(recent) > MEMO // 3:
                break
        kept = [(name, number) for name, number in self.known.items() if number in recent]
        old, place = (self.table, self.letters), [*self.place, len(self.table)]
        wide, self.wide, self.used = self.wide, set(), []
        self.known, self.place, self.table, self.letters = {}, array("q"), bytearray(), bytearray()
        for name, number in kept:
            a, b = place[number], place[number + 1]
            if b - a > 40:  # the tables stay small
                continue
            if number in wide:
                self.wide.add(len(self.place))
            self.known[name] = len(self.place)
            self.place.append(len(self.table))
            self.table += old[0][a:b]
            self.letters += old[1][4 * a : 4 * b]

    def _blanks(self, text: str, steps: np.ndarray) -> np.ndarray:
        """A prefix that ends in white space holds it as one piece."""
        counts = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        for run in self.blank(text):
            a, b = run.span()
            counts[a + 1 : b + 1] = counts[a] + np.array(self._by_chars(run.group())[1:])
        return np.diff(counts)

    def _by_chars(self, piece: str) -> list[int]:
        """Counts of the prefixes 0..len(piece) of one piece, by characters."""
        data = piece.encode("utf-8", "surrogatepass")
        count = self._dp(data)
        if len(data) == len(piece):
            return count
        return [0, *(count[j] for j in range(1, len(data) + 1) if j == len(data) or data[j] & 0xC0 != 0x80)]


_counters: dict[str, Counter] = {}


def vocabulary_of(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def counter(path: str = VOCABULARY, content: Callable[[], bytes] | None = None) -> Counter:
    """The counter of this process for a vocabulary; ``content`` gives it where the file isn't at hand."""
    if path not in _counters:
        _counters[path] = Counter(content() if content else vocabulary_of(path))
    return _counters[path]


def store(steps: np.ndarray) -> bytes:
    if not len(steps):
        return b""
    wide = steps.dtype != np.int8 and np.abs(steps).max() > 127
    return (b"\x02" if wide else b"\x01") + zlib.compress(steps.astype(np.int16 if wide else np.int8).tobytes(), 1)


def counts(stored: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... characters."""
    if not stored:
        return np.zeros(1, np.int64)
    steps = np.frombuffer(zlib.decompress(stored[1:]), np.int16 if stored[0] == 2 else np.int8)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def tokens_at(stored: bytes, n_chars: int) -> int:
    """Tokens of the prefix of ``n_chars`` characters."""
    have = counts(stored)
    return int(have[min(n_chars, len(have) - 1)])


def cut(have: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; have: counts of all prefixes."""
    if have[-1] <= budget:
        return len(have) - 1
    return int(len(have) - 1 - np.argmax(have[::-1] <= budget))


def count(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_chars, n_tokens, cut_<budget>..., prefix_counts) for each row of docs. The driver reads the vocabulary, about
    a megabyte, and broadcasts it, so workers need no such file."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    def work(batches):
        own = counter(vocabulary, lambda: shipped.value)
        for batch, texts in C.sliced(batches):
            rows = []
            texts = texts.to_pylist()
            long = len(texts) == 1 and len(texts[0]) > SEGMENT
            for text, steps in zip(texts, [own.steps(texts[0])] if long else own.batch(texts)):
                have = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                rows.append((len(text), int(have[-1]), *(cut(have, b) for b in budgets), store(steps)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=names)

    names = ["doc_id", "n_chars", "n_tokens", *(f"cut_{b}" for b in budgets), "prefix_counts"]
    return C.each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, ", ".join(f"{n} {'binary' if n == 'prefix_counts' else 'long'}" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(C.read(spark, sf_dir, "documents"))
