"""Operator 4, personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Training runs on the driver once per process for a table of (text, spans), by default synthetic prose with planted
e-mail addresses, phone numbers, IP addresses, card numbers and secrets; the weights are a few kilobytes. Texts are cut
into overlapping windows of similar length, windows of a slice are scored together, each is decoded by Viterbi, and
neighbours are reconciled: they are joined in their overlap at a place that lies inside a span of neither; only a span
that fills the whole overlap, longer than any kind here, is cut in its middle. A window in which "outside" leads everywhere by more than transitions can win back needs no decoding; its
best path is all outside.

Result: (doc_id, start, end, kind): character offsets, end exclusive.

Defined results: null and empty texts have no spans; runs of fewer than ``shortest`` characters (5: no kind has so few) are
none; copies of a row each give their spans, rows with a null doc_id
give spans with a null doc_id; texts of any length are read whole; columns besides doc_id and text are never read.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C

KINDS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
HIDDEN = 12
EMBED = 10
WINDOW, OVERLAP = 448, 64
SHORTEST = 5  # characters of a span, at least
VOCAB = 99
STEPS, BATCH, EXAMPLE = 600, 64, 120

_ID = np.full(1 << 16, VOCAB - 1, np.uint8)  # beyond ASCII
_ID[:128] = 1
_ID[32:127] = np.arange(2, 97)
_ID[48:58] = _ID[48]
_ID[10] = _ID[13] = 97

Spans = list[tuple[int, int, int]]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _ID[np.minimum(points, 65535)]


# ---- labelled spans -------------------------------------------------------------------------------------------------

_SYLLABLES = [
    "th he in er an re on at en nd ti es or ea st ing ion ly wh sh ble ed ou of to and the is was for with by from that".split(),
    "le la de en tre que ré eau eux ai ou on ment tion elle ch oi pa vi ier des un au qui et pour par sur est é è ç ê".split(),
    "de la os as ción mente ado rra que el en es ie ue ll ñ rr qu ar ez ja bo do ci í ó los las una con por para del".split(),
    "der die und sch ein ich ung heit keit en er ver ge be zu ch st pf tz au ä ö ü ß lich eit ach von mit auf für das".split(),
]


def _word(rng: random.Random, syllables: list[str]) -> str:
    return "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 4))))


def _planted(rng: random.Random, syllables: list[str]) -> tuple[str, int]:
    kind = rng.randrange(1, 6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 1:
        user = _word(rng, syllables) + rng.choice((".", "_", "-", "")) + rng.choice((digits(rng.randrange(1, 4)), _word(rng, syllables)))
        host = rng.choice(("mail", "post", "web", "corp", "inbox")) + rng.choice(("", digits(1), digits(2)))
        return f"{user}@{host}.{rng.choice(('example.com', 'example.org', 'example.net', 'test.de', 'co.uk'))}", kind
    if kind == 2:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}")), kind
    if kind == 3:
        return ".".join(str(rng.randrange(0, 256)) for _ in range(4)), kind
    if kind == 4:
        d = digits(16)
        return rng.choice((d, d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))), kind
    n = rng.choice((32, 40, 40, 40, 64))
    value = "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return value.upper() if rng.random() < 0.3 else value, kind


def examples(n: int, seed: int, length: int = EXAMPLE) -> list[tuple[str, Spans]]:
    """Labelled texts: prose with spans, and near misses that are none (years, versions, amounts, junk marks)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        syllables = rng.choice(_SYLLABLES)
        style = rng.random()
        text, spans = "", []
        quiet = rng.random() < 0.3
        while len(text) < length:
            r = rng.random()
            if r < (0.0 if quiet else 0.12):
                value, kind = _planted(rng, syllables)
                if kind == 5:
                    text += rng.choice(('token = "', 'token = "', "key: ", "secret=", 'api_key = "', ""))
                spans.append((len(text), len(text) + len(value), kind))
                text += value
                if kind == 5 and text[: spans[-1][0]].endswith('"'):
                    text += '"'
            elif r < 0.17:
                text += rng.choice((str(rng.randrange(0, 3000)), f"{rng.randrange(9)}.{rng.randrange(9)}.", f"{rng.randrange(99)},{rng.randrange(99)}", f"version {rng.randrange(9)}", "Version 2.0.", "CC BY-NC 4.0.", "|", "-", "https://www." + _word(rng, syllables) + ".example.org/en/" + str(rng.randrange(9999))))
            else:
                word = _word(rng, syllables)
                text += word.upper() if 0.85 < style < 0.92 else word.capitalize() if rng.random() < 0.1 else word
                text += rng.choice((".", ",")) if rng.random() < 0.12 else ""
            if style > 0.92:
                text += rng.choice(("***", "$$$", "%%%", "###", "&&&"))
            elif style > 0.85:
                text += "!!"
            elif style > 0.8:
                text += " |"
            text += "\n" if rng.random() < 0.06 else " "
        start = rng.randrange(0, max(1, len(text) - length))  # spans may be cut at the edges
        text = text[start : start + length]
        cut = [(max(0, a - start), min(length, b - start), k, b - a) for a, b, k in spans if b - start > 0 and a - start < length]
        out.append((text, [(a, b, k) for a, b, k, whole in cut if b - a >= 0.5 * whole and (k != 1 or "@" in text[a:b])]))  # less can't be told
    return out


def labels(text: str, spans: Spans) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for a, b, k in spans:
        y[a:b] = k
    return y


# ---- model ----------------------------------------------------------------------------------------------------------


class Model:
    """Parameters: an embedding of characters (its first column is 1), for each direction weights on [output, embedding]
    and emission weights; transitions.

    Arrays are gate-major ([gates, rows]) so that every operation runs over contiguous memory. Gates are scaled so that
    one tanh serves all four: sigmoid(z) = (1 + tanh(z / 2)) / 2; the state holds twice the usual cell and output.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(KINDS)
        self.h = h
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.3, (4 * h, h + EMBED)).astype(np.float32)
            self.p["w" + d][:, :h] *= 0.8 / np.sqrt(h)
            self.p["w" + d][h : 2 * h, h] += 0.5
            self.p["e" + d] = rng.normal(0, 0.15, (k, h)).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.5, (VOCAB, EMBED)).astype(np.float32)
        self.p["v"][:, 0] = 1
        self.p["o"] = np.zeros(k, np.float32)
        self.p["t"] = np.zeros((k, k), np.float32)
        self.p["s"] = np.zeros(k, np.float32)

    def step(self, d: str, x: np.ndarray, state: np.ndarray, cell: np.ndarray):
        """Gates i, f, o and candidate g after tanh, and the new cell, for rows of characters x; state holds the output and gets the embedding."""
        h = self.h
        state[h:] = self.p["v"].take(x, axis=0).T
        z = self.p["w" + d] @ state
        np.tanh(z, out=z)
        i, f, g = z[:h], z[h : 2 * h], z[3 * h :]
        new = f * cell
        new += cell
        new *= 0.5
        new += g
        new += i * g
        return z, new

    def emissions(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[T, kinds, rows]; x [T, rows] with rows in descending order of size."""
        t_max, n = x.shape
        h = self.h
        out = np.empty((t_max, len(KINDS), n), np.float32)
        out[:] = self.p["o"][:, None]
        live = n - np.searchsorted(size[::-1], np.arange(t_max), "right")  # rows with size > t
        for d in "fb":
            m = n if d == "f" else 0
            state, cell = np.zeros((h + EMBED, m), np.float32), np.zeros((h, m), np.float32)
            for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
                if live[t] != m:
                    both = min(m, live[t])
                    m = live[t]
                    old, state, old_cell, cell = state, np.zeros((h + EMBED, m), np.float32), cell, np.zeros((h, m), np.float32)
                    state[:h, :both], cell[:, :both] = old[:h, :both], old_cell[:, :both]
                z, cell = self.step(d, x[t, :m], state, cell)
                tc = np.tanh(cell * np.float32(0.5))
                hid = state[:h]
                np.multiply(z[2 * h : 3 * h], tc, out=hid)
                hid += tc
                out[t, :, :m] += self.p["e" + d] @ hid
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character, and the gradients per row; x, y [T, rows], all of one length."""
        t_max, n = x.shape
        h, p = self.h, self.p
        g = {}
        em = np.empty((t_max, len(KINDS), n), p["o"].dtype)
        em[:] = p["o"][:, None]
        kept = {}
        for d in "fb":
            hid, cell = np.zeros((h, n), em.dtype), np.zeros((h, n), em.dtype)
            trace = []
            for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
                state = np.empty((h + EMBED, n), em.dtype)
                state[:h] = hid
                z, new = self.step(d, x[t], state, cell)
                tc = np.tanh(new * em.dtype.type(0.5))
                hid = z[2 * h : 3 * h] * tc + tc
                trace.append((t, z, state, cell, tc, hid))
                cell = new
                em[t] += p["e" + d] @ hid
            kept[d] = trace
        # CRF by forward and backward sums, in scaled probabilities
        trans = np.exp(p["t"])
        top = em.max(1, keepdims=True)
        e = np.exp(em - top)
        alpha, beta, c = np.empty_like(em), np.empty_like(em), np.empty((t_max, n), em.dtype)
        a = e[0] * np.exp(p["s"])[:, None]
        for t in range(t_max):
            if t:
                a = e[t] * (trans.T @ alpha[t - 1])
            c[t] = a.sum(0)
            alpha[t] = a / c[t]
        beta[-1] = 1
        for t in range(t_max - 2, -1, -1):
            beta[t] = trans @ (e[t + 1] * beta[t + 1]) / c[t + 1]
        at, rows = np.arange(t_max)[:, None], np.arange(n)
        gold = p["s"][y[0]] + em[at, y, rows].sum(0) + p["t"][y[:-1], y[1:]].sum(0)
        total = float((np.log(c).sum(0) + top[:, 0].sum(0) - gold).mean())
        d_em = alpha * beta
        right = e[1:] * beta[1:] / c[1:, None]
        pair = np.einsum("tin,tjn->ij", alpha[:-1], right, optimize=True) * trans
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_em[at, y, rows] -= 1
        d_em /= n
        g["t"], g["s"], g["o"] = pair / n, d_em[0].sum(1), d_em.sum((0, 2))
        order = np.argsort(x.ravel(), kind="stable")
        used, first = np.unique(x.ravel()[order], return_index=True)
        g["v"] = np.zeros_like(p["v"])
        for d in "fb":
            dh, dc = np.zeros((h, n), em.dtype), np.zeros((h, n), em.dtype)
            dzs = np.empty((t_max, 4 * h, n), em.dtype)
            states, afters = np.empty((t_max, h + EMBED, n), em.dtype), np.empty((t_max, h, n), em.dtype)
            for t, z, state, cell, tc, after in reversed(kept[d]):
                i, f, o, cand = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
                states[t], afters[t] = state, after
                dh = dh + p["e" + d].T @ d_em[t]
                dc += dh * (1 + o) * (1 - tc * tc) * 0.5
                dz = dzs[t]
                dz[:h], dz[h : 2 * h], dz[2 * h : 3 * h], dz[3 * h :] = dc * cand, dc * cell * 0.5, dh * tc, dc * (1 + i)
                dz *= 1 - z * z
                dh = p["w" + d][:, :h].T @ dz
                dc *= (1 + f) * 0.5
            flat = dzs.transpose(0, 2, 1).reshape(-1, 4 * h)
            g["w" + d] = flat.T @ states.transpose(0, 2, 1).reshape(-1, h + EMBED)
            g["e" + d] = d_em.transpose(1, 0, 2).reshape(len(KINDS), -1) @ afters.transpose(0, 2, 1).reshape(-1, h)
            g["v"][used] += np.add.reduceat((flat @ p["w" + d][:, h:])[order], first, axis=0)
        g["v"][:, 0] = 0
        return total / t_max, g

    def slack(self) -> float:
        """If "outside" leads by at least this at every character, the best path is all outside.

        A run of n other labels gains at most what entering, leaving and n - 1 steps within gain over staying outside.
        """
        t, s = self.p["t"].astype(float) - float(self.p["t"][0, 0]), self.p["s"].astype(float)
        enter, leave = max(t[0, 1:].max(), s[1:].max() - s[0]), max(0.0, t[1:, 0].max())
        return float(max(0.0, t[1:, 1:].max(), enter + leave)) + 1e-4

    def viterbi_rows(self, em: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best labels [T, rows] of emissions [T, kinds, rows]; rows in descending order of size."""
        t_max, k, n = em.shape
        back = np.zeros((t_max, k, n), np.int8)
        live = n - np.searchsorted(size[::-1], np.arange(t_max), "right")
        score = em[0] + self.p["s"][:, None]
        trans = self.p["t"]
        for t in range(1, t_max):
            m = live[t]
            paths = score[:, None, :m] + trans[:, :, None]
            best = paths.argmax(0)
            back[t, :, :m] = best
            score[:, :m] = np.take_along_axis(paths, best[None], 0)[0] + em[t, :, :m]
        y = np.zeros((t_max, n), np.int8)
        last = score.argmax(0).astype(np.int8)
        current = np.zeros(n, np.int8)
        for t in range(t_max - 1, -1, -1):
            m = live[t]
            begins = size[:m] == t + 1
            current[:m][begins] = last[:m][begins]
            y[t, :m] = current[:m]
            if t:
                current[:m] = back[t, current[:m], np.arange(m)]
        return y


def train(data: list[tuple[str, Spans]], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, seed: int = 3, rate: float = 0.012) -> Model:
    """Adam on mini-batches; texts of one length each step."""
    model = Model(hidden, seed)
    length = min(len(t) for t, _ in data)
    x = np.stack([codes(t)[:length] for t, _ in data], axis=1).astype(np.intp)
    y = np.stack([labels(t, s)[:length] for t, s in data], axis=1)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(a) for k, a in model.p.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, x.shape[1], batch)
        _, g = model.loss(x[:, rows], y[:, rows])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        scale = min(1.0, 20.0 / (norm + 1e-9))
        lr = rate * min(1, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for k, a in g.items():
            a *= scale
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            model.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


@functools.cache
def default_model() -> Model:
    return train(examples(6000, 17))


# ---- search ---------------------------------------------------------------------------------------------------------


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the windows: a row in even parts of at most WINDOW, each with OVERLAP / 2 more on both sides."""
    parts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    a, b = sizes[row] * k // parts[row], sizes[row] * (k + 1) // parts[row]
    half = OVERLAP // 2
    return row, np.maximum(a - half, 0), np.minimum(b + half, sizes[row])


def _reconcile(pieces: list[tuple[int, int, np.ndarray | None]]) -> np.ndarray:
    """Labels of a whole text from windows (start, end, labels or None for all outside) in order."""
    out = np.zeros(pieces[-1][1], np.int8)
    done = 0
    for n, (a, b, y) in enumerate(pieces):
        end = b
        if n + 1 < len(pieces):
            c, _, other = pieces[n + 1]
            mine = y[c - a :] if y is not None else np.zeros(b - c, np.int8)
            theirs = other[: b - c] if other is not None else np.zeros(b - c, np.int8)
            free = np.flatnonzero((mine == 0) & (theirs == 0))
            middle = (b - c) // 2
            end = c + int(free[np.argmin(np.abs(free - middle))]) if len(free) else c + middle
        if y is not None and end > done:
            out[done:end] = y[done - a : end - a]
        done = max(done, end)
    return out


def find_spans(model: Model, texts: list[str], rows_at_once: int = 1024, shortest: int = SHORTEST) -> list[Spans]:
    """Spans (start, end, kind) of each text, of at least ``shortest`` characters."""
    found: list[Spans] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return found
    stream = codes("".join(texts))
    begin = np.cumsum(sizes) - sizes
    row, a, b = _windows(sizes)
    size = b - a
    by = np.argsort(-size, kind="stable")
    answers: list[np.ndarray | None] = [None] * len(row)
    slack = model.slack()
    waiting: list[tuple[int, np.ndarray]] = []
    for at in range(0, len(by), rows_at_once):
        own = by[at : at + rows_at_once]
        own_size = size[own]
        x = np.zeros((own_size[0], len(own)), np.intp)
        place = (begin[row[own]] + a[own])[None, :] + np.arange(own_size[0])[:, None]
        x[:] = stream[np.minimum(place, len(stream) - 1)]
        em = model.emissions(x, own_size)
        margin = em[:, 0] - em[:, 1:].max(1)
        margin[np.arange(own_size[0])[:, None] >= own_size] = np.inf
        needs = np.flatnonzero(margin.min(0) <= slack)
        waiting += [(own[k], np.ascontiguousarray(em[: own_size[k], :, k])) for k in needs]
    for at in range(0, len(waiting), rows_at_once):  # windows of all sizes in descending order
        some = waiting[at : at + rows_at_once]
        own_size = np.array([len(e) for _, e in some])
        em = np.zeros((own_size[0], len(KINDS), len(some)), np.float32)
        for c, (_, e) in enumerate(some):
            em[: len(e), :, c] = e
        y = model.viterbi_rows(em, own_size)
        for c, (k, e) in enumerate(some):
            if y[: len(e), c].any():
                answers[k] = y[: len(e), c]
    live = np.unique(row[[y is not None for y in answers]]) if len(row) else []
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    for r in live:
        y = _reconcile([(int(a[w]), int(b[w]), answers[w]) for w in range(first[r], first[r + 1])])
        cuts = np.flatnonzero(np.diff(np.r_[0, y, 0]))
        for s, e in zip(cuts[:-1], cuts[1:]):
            if y[s] and e - s >= shortest:
                found[r].append((int(s), int(e), int(y[s])))
    return found


def detect(docs: DataFrame, model: Model | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, start, end, kind) of every span."""
    model = model or default_model()

    def work(batches):
        for batch, texts in C.sliced(batches):
            rows = [(k, *span) for k, spans in enumerate(find_spans(model, texts.to_pylist(), shortest=shortest)) for span in spans]
            if rows:
                k, s, e, kind = (np.array(c) for c in zip(*rows))
                yield C.table(doc_id=batch.column(0).take(pa.array(k)), start=s, end=e, kind=pa.array(np.array(KINDS, object)[kind], pa.string()))

    return C.each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, start long, end long, kind string")


def redact_text(text: str, spans: Spans) -> str:
    out, done = [], 0
    for s, e, kind in spans:
        out += [text[done:s], f"[{KINDS[kind]}]"]
        done = e
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: Model | None = None, shortest: int = SHORTEST) -> DataFrame:
    """docs with every span replaced by [KIND]; n_chars, where there is such a column, follows the new text. Null texts stay null."""
    model = model or default_model()
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            texts = C.strings(column)
            new: list[str] = []
            for a, b in C.slices(texts):
                part = texts.slice(a, b - a).to_pylist()
                new += [redact_text(t, s) if s else t for t, s in zip(part, find_spans(model, part, shortest=shortest))]
            columns = list(batch.columns)
            columns[at] = pa.array([t if ok else None for t, ok in zip(new, column.is_valid().to_pylist())], pa.string())
            if count is not None:
                old = columns[count]
                columns[count] = pa.array([len(t) if ok else o for t, ok, o in zip(new, column.is_valid().to_pylist(), old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return C.each(docs, work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(C.read(spark, sf_dir, "documents"))
