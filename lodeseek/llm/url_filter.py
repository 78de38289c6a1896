"""Operator 8, URL filter: logistic regression on hashed character n-grams of host and path.

A small labelled URL table (a parameter; SEED is the default) trains the weights on the driver in numpy; the weights have
a fixed size and go to every worker. Host and path come from Spark's own string functions, n-grams are hashed and
summed with numpy over whole batches. Query strings and fragments don't count.

Defined results: a null, empty or unparsable URL has null score and is kept (``blocked`` false); copies of a row are
scored alike; rows with a null id are scored too; columns besides the id and the URL are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import _core as C

BITS = 18
SIZES = (3, 4, 5)
THRESHOLD = 0.5
EPOCHS = 300
L2 = 2e-4

_BAD = """casino poker slots jackpot roulette lottery betting bets gambling blackjack pills pharmacy viagra cialis meds steroids xxx porn
adult sex cams escort nude ads adserver adclick clicks tracker popup banner spam linkfarm doorway payday replica warez keygen crack phish""".split()
_BAD_WITH = "online bonus free best cheap live direct super hot win now deal zone hub king farm track".split()
_GOOD = """library museum weather university garden news math recipes science history linux travel music school health council chess birds
film books physics biology chemistry geology astronomy language grammar poetry theatre painting sculpture bicycle railway harbour mountain
river forest village parish bakery coffee tea cheese wine farm-shop carpentry pottery knitting sewing engine robot software database network
compiler kernel browser editor archive journal gazette herald tribune observer review magazine radio orchestra choir piano violin guitar
football tennis rowing sailing climbing hiking camping swimming marathon hospital clinic dentist nursing surgery vaccine nutrition maps
atlas geography census parliament ministry court police tax customs passport embassy treaty union energy solar wind water climate ocean
whale falcon rabbit horse cattle orchard vineyard harvest tractor market insurance bank mortgage pension charity volunteer scout nursery
kindergarten college teacher lesson homework exam degree thesis lecture seminar campus dormitory""".split()
_GOOD_WITH = "city national open daily society club house group centre notes guide world office trust institute studio press".split()
#: Hosts of the tables that come with the tests; none is in the labelled table.
UNSEEN = frozenset("casino-win free-bets cheap-pills ads-track spam-farm adult-x".split())


def _seed() -> list[tuple[str, int]]:
    """A host of each word with four others, over several zones and paths."""
    zones, fronts = ("com", "net", "org", "example.com", "example.net", "example.org", "co.uk", "de", "fr", "es", "info"), ("", "www.", "m.", "blog.", "my.")
    tails = ("", "/", "/en/1", "/de/page.html", "/fr/a/", "/es/b?page=2", "/articles/about-us", "/docs/index.html", "/2024/05/post", "/p/31337")
    rows = []
    for bad, words, others in ((1, _BAD, _BAD_WITH), (0, _GOOD, _GOOD_WITH)):
        for i, word in enumerate(words):
            for j in range(4):
                other, k = others[(5 * i + 7 * j) % len(others)], i + 3 * j
                name = (f"{word}-{other}", f"{other}-{word}", f"{word}{other}")[j % 3]
                if name not in UNSEEN:
                    rows.append((f"http{'s' * (k % 2)}://{fronts[k % 5]}{name}.{zones[k % 11]}{tails[(k + i) % 10]}", bad))
    rows += [(f"https://www.{g}.example.org/{p}", 1) for g, p in (("portal", "casino/free-spins/bonus.html"), ("shop", "discount-pills/order-now"), ("media", "adult/xxx-cams"), ("go", "ads/track/click.php"))]
    rows += [(f"https://www.{g}.example.org/{p}", 0) for g, p in (("portal", "science/articles/42.html"), ("shop", "garden/tools"), ("media", "films/reviews"), ("go", "maps/route.php"))]
    return rows


SEED = _seed()


def parts(url) -> tuple:
    """Host and path of a URL column, in lower case; null where there is no host."""
    clean = F.lower(F.trim(url))
    pattern = r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"
    host = F.regexp_extract(clean, pattern, 1)
    return F.when(host != "", host), F.when(host != "", F.regexp_extract(clean, pattern, 2))


def buckets(texts: pa.Array, seed: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of the texts, with ^ and $ around each."""
    buf, offsets = C.raw(texts)
    n = len(texts)
    size = np.diff(offsets)
    padded = np.zeros(len(buf) + 2 * n, np.uint8)
    begin = offsets[:-1] + 2 * np.arange(n)
    padded[begin], padded[begin + size + 1] = 94, 36
    padded[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, size)] = buf
    row = np.repeat(np.arange(n), size + 2)
    codes = C.BYTE[padded]
    rows, found = [], []
    for k in SIZES:
        if len(codes) < k:
            continue
        h = np.zeros(len(codes) - k + 1, np.uint64)
        for j in range(k):
            h = h * C.U(0x9E3779B97F4A7C15) + codes[j : len(codes) - k + 1 + j]
        inside = row[: len(h)] == row[k - 1 :]
        rows.append(row[: len(h)][inside])
        found.append((C.mix(h + C.U(seed * 16 + k)) >> C.U(64 - bits))[inside].astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64),) * 2


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) with rows of unit length."""
    a, b = buckets(hosts, 1), buckets(paths, 2)
    row, bucket = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    count = np.bincount(row, minlength=len(hosts))
    return row, bucket, 1 / np.sqrt(np.maximum(count, 1))[row]


def _python_parts(url: str) -> tuple[str, str]:
    rest = url.strip().lower().split("//", 1)[-1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].split(":")[0], "/" + path if path or rest.endswith("/") else path


def train(labelled: list[tuple[str, int]] = SEED, epochs: int = EPOCHS, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights by full-batch gradient steps (Adam) on the mean log loss; most hosts of the table are good, so one without known n-grams passes."""
    pairs = [(_python_parts(u), y) for u, y in labelled if u]
    y = np.array([float(v) for _, v in pairs])
    if not len(y) or y.min() == y.max():
        raise ValueError("the labelled URL table needs both kinds")
    row, bucket, value = features(pa.array([p[0] for p, _ in pairs], pa.large_string()), pa.array([p[1] for p, _ in pairs], pa.large_string()))
    used, col = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col] * value, len(y)) + b)))
        e = (p - y) / len(y)
        g, gb = np.bincount(col, e[row] * value, len(w)) + l2 * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return full, float(b)


def classify(pages: DataFrame, labelled: list[tuple[str, int]] = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, url_score, blocked) for each row of pages."""
    weights, bias = train(labelled)
    host, path = parts(F.col("url"))

    def work(batches):
        for batch in batches:
            hosts, paths = C.strings(batch.column(2)), C.strings(batch.column(3))
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            row, bucket, value = features(hosts, paths)
            score = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket] * value, len(hosts)) + bias)))
            yield C.table(page_id=batch.column(0), url=batch.column(1), url_score=pa.array(score, mask=~known), blocked=known & (score >= threshold))

    return C.each(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path")), work, "page_id long, url string, url_score double, blocked boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.read(spark, sf_dir, "pages"))
