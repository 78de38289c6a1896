"""License scan, decontamination, n-gram join and suffix dedup: SQL, brute force and edge cases."""

import random
import re
import textwrap
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import _core, decontaminate, license_scan, ngram_join, registry, suffix_dedup

WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORDS.findall((text or "").lower())


def corpus(seed=1, n=120):
    """Documents with exact copies, near copies, shared passages and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and", "a"] * 40
    rows, passages = [], [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(3)]
    for i in range(n):
        r = rng.random()
        if r < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif r < 0.45 and rows:
            w = rng.choice(rows)[1].split()
            text = " ".join(rng.choice(vocab) if rng.random() < 0.06 else x for x in w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 5, 8, 20, 60, 120))))
            if rng.random() < 0.2:
                text += "\n" + rng.choice(passages) + ". " + " ".join(rng.choice(vocab) for _ in range(20))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        p = Path(f"{small}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    df = registry.queries()[name](spark, small)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = sorted(plain(r) for r in df.select(*sorted(df.columns)).collect())
    result = con.execute(registry.oracle_sql()[name])
    at = sorted((c[0], i) for i, c in enumerate(result.description))
    assert got == sorted(plain([r[i] for _, i in at]) for r in result.fetchall()) and got


def test_words_are_the_pattern():
    texts = ["Hello, World! x2", "", "ÄÖ ß 日本 a b", "a" * 10, "...", "tail"]
    w = _core.Words(pa.array(texts, pa.large_string()))
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    same = _core.Words(pa.array(["b a", "a c b"], pa.large_string())).hashes
    assert same[0] == same[4] and same[1] == same[2] and len(set(same.tolist())) == 3


def test_license_blocks(make):
    docs = make([(1, "x\nReleased under the MIT License.\nand RELEASED under THE mit license"), (2, "mit license"), (2, "Licensed under CC BY-NC 4.0."), (3, "released under the license of mit and more words"), (None, "Released under the MIT License.")])
    got = {(r.doc_id, r.block_no, r.template_id) for r in license_scan.scan(docs).collect()}
    assert {(1, 1, "mit-notice"), (1, 2, "mit-notice"), (2, 0, "cc-by-nc-4.0"), (3, 0, "mit-notice")} <= got
    assert not any(d is None for d, _, _ in got) and (2, 0, "mit-notice") not in got


def test_license_lines_of_the_documents_are_found(spark):
    """Every license line that occurs in the documents has a template, 'All rights reserved.' too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sought = re.compile(r"\b(licen[sc]ed?|all rights reserved|copyright)\b", re.I)
    want = {(r.doc_id, k) for r in docs.collect() for k, line in enumerate(r.text.split("\n")) if sought.search(line)}
    found = {(r.doc_id, r.block_no) for r in license_scan.scan(docs).collect()}
    assert len(want) > 40 and want == found


def test_license_brute_force(make):
    rng = random.Random(4)
    templates = [(f"t{i}", " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))) for i in range(12)] + [("empty", "!!")]
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 9))) for _ in range(4))) for i in range(60)]
    want = set()
    for i, text in rows:
        for b, line in enumerate(text.split("\n")):
            for name, t in templates:
                ts = set(words(t))
                if ts and len(ts & set(words(line))) / len(ts) >= 0.7 - 1e-9:
                    want.add((i, b, name))
    assert {(r.doc_id, r.block_no, r.template_id) for r in license_scan.scan(make(rows), templates, 0.7).collect()} == want


@pytest.mark.parametrize("width", [20, 40, 75])
def test_wrapped_licenses_are_found(make, width):
    """Each built-in template, wrapped in prose and in comments, is found where no line alone holds it."""
    rows = []
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        lines = textwrap.wrap(f"Some prose comes first here. {t} More prose.", width)
        rows += [(i, "\n".join(lines)), (100 + i, "intro\n\n" + "\r\n".join(f" * {x}" for x in lines))]
    rows.append((200, "\n".join(textwrap.wrap(license_scan.TEMPLATES[2][1], width) * 3)))
    rows.append((201, "released\n" + "other words in between\n" * 9 + "under the\n" + "other words in between\n" * 9 + "mit license"))
    rows.append((202, "This work is licensed under the GNU General Public License, version 3.\ndas kommt mit"))
    got = [(r.doc_id, r.block_no, r.template_id, r.overlap, r.template_tokens) for r in license_scan.scan(make(rows), wrapped=True).collect()]
    names = [name for name, _ in license_scan.TEMPLATES]
    assert {(base + i, names[i]) for i in range(len(names)) for base in (0, 100)} <= {(d, name) for d, _, name, _, _ in got}
    assert len([g for g in got if g[0] == 200]) == 3 and all(n == m for d, _, _, n, m in got if d == 200)
    assert not [g for g in got if g[0] == 201]
    assert "mit-notice" not in {g[2] for g in got if g[0] == 202}
    alone = {(r.doc_id, r.block_no, r.template_id) for r in license_scan.scan(make(rows)).collect()}
    assert alone < {g[:3] for g in got} and len(got) == len({g[:3] for g in got})


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def benchmark_case(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((2, 4, 9, 17, 40, 90))))) for i in range(40)] + [(None, "a b c d"), (99, None), (98, "")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice((5, 300, 3000)))]
        if rng.random() < 0.6:
            passage = [x for x in rng.choice(items[:40])[1].split()]
            if rng.random() < 0.5 and len(passage) > 8:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    rows += [(200, items[3][1]), (201, None)]
    want = {}
    for i, text in rows:
        g = grams(text, 3)
        for j, t in items[:40]:
            s = grams(t, 3)
            if len(g & s) >= 0.6 * len(s) - 1e-9:
                want[i, j] = len(g & s)
    return rows, spark.createDataFrame(items, "item_id long, text string"), want


@pytest.mark.parametrize("most", [100_000, 5])
def test_decontamination_brute_force(make, benchmark_case, most):
    rows, items, want = benchmark_case
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.find(make(rows), items, max_broadcast_items=most).collect()}
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items()) and len(got) >= 0.97 * len(want) > 30
    kept = {r.doc_id for r in decontaminate.drop_contaminated(make(rows), items, max_broadcast_items=most).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


@pytest.mark.parametrize("most", [100_000, 1])
def test_contaminated_rows_go_by_their_own_text(make, spark, most):
    """Null and repeated ids make no difference, however the items are held."""
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(3)], "item_id long, text string")
    bad = [f"before {r.text} after" for r in items.collect()]
    rows = [(None, bad[0]), (None, "clean one"), (1, bad[1]), (1, "clean two"), (1, None), (2, bad[2]), (2, bad[2]), (3, "clean two"), (None, None)]
    kept = decontaminate.drop_contaminated(make(rows), items, max_broadcast_items=most)
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if t not in bad)


def jaccard_pairs(rows, n, t):
    sets = {i: grams(x, n) for i, x in rows}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


def closure(pairs, rows, n):
    """All pairs that a result in linear size stands for."""
    sets = {i: frozenset(grams(x, n)) for i, x in rows}
    same = defaultdict(list)
    for i, s in sets.items():
        if s:
            same[s].append(i)
    out = {}
    for (a, b), j in pairs.items():
        for x in same[sets[a]]:
            for y in same[sets[b]]:
                if x != y:
                    out[min(x, y), max(x, y)] = j
    return out


@pytest.mark.parametrize(("n", "t", "limits"), [(2, 0.65, {}), (1, 0.5, {}), (2, 0.4, {"max_broadcast_entities": 3}), (3, 0.8, {"rare": 2}), (2, 0.65, {"rare": 4}), (1, 0.3, {"rare": 3})])
def test_ngram_join_brute_force(make, n, t, limits):
    rows = corpus()
    result = ngram_join.join(make(rows), n, t, **limits).collect()
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in result}
    assert len(pairs) == len(result)
    got, want = closure(pairs, rows, n), jaccard_pairs(rows, n, t)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 30


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_entities": 3}, {"rare": 1}])
def test_ngram_join_gives_every_pair(make, limits):
    """Pairs of copies that aren't the least id, and their near pairs, are rows of the result."""
    rows = corpus()
    rows += [(1000 + i, rows[i % 9][1]) for i in range(30)]
    result = ngram_join.all_pairs(make(rows), 2, 0.65, **limits).collect()
    got, want = {(r.doc_a, r.doc_b): r.jaccard for r in result}, jaccard_pairs(rows, 2, 0.65)
    assert len(got) == len(result) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > ngram_join.join(make(rows), 2, 0.65).count()


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_frequent_tokens_are_combined(make, t):
    """With all tokens frequent every pair is found by combinations alone, with few chunks and with many."""
    rows = corpus(3, 80)
    got = closure({(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.join(make(rows), 2, t, rare=0).collect()}, rows, 2)
    assert set(got) == set(jaccard_pairs(rows, 2, t))


def test_counts_over_many_chunks(make, monkeypatch):
    """Chunks and ranges of a few tokens, and lists of a few copies, give the same pairs."""
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    monkeypatch.setattr(ngram_join, "COPIES", 3)
    monkeypatch.setattr(_core, "ROWS", 5)
    rows = corpus(8, 80)
    rows += [(1000 + i, rows[i % 4][1]) for i in range(40)]
    result = ngram_join.all_pairs(make(rows)).collect()
    got, want = {(r.doc_a, r.doc_b): r.jaccard for r in result}, jaccard_pairs(rows, 2, 0.65)
    assert len(got) == len(result) and set(got) == set(want)


def crowd_corpus(seed=11):
    """Two crowds of near copies at several distances, one of them a copy of the other with changes, and a corpus."""
    rng = random.Random(seed)
    base = [f"c{rng.randrange(400)}" for _ in range(80)]
    other = [f"d{k}" if k % 7 == 0 else x for k, x in enumerate(base)]
    rows = corpus(seed, 60)
    for i in range(130):
        share = rng.choice((0.01, 0.03, 0.06, 0.1, 0.15))
        rows.append((2000 + i, " ".join(f"n{rng.randrange(50)}" if rng.random() < share else x for x in (base, other)[i % 3 == 0])))
    return rows + [(3000 + i, rows[60 + i % 20][1]) for i in range(30)]


def classes_of(pairs, rows):
    root, links = {i: i for i, _ in rows}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in root}


@pytest.mark.parametrize(("t", "crowd", "side"), [(0.65, 4, 16), (0.65, 20, 2048), (0.4, 8, 16), (0.85, 4, 16), (0.65, 0, 16)])
def test_crowds_lose_no_link(make, monkeypatch, t, crowd, side):
    """Members and visitors of crowds, in blocks of any size, give the pairs, classes and links of brute force."""
    monkeypatch.setattr(ngram_join, "SIDE", side)
    rows = crowd_corpus()
    want = jaccard_pairs(rows, 2, t)
    result = ngram_join.all_pairs(make(rows), threshold=t, crowd=crowd).collect()
    got = {(r.doc_a, r.doc_b): r.jaccard for r in result}
    assert len(got) == len(result) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 500
    found = ngram_join.classes(make([*rows, (None, rows[0][1]), (9000, None), (9001, "...")]), threshold=t, crowd=crowd).collect()
    assert len(found) == len(rows) + 2 and {r.doc_id: (r.class_id, r.n_links) for r in found} == classes_of(want, rows) | {9000: (9000, 0), 9001: (9001, 0)}


def test_crowds_leave_the_index(make, monkeypatch):
    """Near copies of one text are never candidates pair by pair."""
    rng, sent = random.Random(4), []

    def counted(*args, real=ngram_join.candidates):
        sent.append((pairs := real(*args)).count())
        return pairs

    monkeypatch.setattr(ngram_join, "candidates", counted)
    rows = [(i, " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.03 else f"c{k}" for k in range(200))) for i in range(300)]
    found = ngram_join.classes(make(rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == classes_of(jaccard_pairs(rows, 2, 0.65), rows) and sent == [0]


@pytest.mark.parametrize("most", [1, 1000])
def test_shared_tokens_by_products(most):
    rng = np.random.default_rng(most)
    sets = [np.unique(rng.integers(0, most * 40, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    assert (ngram_join._shared(sets[:15], sets[15:]) == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]).all()


def test_keep_one_of_each_group(make):
    rows = corpus(5, 90)
    pairs, root = jaccard_pairs(rows, 2, 0.65), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    docs = make(rows + [(None, rows[0][1]), (500, None)])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i, _ in rows} | {500})
    assert kept.where("doc_id IS NULL").count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in ngram_join.components(edges).collect()} == {2: 1, 3: 1, 4: 1, 5: 1, 9: 8}


def repeated(rows, length):
    seen = defaultdict(set)
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].add((i, p))
    marks = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                marks[i, k == 0].add(p)
    out = set()
    for (i, first), ps in marks.items():
        ps = sorted(ps)
        start = ps[0]
        for a, b in zip(ps, ps[1:] + [None]):
            if b != a + 1:
                out.add((i, start, a + length, first))
                start = b
    return out


@pytest.mark.parametrize(("length", "limits"), [(50, {}), (50, {"hot": 3}), (50, {"hot": 0}), (20, {}), (20, {"hot": 5}), (12, {}), (100, {}), (2, {})])
def test_suffix_spans_brute_force(make, length, limits):
    rows = corpus(6, 100) + [(300, "again and " * 40)]
    got = {(r.doc_id, r.start_word, r.end_word, r.is_first) for r in suffix_dedup.spans(make(rows), length, **limits).collect()}
    assert got == repeated(rows, length) and len(got) > (5 if length > 50 else 10)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_repeated_rows_in_batches_of_any_size(step):
    """A key over many batches, with repeated rows, is found as in one batch."""
    rng = random.Random(step)
    rows = sorted((rng.randrange(12) ** 2 // 9, rng.randrange(4), rng.randrange(3)) for _ in range(60))
    batches = [_core.table(key=pa.array([r[0] for r in x]), doc_id=pa.array([r[1] for r in x]), pos=pa.array([r[2] for r in x])) for x in (rows[i : i + step] for i in range(0, 60, step))]
    got = [tuple(map(int, r)) for part in suffix_dedup._repeated(batches) for r in zip(*part)]
    places = defaultdict(list)
    for r in sorted(set(rows)):
        places[r[0]].append(r)
    assert got == [(*r, int(r == p[0])) for _, p in sorted(places.items()) if len(p) > 1 for r in p]


def test_covers_are_complete():
    for v, d in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert [suffix_dedup.cover(n)[0] for n in (2, 12, 20, 50, 100)] == [1, 1, 7, 13, 31]


def test_edge_cases(edge, none, spark):
    items = spark.createDataFrame([(1, "one"), (2, "word word word"), (3, None)], "item_id long, text string")
    for docs in (edge, none):
        assert license_scan.scan(docs).count() == 0
        found = decontaminate.find(docs, items).collect()
        assert {(r.doc_id, r.item_id) for r in found} == ({(4, 1), (5, 1), (6, 2)} if docs is edge else set())
        assert decontaminate.drop_contaminated(docs, items.where("false")).count() == docs.count()
        pairs = {(r.doc_a, r.doc_b) for r in ngram_join.join(docs).collect()}
        assert pairs == ({(4, 5)} if docs is edge else set())
        assert ngram_join.keep_one(docs).count() == (11 if docs is edge else 0)
        spans = suffix_dedup.spans(docs).collect()
        assert {r.doc_id for r in spans} <= {6} and (docs is none or spans)
