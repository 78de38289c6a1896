"""Bad files, sampled scans, sinks, replay checks, ablation, and searches beyond what a worker holds."""

import gzip
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek import registry
from lodeseek.functions import terms
from lodeseek.operators import evaluate, search
from lodeseek.plans import lifecycle, providers
from lodeseek.sources import records, tables


def test_bad_files_have_reasons(spark, tmp_path):
    """A file that breaks its reader is a row with a reason; the others are read."""
    whole = gzip.compress(b"a,b\n1,2\n" * 500)
    files = {"good.csv": b"a,a,b\n1,2,3\n", "cut.csv.gz": whole[:-20], "not.gz": b"plain", "odd.json": b'{"a": "\xff\xfe\xfa"}', "broken.parquet": b"PAR1 nothing", "broken.feather": b"ARROW1", "empty.csv": b" \n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in tables.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "good.csv": None, "cut.csv.gz": "gz_corrupt", "not.gz": "gz_corrupt", "odd.json": "json_undecodable", "broken.parquet": "parquet_unparsable", "broken.feather": "feather_unparsable", "empty.csv": "empty_file",
    }
    assert got["good.csv"].cells == {"a": "1", "a_2": "2", "b": "3"}


def test_two_passes(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,x\n" + "".join(f"{i},{i * 2}\n" for i in range(500)))
    stats, sample = tables.two_passes(spark, str(tmp_path / "big.csv"), 20, seed=1)
    assert {r["column"]: (r.rows_total, r["mean"]) for r in stats.collect()} == {"id": (500, 249.5), "x": (500, 499.0)}
    again = tables.two_passes(spark, str(tmp_path / "big.csv"), 20, seed=1)[1]
    assert sample.count() == 20 and sorted(sample.collect()) == sorted(again.collect())


def test_sinks_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("ä", 1), ("b", 2)], "id string, n int")
    records.write_json(df, str(tmp_path / "out"))
    assert "ä" in next((tmp_path / "out").glob("*.json")).read_text() and spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "lines.txt").write_text("a\n\n  \nb\n")
    assert records.count_lines(spark, str(tmp_path / "lines.txt")).first()[0] == 2
    schema = "query string, tables array<string>"
    assert records.empty_retrievals_of(spark, str(tmp_path / "none.json"), schema) == -1
    (tmp_path / "some.json").write_text('{"query": "a", "tables": []}\n{"query": "b", "tables": ["t"]}\n{"query": "c"}\n')
    assert records.empty_retrievals_of(spark, str(tmp_path / "some.json"), schema) == 2


def test_preflight_and_described_queries(spark, tmp_path):
    one, none = spark.range(1), spark.range(0)
    got = {r.check: r.ok for r in lifecycle.preflight(spark, [str(tmp_path), str(tmp_path / "no")], {"full": one, "old": none}, {"original": one}).collect()}
    assert list(got.values()) == [True, False, True, False, True]
    rows = spark.createDataFrame([("d1", "rain in spain")], "dataset_id string, data_profile string")
    assert [r.text for r in lifecycle.described_queries(rows, providers.Offline(), "key_points").orderBy("n").collect()] == ["rain", "in", "spain"]


def test_ablation_has_every_configuration(spark):
    provider = providers.Offline()
    rows = spark.createDataFrame([(f"d{i}", f"profile of {w}", True) for i, w in enumerate(("rain", "trade", "birds"))], "dataset_id string, data_profile string, processable boolean")
    corpus = lifecycle.index_offline(rows, provider, 16).cache()
    topics = spark.createDataFrame([("q1", "rain data"), ("q2", "trade")], "query_id string, text string")
    got = lifecycle.ablation(topics, corpus, provider, 16, hits_per_query=3, k=2).collect()
    assert {r.config for r in got} == {c[0] for c in lifecycle.CONFIGS} and {r.query_id for r in got} == {"q1", "q2"}


def test_bootstrap_draws_one_sequence(spark):
    rng = random.Random(42)
    want = [(s, p, rng.randrange(7)) for s in range(30) for p in range(7)]
    assert sorted(map(tuple, evaluate.bootstrap_indices(spark, 7, 30).collect())) == want
    assert evaluate.bootstrap_indices(spark, 0, 30).count() == 0


def test_tokens_of_texts():
    texts = ["Hello, WORLD x2 é a", "", "...", "K is Kelvin, İstanbul", "end", "start"]
    row, words = terms.tokens_of(pa.array(texts, pa.large_string()))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall("[A-Za-z0-9]+", t.lower())]
    assert list(zip(row.tolist(), words.to_pylist())) == want


@pytest.mark.parametrize("inner", [False, True])
def test_nearest_with_and_without_a_matrix(spark, inner, monkeypatch):
    """The matrix product, and the join beyond its limit, give the same ranks; ties go by id."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[40:80] = x[0]
    corpus = spark.createDataFrame([(f"{i:03}", [float(v) for v in r]) for i, r in enumerate(x)] + [("short", [1.0]), ("none", None)], "dataset_id string, embedding array<float>")
    queries = corpus.where("dataset_id < '006'").withColumnRenamed("dataset_id", "query_id")
    find = search.knn_ip if inner else search.knn_l2
    fast = sorted(map(tuple, find(corpus, queries, 7).collect()))
    monkeypatch.setattr(search, "_nearest", lambda *a, **k: None)
    assert fast == sorted(map(tuple, find(corpus, queries, 7).collect())) and len(fast) == 42


def test_bm25_without_a_vocabulary_at_hand(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"w{i % 5} w{i % 3} common") for i in range(40)] + [("empty", ""), ("null", None)], "dataset_id string, text string")
    queries = spark.createDataFrame([("a", "w1 w1 common"), ("b", "nothing here"), ("c", "w4")], "query_id string, text string")
    held = sorted(map(tuple, search.bm25(docs, queries).collect()))
    monkeypatch.setattr(search, "vocabulary_of", lambda asked: None)
    assert held == sorted(map(tuple, search.bm25(docs, queries).collect())) and {r[0] for r in held} == {"a", "c"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def searched(spark):
    """Ties, texts of one term, an empty and a null one; a query that finds nothing, and one without a term."""
    texts = [f"w{i % 7} w{i % 3} w{i % 3} Common, x{i} ΟΔΟΣ" if i % 4 else f"same words {'common ' * (i % 5)}" for i in range(200)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("empty", " "), ("null", None)], "dataset_id string, text string").repartition(3)
    queries = spark.createDataFrame([("a", "w1 w1 common οδος"), ("b", "nothing here"), ("c", "w4 same x9"), ("d", ""), ("e", "common, words")], "query_id string, text string")
    return docs, queries


@pytest.mark.parametrize("k", [1, 10, 500])
def test_okapi_without_pairs(spark, searched, k, monkeypatch):
    """no pair of query and document is joined or exchanged, and the ranks are those of the join."""
    found = search.bm25_okapi(*searched, k=k)
    assert "Join" not in plan(found)
    held = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(search, "asked_terms", lambda asked: None)
    assert held == sorted(map(tuple, search.bm25_okapi(*searched, k=k).collect())) and len(held) == 5 * min(k, 202)


@pytest.mark.parametrize("most", [2, 256])
def test_sparse_search_without_pairs(spark, searched, most, monkeypatch):
    """documents are pooled and scored where they are read; the ranks are those of the join."""
    found = search.sparse_search(*searched, k=10, most=most)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    held = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(search, "asked_terms", lambda asked: None)
    assert held == sorted(map(tuple, search.sparse_search(*searched, k=10, most=most).collect())) and held


@pytest.mark.parametrize("k", [1, 10, 500])
def test_bm25_without_pairs(spark, searched, k, monkeypatch):
    """only the best of each task are exchanged; the ranks are those of the join."""
    found = search.bm25(*searched, k=k)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    held = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(search, "asked_terms", lambda asked: None)
    assert held == sorted(map(tuple, search.bm25(*searched, k=k).collect())) and held


@pytest.mark.parametrize("find", [search.bm25, search.bm25_okapi, search.sparse_search])
def test_repeated_ids_are_joined(spark, searched, find, monkeypatch):
    docs, queries = searched
    docs = docs.unionByName(docs.limit(30)).unionByName(spark.createDataFrame([(None, "w1 common")], docs.schema))
    held = sorted(map(tuple, find(docs, queries).collect()), key=repr)
    monkeypatch.setattr(search, "asked_terms", lambda asked: None)
    assert held == sorted(map(tuple, find(docs, queries).collect()), key=repr) and held


def test_only_the_best_of_a_task_leave_it(spark):
    """a crowd of equal documents, and worse ones, stay where they are; ids decide."""
    docs = spark.range(3000).select(F.format_string("%04d", 2999 - F.col("id")).alias("dataset_id"), F.lit("a b").alias("text")).coalesce(1)
    queries = spark.createDataFrame([("q", "a")], "query_id string, text string")
    found = terms.score_documents(docs, queries, ["q"], [(0, "a", 1.0)], lambda tf, dl: tf / dl, 5)
    assert found.count() <= 5 * 3  # three batches of at most 2000 and 1000 documents, or fewer
    assert [r.dataset_id for r in search.bm25(docs, queries, 5).orderBy("rank").collect()] == [f"{i:04}" for i in range(5)]


def test_slices_copy_no_whole_batch():
    """a batch with a null was copied whole."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(2001)), pa.array(["word " * 800] * 2000 + [None])], names=["k", "text"])
    before, most, rows = pa.total_allocated_bytes(), 0, 0
    for keys, texts in terms._slices(batch):
        most, rows = max(most, pa.total_allocated_bytes() - before), rows + len(keys)
        assert texts.null_count == 0 and texts.type == pa.large_string()
    assert rows == 2001 and most < 3 << 20


@pytest.mark.parametrize("name, finding", [("run_summary", "F5"), ("rank_metrics", "F5"), ("linear_gain_metrics", "F6"), ("reciprocal_rank", "F8"), ("graded_metrics", "F9"), ("run_diagnostics", "F10")])
def test_metrics_read_a_written_run(spark, small, name, finding):
    """The run and its judgements are made once: no plan of metrics reads documents or labels, or calls Python."""
    text = plan(registry.queries()[name](spark, small))
    assert "documents.parquet" not in text and "labels.parquet" not in text and "InArrow" not in text
