import pytest

from lodeseek.plans import lifecycle, providers
from lodeseek.streaming import incremental

RECORDS = [("d1", "rain by month", True), ("d2", "trains and stations", True), ("d3", "hidden", False), ("d4", None, True)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "dataset_id string, data_profile string, processable boolean")


def test_index_and_search(spark, records):
    index = lifecycle.index_offline(records, providers.Offline(), 32)
    rows = index.collect()
    assert {r.dataset_id for r in rows} == {"d1", "d2"} and {r.variant for r in rows} == {"with_semantic", "without_semantic"}
    assert len({r.doc_id for r in rows}) == len(rows) and lifecycle.index_offline(records, providers.Offline(), 32, index).count() == 0
    topics = spark.createDataFrame([("q", "data about trains")], "query_id string, text string")
    best = lifecycle.search_online(topics, index.where("variant = 'without_semantic'"), providers.Offline(), 32, optimise=False).orderBy("rank").first()
    assert best.dataset_id == "d2" and best.score == 1.0


def test_search_is_reranked_by_the_provider(spark, records):
    class Ranker(providers.Offline):
        def complete(self, task, text):
            if task != "rerank":
                return super().complete(task, text)
            return '{"ranking": [{"dataset_id": "d1", "score": 0.9}]}' if '"query":"data about trains"' in text and "d2" in text else "no answer"

    index = lifecycle.index_offline(records, providers.Offline(), 32).where("variant = 'without_semantic'")
    topics = spark.createDataFrame([("q", "data about trains"), ("other", "data about rain")], "query_id string, text string")
    got = {(r.query_id, r["rank"]): (r.dataset_id, r.score) for r in lifecycle.search_online(topics, index, Ranker(), 32, optimise=False, hits_per_query=20).collect()}
    assert got["q", 1] == ("d1", 0.9) and got["q", 2] == ("d2", 0.5)
    assert got["other", 1] == ("d1", 1.0)


def test_normalise_queries(spark):
    df = spark.createDataFrame([('```json\n{"queries": [{"query": " a "}, {"query": ""}]}\n```',), ('{"queries": ["b", " "]}',), ("bad",), (None,)], "answer string")
    assert [r[0] for r in df.select(lifecycle.normalise_queries()).collect()] == [["a"], ["b"], [], []]


def test_configs(spark):
    assert lifecycle.configs(spark).count() == 1 and lifecycle.configs(spark, every=True).count() == 4
    with pytest.raises(ValueError):
        lifecycle.configs(spark, "no")


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert providers.with_retries(call, sleep=waits.append) == "yes" and waits == [2.0, 4.0]


def test_failed_call_is_a_row(spark):
    class Bad(providers.Offline):
        def complete(self, task, text):
            raise OSError("down")

    providers.WAIT, keep = 0, providers.WAIT
    df = spark.createDataFrame([("x",)], "t string")
    try:
        r = providers.complete(df, Bad(), "any", "t", "out")
        assert r.columns == ["t", "out", "out_error"]
    finally:
        providers.WAIT = keep


def test_replay(spark):
    stored = spark.createDataFrame([("q", 2, "d", "t2"), ("q", 1, "d", "t1"), ("q", 3, "d", "t3")], "query string, rank int, database_id string, table_id string")
    got = {r["query"]: [t.table_id for t in r.tables] for r in lifecycle.replay(spark.createDataFrame([("q",), ("z",)], "query string"), stored, 2).collect()}
    assert got == {"q": ["t1", "t2"], "z": []}


def test_stream(spark, records, tmp_path):
    records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, providers.Offline(), 16, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).select("dataset_id").distinct().count() == 2


def test_windowed_counts(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    assert incremental.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()
