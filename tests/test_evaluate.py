import pytest
from pyspark.sql import functions as F

from lodeseek.operators import evaluate


def values(spark, a, b):
    return spark.createDataFrame([(n, "map", i, float(x)) for n, v in (("a", a), ("b", b)) for i, x in enumerate(v)], "run_name string, metric string, idx int, value double")


def compared(spark, a, b, samples, seed):
    v = values(spark, a, b)
    return evaluate.compare(v, evaluate.bootstrap_means(v, evaluate.bootstrap_indices(spark, len(a), samples, seed))).first()


def test_equal_runs_differ_by_nothing(spark):
    r = compared(spark, [1.0, 0.5, 0.0], [1.0, 0.5, 0.0], 200, 7)
    assert (r.delta, r.ci_low, r.ci_high, r.p_value) == (0, 0, 0, 1)


def test_better_run_is_significant(spark):
    r = compared(spark, [1, 1, 1, 1], [0, 0, 0, 0], 500, 11)
    assert r.delta > 0 and r.ci_low > 0 and r.p_value < 0.05


def test_missing_query_has_zeros(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], "query_id string, dataset_id string, rel int")
    run = spark.createDataFrame([("q1", "d1", 1, 1.0)], "query_id string, dataset_id string, rank int, score double")
    got = {r.query_id: (r.map, r.ndcg, r.p, r.r) for r in evaluate.query_metrics(run, qrels).collect()}
    assert got == {"q1": (1.0, 1.0, 0.1, 1.0), "q2": (0, 0, 0, 0)}


def test_document_listed_twice_counts_twice(spark):
    qrels = spark.createDataFrame([("q", "d1", 1)], "query_id string, dataset_id string, rel int")
    run = spark.createDataFrame([("q", "d1", 1, 2.0), ("q", "d1", 2, 1.0)], "query_id string, dataset_id string, rank int, score double")
    r = evaluate.query_metrics(run, qrels).first()
    assert (r.map, r.r, r.p) == (2.0, 2.0, 0.2) and round(r.ndcg, 2) == 1.63


def test_adjusted_p_values(spark):
    t = spark.createDataFrame([("m", str(i), p) for i, p in enumerate([0.01, 0.03, 0.02, 0.20])], "metric string, k string, p_value double")
    got = [r.p_adjusted for r in evaluate.adjust_bh(t, "k").orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.04, 0.04, 0.2])


def test_no_relevant_document(spark):
    qrels = spark.createDataFrame([("q", "d", 0)], "query_id string, dataset_id string, rel int")
    run = spark.createDataFrame([("q", "d", 1, 1.0)], "query_id string, dataset_id string, rank int, score double")
    r = evaluate.query_metrics(run, qrels).first()
    assert (r.map, r.ndcg, r.p, r.r) == (0, 0, 0, 0)


def test_excluded_ids(spark):
    r = spark.createDataFrame([("a", False, "ok"), ("b", None, "ok"), ("c", True, "Excluded"), ("d", True, "ok")], "dataset_id string, processable boolean, status string")
    assert {x.dataset_id for x in evaluate.excluded_ids(r).collect()} == {"a", "c"}


def test_levels(spark):
    df = spark.createDataFrame([("L2",), ("l1",), ("2",), (None,)], "x string")
    assert [r[0] for r in df.select(evaluate.level(F.col("x"))).collect()] == [2, 1, None, None]
