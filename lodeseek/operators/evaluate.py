"""Ranked runs against judgements, significance, and edits of judgement files."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("map", "ndcg", "p", "r")


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows with their position among the query's rows (rank, then score) and their label, 0 if not judged."""
    seq = [F.asc("seq")] if "seq" in run.columns else [F.asc("dataset_id")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.asc("rank"), F.desc("score"), *seq))
    return run.withColumn("i", place).join(qrels, ["query_id", "dataset_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def query_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, map, ndcg, p, r) for every query with judgements; one that the run lacks has zeros.

    AP has no depth cut and divides by all relevant documents; precision divides by k; the ideal list holds all judged
    ones. A document that a run lists twice counts twice, so such a run can exceed 1.
    """
    w = W.partitionBy("query_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("int")
    rows = _judged(run, qrels).withColumn("hit", hit).withColumn("hits", F.sum("hit").over(w))
    gain = lambda i: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(i + 1.0)
    near = F.col("i") <= k
    got = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("i"))).alias("ap"), F.sum(F.when(near, gain(F.col("i")))).alias("dcg"), F.sum(F.when(near, F.col("hit"))).alias("top")
    )
    ideal = qrels.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "dataset_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(near, gain(F.col("i")))).alias("idcg"), F.sum((F.col("rel") > 0).cast("int")).alias("relevant"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = ideal.join(got, "query_id", "left")
    return out.select(
        "query_id",
        zero(F.try_divide(F.col("ap"), F.col("relevant"))).alias("map"),
        zero(F.try_divide(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
        zero(F.col("top") / F.lit(float(k))).alias("p"),
        zero(F.try_divide(F.col("top"), F.col("relevant"))).alias("r"),
    )


def linear_gain_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """The other evaluator: documents once by greatest score, sorted by score, linear gain, only queries of the run."""
    best = run.groupBy("query_id", "dataset_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("dataset_id"))))
    out = query_metrics(best, qrels, k).drop("ndcg")
    gain = F.col("rel") / F.log2(F.col("i") + 1.0)
    near = F.col("i") <= k
    dcg = _judged(best, qrels).groupBy("query_id").agg(F.sum(F.when(near, gain)).alias("dcg"))
    ideal = qrels.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "dataset_id"))).groupBy("query_id").agg(F.sum(F.when(near, gain)).alias("idcg"))
    ndcg = dcg.join(ideal, "query_id").select("query_id", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))
    return out.join(ndcg, "query_id")


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """1 / position of the first relevant document, 0 without one."""
    rows = _judged(run, qrels).where("rel > 0").groupBy("query_id").agg(F.min("i").alias("i"))
    return qrels.select("query_id").distinct().join(rows, "query_id", "left").select("query_id", F.coalesce(1 / F.col("i"), F.lit(0.0)).alias("rr"))


def graded_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rr, ndcg_3, ndcg_5, ndcg_10, p_10, recall, err, q) of every judged query.

    err: expected reciprocal rank to depth k, a document satisfies with (2^rel - 1) / 2^m, m the greatest label of all.
    q: Q-measure with gain rel and beta 1: at each relevant position (hits + gain so far) / (position + ideal gain so far),
    averaged over all relevant documents.
    """
    w = W.partitionBy("query_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    most = qrels.agg(F.max("rel").alias("most"))
    ideal = qrels.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "dataset_id"))).withColumn("ideal_gain", F.sum("rel").over(w))
    rows = _judged(run, qrels).crossJoin(F.broadcast(most)).withColumn("hit", (F.col("rel") > 0).cast("int"))
    rows = rows.withColumn("hits", F.sum("hit").over(w)).withColumn("gain", F.sum("rel").over(w))
    rows = rows.withColumn("stop", (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.pow(F.lit(2.0), F.col("most")))
    rows = rows.withColumn("go_on", F.exp(F.coalesce(F.sum(F.log(1 - F.col("stop"))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))))
    total = ideal.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"), F.max("ideal_gain").alias("all_gain"), *(F.sum(F.when(F.col("i") <= n, _gain())).alias(f"ideal_{n}") for n in (3, 5, 10)))
    rows = rows.join(ideal.select("query_id", "i", "ideal_gain"), ["query_id", "i"], "left").join(total.select("query_id", "all_gain"), "query_id")
    blended = (F.col("hits") + F.col("gain")) / (F.col("i") + F.coalesce("ideal_gain", "all_gain"))
    got = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("hit") == 1, 1 / F.col("i"))).alias("rr"), *(F.sum(F.when(F.col("i") <= n, _gain())).alias(f"dcg_{n}") for n in (3, 5, 10)), F.sum(F.when(F.col("i") <= 10, F.col("hit"))).alias("top"),
        F.sum("hit").alias("found"), F.sum(F.when(F.col("i") <= k, F.col("stop") * F.col("go_on") / F.col("i"))).alias("err"), F.sum(F.when(F.col("hit") == 1, blended)).alias("q"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = total.join(got, "query_id", "left")
    return out.select(
        "query_id", zero(F.col("rr")).alias("rr"), *(zero(F.try_divide(f"dcg_{n}", f"ideal_{n}")).alias(f"ndcg_{n}") for n in (3, 5, 10)), zero(F.col("top") / 10.0).alias("p_10"), zero(F.try_divide("found", "relevant")).alias("recall"), zero(F.col("err")).alias("err"), zero(F.try_divide("q", "relevant")).alias("q"),
    )


def _gain() -> Column:
    return (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("i") + 1.0)


def run_summary(metrics: DataFrame) -> DataFrame:
    """Metrics (run_name, query_id, ...) averaged over queries, rounded to 6; best nDCG, then MAP, then name first."""
    rows = metrics.groupBy("run_name").agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("ndcg"), F.desc("map"), "run_name")))


def diagnostics(run: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries, raw hits, ranked rows, and queries with any of either."""
    per = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("h")), "query_id", "left").join(run.groupBy("query_id").agg(F.count("*").alias("r")), "query_id", "left")
    return per.agg(F.count("*").alias("queries"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"), F.coalesce(F.sum("r"), F.lit(0)).alias("ranked"), F.count_if(F.col("h") > 0).alias("with_hits"), F.count_if(F.col("r") > 0).alias("with_ranked"))


# ---- significance ---------------------------------------------------------------------------------------------------


def bootstrap_indices(spark: SparkSession, n_queries: int, n_samples: int = 10_000, seed: int = 42) -> DataFrame:
    """(sample, pos, idx) by Python's generator, one list for all runs, so comparisons are paired. One task draws, a sample
    at a time, as the generator has one sequence; the driver holds none of it."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rng = random.Random(seed)
            for s in range(n_samples if n_queries else 0):
                yield pd.DataFrame({"sample": s, "pos": range(n_queries), "idx": [rng.randrange(n_queries) for _ in range(n_queries)]})

    return spark.range(0, 1, 1, 1).mapInPandas(draw, "sample int, pos int, idx int")


def bootstrap_means(values: DataFrame, indices: DataFrame) -> DataFrame:
    """Values (run_name, metric, idx, value), indices (sample, pos, idx): the mean of each sample."""
    return values.join(F.broadcast(indices) if indices.limit(2_000_001).count() <= 2_000_000 else indices, "idx").groupBy("run_name", "metric", "sample").agg(F.avg("value").alias("mean"))


def summarise(values: DataFrame, means: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one value) and the 95 % interval of the bootstrap means."""
    own = values.groupBy("run_name", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    ci = means.groupBy("run_name", "metric").agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))
    return own.join(ci, ["run_name", "metric"])


def compare(values: DataFrame, means: DataFrame) -> DataFrame:
    """Every pair of runs, by name: difference of means, its interval, and p = min(1, 2 min(P(<= 0), P(>= 0)))."""
    own = values.groupBy("run_name", "metric").agg(F.avg("value").alias("mean"))
    a, b = own.toDF("run_a", "metric", "mean_a"), own.toDF("run_b", "metric", "mean_b")
    delta = a.join(b, "metric").where("run_a < run_b").select("metric", "run_a", "run_b", (F.col("mean_a") - F.col("mean_b")).alias("delta"))
    x, y = means.toDF("run_a", "metric", "sample", "mean_a"), means.toDF("run_b", "metric", "sample", "mean_b")
    diff = x.join(y, ["metric", "sample"]).where("run_a < run_b").withColumn("d", F.col("mean_a") - F.col("mean_b"))
    low, high = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    test = diff.groupBy("metric", "run_a", "run_b").agg(F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_value"))
    return delta.join(test, ["metric", "run_a", "run_b"])


def adjust_bh(tests: DataFrame, *keys: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg within each metric: from the greatest p down, the least of p n / rank so far, at most 1."""
    by = W.partitionBy("metric")
    order = by.orderBy("p_value", *keys)
    ranked = tests.withColumn("__rank", F.row_number().over(order)).withColumn("__n", F.count("*").over(by))
    worse = by.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    out = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("__n") / F.col("__rank")).over(worse)))
    return out.withColumn("significant", F.col("p_adjusted") < alpha).drop("__rank", "__n")


# ---- judgements -----------------------------------------------------------------------------------------------------


def subset_qrels(qrels: DataFrame, queries: DataFrame, datasets: DataFrame) -> DataFrame:
    """Lines of selected queries and datasets."""
    return qrels.join(queries.select("query_id"), "query_id", "left_semi").join(datasets.select("dataset_id"), "dataset_id", "left_semi").select(qrels.columns)


def exclude_qrels(qrels: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that stay and those that go."""
    ids = excluded.select("dataset_id").distinct()
    return qrels.join(ids, "dataset_id", "left_anti").select(qrels.columns), qrels.join(ids, "dataset_id", "left_semi").select(qrels.columns)


def excluded_ids(records: DataFrame) -> DataFrame:
    """P20: processable is false (null isn't) or the status says excluded."""
    gone = F.col("processable").eqNullSafe(False) | F.lower(F.trim("status")).eqNullSafe("excluded")
    return records.where(gone & (F.trim("dataset_id") != "")).select(F.trim("dataset_id").alias("dataset_id")).distinct()


def removed_counts(removed: DataFrame) -> DataFrame:
    """(kind, id, n): the removed lines of each query, and of each dataset."""
    return removed.select(F.explode(F.array(F.struct(F.lit("query").alias("kind"), F.col("query_id").alias("id")), F.struct(F.lit("dataset").alias("kind"), F.col("dataset_id").alias("id")))).alias("r")).groupBy("r.kind", "r.id").agg(F.count("*").alias("n"))


def label_histogram(qrels: DataFrame) -> DataFrame:
    """Lines per query and label."""
    return qrels.groupBy("query_id", "label").agg(F.count("*").alias("n"))


def level(label: Column) -> Column:
    """The number after an L of either case, else null."""
    return F.regexp_extract(F.trim(label), r"^[Ll]\s*([+-]?[0-9]+)$", 1).try_cast("int")


def judgement_metrics(topics: DataFrame, qrels: DataFrame, tabular: DataFrame, min_level: int = 1) -> DataFrame:
    """Distinct judged, tabular and relevant datasets of each topic, with ratios (0 for none)."""
    pairs = qrels.where("dataset_id IS NOT NULL").groupBy("query_id", "dataset_id").agg(F.max("level").alias("level"))  # so that plain counts are distinct ones
    flagged = pairs.join(tabular.select("dataset_id").distinct().withColumn("__tab", F.lit(True)), "dataset_id", "left")
    relevant, tab = F.col("level") >= min_level, F.col("__tab").isNotNull()
    got = flagged.groupBy("query_id").agg(
        F.count("*").alias("judged_total"), F.count_if(tab).alias("judged_tabular"), F.count_if(relevant).alias("rel_l1plus_total"), F.count_if(relevant & tab).alias("rel_l1plus_tabular")
    )
    counts = ("judged_total", "judged_tabular", "rel_l1plus_total", "rel_l1plus_tabular")
    out = topics.join(got, "query_id", "left").select(*topics.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("judged_tabular_ratio", ratio("judged_tabular", "judged_total")).withColumn("rel_tabular_ratio", ratio("rel_l1plus_tabular", "rel_l1plus_total"))


def query_order(metrics: DataFrame) -> DataFrame:
    """The static order of selection as a column ``step``."""
    order = W.orderBy(F.desc("rel_l1plus_tabular"), F.desc("judged_tabular"), F.desc("judged_tabular_ratio"), "query_id")
    return metrics.withColumn("step", F.row_number().over(order))


def selection_trace(ordered: DataFrame, judged: DataFrame, target: int) -> DataFrame:
    """Ordered (query_id, step), judged (query_id, dataset_id, relevant): new and cumulative datasets per step, up to the
    step whose union reaches the target. A dataset is new at the first step that has it."""
    at = judged.join(ordered.select("query_id", "step"), "query_id")
    first = at.groupBy("dataset_id").agg(F.min("step").alias("j"), F.min(F.when(F.col("relevant"), F.col("step"))).alias("r"))
    events = first.select(F.explode(F.array(F.struct(F.col("j").alias("step"), F.lit(True).alias("new")), F.struct(F.col("r").alias("step"), F.lit(False).alias("new")))).alias("e")).where("e.step IS NOT NULL")
    new = events.groupBy("e.step").agg(F.count_if("e.new").alias("marginal_judged"), F.count_if(~F.col("e.new")).alias("marginal_rel"))
    steps = ordered.select("step", "query_id").join(new, "step", "left").na.fill(0, ["marginal_judged", "marginal_rel"])
    w = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    run = steps.withColumn("cumulative_judged", F.sum("marginal_judged").over(w)).withColumn("cumulative_rel", F.sum("marginal_rel").over(w))
    return run.where(F.col("cumulative_judged") - F.col("marginal_judged") < target).select("step", "query_id", "marginal_judged", "cumulative_judged", "marginal_rel", "cumulative_rel") if target > 0 else run.where("step = 1").select("step", "query_id", "marginal_judged", "cumulative_judged", "marginal_rel", "cumulative_rel")
