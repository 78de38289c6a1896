"""Topics, judgements and runs as text: readers and writers. Lines carry their number, as files have an order and rows none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import strip


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of the text files of a path, in order of file, block and line."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    return raw


def parse_topics(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """Rows (seq, line): id and text at the first tab; blank ones go and the last of equal ids counts, unless ``keep_all``."""
    parts = F.split("line", "\t", 2)
    t = rows.where(F.size(parts) >= 2).select("seq", strip(parts[0]).alias("query_id"), strip(F.get(parts, F.lit(1))).alias("text"))
    if keep_all:
        return t.where("query_id <> ''")
    t = t.where("query_id <> '' AND text <> ''")
    return t.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("seq")))).where("__n = 1").select("query_id", "text")


def _fields(rows: DataFrame, least: int) -> DataFrame:
    return rows.select("seq", F.split(strip(F.col("line")), r"\s+").alias("p")).where(F.size("p") >= least)


def parse_qrels(rows: DataFrame) -> DataFrame:
    """(query_id, dataset_id, rel). Four fields are read if the third begins with L or the fourth is a number or begins
    with L, so ``q d L2 more`` reads L2 as the document; labels Ln and n are n, others 0; the last of equal ones counts."""
    p = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    four = (F.size("p") >= 4) & (p(2).startswith("L") | p(3).rlike("^[0-9]+$") | p(3).startswith("L"))
    label = F.when(four, p(3)).otherwise(p(2))
    rel = F.coalesce(F.regexp_extract(label, "^L?([0-9]+)$", 1).try_cast("int"), F.lit(0))
    q = _fields(rows, 3).select("seq", p(0).alias("query_id"), F.when(four, p(2)).otherwise(p(1)).alias("dataset_id"), rel.alias("rel"))
    return q.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "dataset_id").orderBy(F.desc("seq")))).where("__n = 1").select("query_id", "dataset_id", "rel")


def parse_selection_qrels(rows: DataFrame) -> DataFrame:
    """The first three fields, whatever follows; ``level`` is the number of Ln of either case, else null."""
    q = _fields(rows, 3).select("seq", F.col("p")[0].alias("query_id"), F.col("p")[1].alias("dataset_id"), F.col("p")[2].alias("label"))
    return q.withColumn("level", F.regexp_extract("label", "^[Ll]([+-]?[0-9]+)$", 1).try_cast("int"))


def parse_run(rows: DataFrame) -> DataFrame:
    """(query_id, dataset_id, rank, score, seq); a bad rank is 999999, a bad score 0."""
    p = F.col("p")
    number = F.when(~F.isnan(p[4].try_cast("double")), p[4].try_cast("double"))
    return _fields(rows, 6).select(p[0].alias("query_id"), p[2].alias("dataset_id"), F.coalesce(p[3].try_cast("int"), F.lit(999999)).alias("rank"), F.coalesce(number, F.lit(0.0)).alias("score"), "seq")


def six_digits(number: Column) -> Column:
    """%.6f as C and Python write it: the exact binary value is rounded, ties to even. Java's formatter rounds the shortest
    decimal up instead. From 2^33 on the shortest decimal can miss the exact digits, so the fraction is written apart;
    beyond 2^63 they are those of the shortest decimal."""
    x, size = number.cast("double"), F.abs(number.cast("double"))
    whole = x.cast("long")
    apart = F.concat(whole.cast("string"), F.call_function("format_number", F.abs(x - whole), F.lit(".000000")))
    return (
        F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(size < 2.0**33, F.call_function("format_number", x, F.lit("0.000000"))).when(size < 2.0**63, apart).otherwise(F.format_string("%.6f", x))
    )


def run_lines(ranked: DataFrame, run_id: str, corpus: DataFrame | None = None, compact: bool = True, k: int | None = None) -> DataFrame:
    """K1-K3: (query_id, rank, line). Blank ids go, and those that ``corpus`` lacks; then ranks are compacted, or kept, and cut to k."""
    rows = ranked.where(strip(F.col("dataset_id")) != "")
    if corpus is not None:
        rows = rows.join(corpus.select("dataset_id"), "dataset_id", "left_semi")
    if compact:
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    if k is not None:
        rows = rows.where(F.col("rank") <= max(1, k))
    return rows.select("query_id", "rank", F.format_string("%s Q0 %s %d %s %s", "query_id", "dataset_id", "rank", six_digits(F.col("score")), F.lit(run_id)).alias("line"))


def dropped_ids(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """K2: per query how many ranked ids the corpus lacks; queries without any have 0. ``ranked`` is read
    twice, so that only its own ids of the corpus are made distinct."""
    held = corpus.select("dataset_id").join(ranked.select("dataset_id").distinct(), "dataset_id", "left_semi").distinct()
    lacks = ranked.join(held.withColumn("__in", F.lit(True)), "dataset_id", "left")
    return lacks.groupBy("query_id").agg(F.count_if(F.col("__in").isNull()).alias("n_dropped"))


def write_run(lines_: DataFrame, path: str) -> None:
    """One text file in order of query and rank; a run is small."""
    lines_.orderBy("query_id", "rank").select("line").coalesce(1).write.mode("overwrite").text(path)
