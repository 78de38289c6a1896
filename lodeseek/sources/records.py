"""Records, caches and reports that outlive a run: read with defined rules, written once per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_records(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A checkpoint; a missing one is empty unless it is required."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def save_records(records: DataFrame, path: str) -> None:
    """K4: the whole stage at once, not record by record."""
    records.write.mode("overwrite").parquet(path)


def append_errors(errors: DataFrame, path: str) -> None:
    """K5."""
    errors.write.mode("append").json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """K6: ids as text, sorted."""
    rows.select(column).distinct().orderBy(column).coalesce(1).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str, digits: int = 6) -> None:
    """K7: CSV with numbers rounded."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*rounded).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """K6, K7: a record a line, in one file; letters beyond ASCII stay as they are."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def selection_record(trace: DataFrame, method: str, target: int) -> DataFrame:
    """One record: the method, the target, the size reached and the query ids in order of selection."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("step", "query_id"))), lambda x: x["query_id"])
    return trace.agg(F.lit(method).alias("method"), F.lit(target).alias("target"), F.coalesce(F.max("cumulative_judged"), F.lit(0)).alias("achieved"), ids.alias("query_ids"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank."""
    return spark.read.text(path).agg(F.count_if(strip(F.col("value")) != "").alias("n"))


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed, without blanks, once each."""
    return spark.read.text(path).select(strip(F.col("value")).alias("dataset_id")).where("dataset_id <> ''").distinct()


def load_catalog(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last entry of each id."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")


def require_complete(expected: DataFrame, cache: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Cached texts of all expected ids; missing or blank ones are listed in one error."""
    got = expected.select(key).join(cache.select(key, text), key, "left")
    missing = [r[0] for r in got.where(F.coalesce(strip(F.col(text)), F.lit("")) == "").select(key).orderBy(key).collect()]
    if missing:
        raise ValueError(f"no cached text for {len(missing)}: {', '.join(map(str, missing))}")
    return got


def read_through(keys: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached rows, and ``compute`` of the keys that the cache lacks."""
    fresh = compute(keys.join(cache.select(key), key, "left_anti"))
    return cache.join(keys.select(key).distinct(), key, "left_semi").unionByName(fresh)


def resolve_file(records: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """The stored path if there is such a file, else root and dataset_name, else null."""
    have = files.select("path").distinct()
    stored = have.select(F.col("path").alias("file_path"), F.lit(True).alias("__a"))
    named = have.select(F.col("path").alias("__named"), F.lit(True).alias("__b"))
    r = records.withColumn("__named", F.concat(F.lit(root.rstrip("/") + "/"), "dataset_name")).join(stored, "file_path", "left").join(named, "__named", "left")
    return r.withColumn("resolved", F.when(F.col("__a"), F.col("file_path")).when(F.col("__b"), F.col("__named"))).drop("__named", "__a", "__b")


def open_collection(spark: SparkSession, path: str, variant: str, allow_empty: bool = False) -> DataFrame:
    """Rows of one variant of an index; a missing one names those there are, an empty one is an error by default."""
    index = spark.read.parquet(path)
    variants = sorted(r[0] for r in index.select("variant").distinct().collect())
    if variant not in variants and not (allow_empty and not variants):
        raise ValueError(f"no variant {variant!r}; there are: {', '.join(variants) or 'none'}")
    return index.where(F.col("variant") == variant)


def page_of_ids(collection: DataFrame, after: str = "", size: int = 1000, key: str = "doc_id") -> DataFrame:
    """The next ids behind ``after``, in order; a page is found by its key, not by an offset."""
    return collection.select(key).where(F.col(key) > after).distinct().orderBy(key).limit(size)


def empty_retrievals_of(spark: SparkSession, path: str, schema: str, column: str = "tables") -> int:
    """``empty_retrievals`` of a file of records; -1 where it is missing."""
    return empty_retrievals(spark.read.schema(schema).json(path), column).first()[0] if exists(spark, path) else -1


def empty_retrievals(results: DataFrame, column: str = "tables") -> DataFrame:
    """Rows whose list is empty or null."""
    return results.agg(F.count_if(F.coalesce(F.size(column), F.lit(0)) <= 0).alias("n_empty"))


def markdown(rows: DataFrame, most: int = 10_000) -> str:
    """A small table as markdown; bars and newlines in cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")
    lines = ["| " + " | ".join(map(cell, rows.columns)) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect()])
