"""Profiles of tables: counts, numbers, distinct and top values, as long DataFrames with a row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import number


def numeric(col: Column, dtype: str) -> Column | None:
    """A2: the number that a cell counts as; None for dates and nested values."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if dtype == "boolean":
        return col.cast("int").cast("double")
    return number(col) if dtype == "string" else None


def global_stats(df: DataFrame) -> DataFrame:
    """A1-A4: (column, rows_total, non_null, nulls, missing_pct, numeric_count, sum, sumsq, min, max, mean, std).

    One pass over the table with partial aggregation; the deviation is that of the population, from sums, clamped at 0.
    """
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(df.columns):
        cell = F.col(f"`{c}`")
        n = numeric(cell, kinds[c])
        n = F.lit(None).cast("double") if n is None else n
        aggs.append(F.struct(F.count(cell).alias("non_null"), F.count(n).alias("numeric_count"), F.sum(n).alias("sum"), F.sum(n * n).alias("sumsq"), F.min(n).alias("min"), F.max(n).alias("max")).alias(f"__{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("s")) for i, c in enumerate(df.columns)))
    long = wide.select("__rows", F.explode(rows).alias("r")).select("r.column", F.col("__rows").alias("rows_total"), "r.s.*")
    mean = F.try_divide("sum", "numeric_count")
    spread = F.try_divide("sumsq", "numeric_count") - mean * mean
    return long.select(
        "column", "rows_total", "non_null", (F.col("rows_total") - F.col("non_null")).alias("nulls"),
        F.coalesce(F.try_divide(100.0 * (F.col("rows_total") - F.col("non_null")), F.col("rows_total")), F.lit(0.0)).alias("missing_pct"),
        "numeric_count", "sum", "sumsq", "min", "max", mean.alias("mean"), F.when(spread.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), spread))).alias("std"),
    )


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the non-null cells as text."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("c")).select("c.*").where("value IS NOT NULL")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: (column, n_distinct), exact, in one shuffle for all columns."""
    return melt(df, columns).groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


def top_values(df: DataFrame, columns: list[str], k: int = 3, only_if_counts_differ: bool = False) -> DataFrame:
    """(column, value, n, rank): most frequent values, ties by value. The variant leaves out columns whose values all
    have one count."""
    n = melt(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    if only_if_counts_differ:
        differ = n.groupBy("column").agg((F.min("n") != F.max("n")).alias("d")).where("d").select("column")
        n = n.join(F.broadcast(differ), "column", "left_semi")
    return n.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, first, last) of date columns."""
    aggs = [F.struct(F.lit(c).alias("column"), F.min(f"`{c}`").cast("timestamp").alias("first"), F.max(f"`{c}`").cast("timestamp").alias("last")).alias(f"__{i}") for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*(F.col(f"__{i}") for i in range(len(columns))))).alias("c")).select("c.*")


def coverage(ranges: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """The envelope of ranges per key; it always holds 0."""
    return ranges.groupBy(key).agg(F.least(F.lit(0.0), F.min(low)).alias("low"), F.greatest(F.lit(0.0), F.max(high)).alias("high"))


def column_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """L10, by rules of our own: (column, kind): integer, real, boolean, datetime or text, by the non-null cells; empty for none."""
    m = melt(df, columns)
    n = number(F.col("value"))
    whole = n.isNotNull() & F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$")
    share = m.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(whole).alias("i"), F.count(n).alias("r"), F.count_if(F.lower("value").isin("true", "false")).alias("b"), F.count_if(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")).alias("d")
    )
    kind = F.when(F.col("i") == F.col("n"), "integer").when(F.col("r") == F.col("n"), "real").when(F.col("b") == F.col("n"), "boolean").when(F.col("d") == F.col("n"), "datetime").otherwise("text")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(share.select("column", kind.alias("kind")), "column", "left").select("column", F.coalesce("kind", F.lit("empty")).alias("kind"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the same for the same seed: those with the least hash of key and seed."""
    return df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("__h", key).limit(n).drop("__h")


def preview(df: DataFrame, max_rows: int = 20, max_cols: int = 20) -> DataFrame:
    """The first rows and columns."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns[:max_cols])).limit(max_rows)


def profile_text(stats: DataFrame, tops: DataFrame, key: str = "column") -> DataFrame:
    """The profile as one text per table: a line per column. Numbers are rendered last."""
    best = tops.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("top"))
    number_ = F.when(F.col("numeric_count") > 0, F.format_string(" mean %.6g, min %.6g, max %.6g;", "mean", "min", "max")).otherwise("")
    line = F.concat(F.col(key), F.lit(":"), number_, F.format_string(" missing %.2f%%", "missing_pct"), F.coalesce(F.concat(F.lit("; top: "), "top"), F.lit("")))
    return stats.join(best, key, "left").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key), line.alias("line")))), lambda x: x["line"]), "\n").alias("profile"))
