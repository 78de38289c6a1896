"""Catalogs, manifests and records: filters over nested resources, upserts, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions import text as T


def _format(r: Column) -> Column:
    return T.resource_format(r["data_format"], r["data_filename"], r["data_url"])


def filter_formats(catalog: DataFrame, formats: list[str]) -> DataFrame:
    """P5: catalog (id, data array of data_url, data_format, data_filename): resources of the formats; no dataset without one."""
    return catalog.withColumn("data", F.filter("data", lambda r: F.coalesce(_format(r).isin(formats), F.lit(False)))).where(F.size("data") > 0)


def pick_resources(catalog: DataFrame, policy: str = "one", cap: int = 1) -> DataFrame:
    """All resources, the one of the best format (the first of equal ones), or the first ``cap``."""
    if policy == "all":
        return catalog
    if policy == "cap":
        return catalog.withColumn("data", F.slice("data", 1, max(1, cap)))
    if policy != "one":
        raise ValueError(f"unknown policy {policy!r}")
    rank = lambda r: F.coalesce(F.array_position(F.array(*map(F.lit, T.PRIORITY)), _format(r)), F.lit(0))
    keyed = F.transform("data", lambda r, i: F.struct(F.when(rank(r) > 0, rank(r)).otherwise(len(T.PRIORITY) + 1).alias("p"), i.alias("i"), r.alias("r")))
    return catalog.withColumn("__k", F.transform(keyed, lambda x: F.struct(x["p"], x["i"]))).withColumn("data", F.slice("data", F.array_min("__k")["i"] + 1, F.lit(1))).drop("__k")


def build_subset(selected: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog entries of the selected ids (the last of equal ones by seq), and the ids that the catalog lacks."""
    last = catalog.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq")))).where("__n = 1").drop("__n")
    ids = selected.select(F.col("dataset_id").alias("id")).distinct()
    return last.join(ids, "id", "left_semi"), ids.join(last, "id", "left_anti")


def subset_report(resources: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Resources (format, domain): counts by format, and the most frequent domains (ties by name)."""
    return resources.groupBy("format").agg(F.count("*").alias("n")), resources.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(top)


def latest(rows: DataFrame, *key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")


def pending(tasks: DataFrame, manifest: DataFrame, *key: str, done: str = "downloaded") -> DataFrame:
    """Tasks without a row of the manifest that says so."""
    return tasks.join(manifest.where(F.col("status") == done).select(*key).distinct(), list(key), "left_anti")


OVERWRITTEN = ("domain", "dataset_name", "file_format", "file_path", "file_size_bytes")


def upsert(existing: DataFrame, discovered: DataFrame, key: str = "dataset_id", fields: tuple[str, ...] = OVERWRITTEN) -> DataFrame:
    """Discovered rows overwrite ``fields`` of existing ones and keep the rest; new ones come in; vanished ones stay."""
    d = discovered.select(key, F.lit(True).alias("__d"), *(F.col(f).alias(f"__{f}") for f in fields))
    both = existing.withColumn("__e", F.lit(True)).join(d, key, "full")
    keep = [F.when(F.col("__d"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns]
    return both.select(*keep, F.when(F.col("__e").isNull(), "new").when(F.col("__d").isNull(), "vanished").otherwise("updated").alias("change"))


def normalise_states(records: DataFrame) -> DataFrame:
    """Null ``processable`` with a profile is true; status excluded makes it false; false without a reason gets the error or a word."""
    ok = F.when(F.col("status").eqNullSafe("excluded"), False).when(F.col("processable").isNull() & (F.coalesce(F.trim("data_profile"), F.lit("")) != ""), True).otherwise(F.col("processable"))
    reason = F.when(ok.eqNullSafe(False) & (F.coalesce(F.trim("exclusion_reason"), F.lit("")) == ""), F.coalesce(F.when(F.trim("error_message") != "", F.col("error_message")), F.lit("unprocessable"))).otherwise(F.col("exclusion_reason"))
    return records.withColumns({"processable": ok, "exclusion_reason": reason})


def state_report(records: DataFrame) -> DataFrame:
    """Records by state."""
    return records.agg(
        F.count("*").alias("total"), F.count_if("processable").alias("processable"), F.count_if(~F.col("processable")).alias("excluded"), F.count_if(F.col("processable").isNull()).alias("pending"),
        F.count_if(F.coalesce(F.trim("data_profile"), F.lit("")) != "").alias("profiled"), F.count_if(F.coalesce(F.trim("semantic_profile"), F.lit("")) != "").alias("described"), F.count_if(F.col("status").eqNullSafe("error")).alias("errors"),
    )


def infer_ids(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """(domain, dataset_id, dataset_name) of relative paths; a path of one part gets a generated id."""
    parts = F.split(path, "/")
    deep = F.size(parts) >= 2
    return files.select("*", F.when(deep, parts[0]).otherwise("").alias("domain"), F.when(deep, F.get(parts, F.lit(1))).otherwise(F.concat(F.lit("generated-"), T.digest(F.col(path)))).alias("dataset_id"), F.col(path).alias("dataset_name"))


def share_by_query(qrels: DataFrame, formats: DataFrame, wanted: str = "csv") -> DataFrame:
    """Per query the percentage of judged datasets of one format."""
    return qrels.join(formats, "dataset_id", "left").groupBy("query_id").agg((100.0 * F.avg(F.col("format").eqNullSafe(wanted).cast("double"))).alias("share"))


def latency(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, least and greatest value per key."""
    return runs.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def check_hits(runs: DataFrame, hits: DataFrame, key: str = "run_name") -> DataFrame:
    """The raw hits that each run reports against those counted: (key, reported, counted, agrees)."""
    counted = hits.groupBy(key).agg(F.count("*").alias("counted"))
    both = runs.groupBy(key).agg(F.sum("n_hits").alias("reported")).join(counted, key, "full")
    return both.select(key, F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("counted", F.lit(0)).alias("counted")).withColumn("agrees", F.col("reported") == F.col("counted"))


def join_by_name(catalog: DataFrame, hits: DataFrame, path: str = "path", url: str = "url") -> DataFrame:
    """Hits whose path ends in the name that an entry's URL ends in, without extensions; either separator counts."""
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\\\?#]+)[/\\\\]?(?:[?#].*)?$", 1), r"\.[^.]*$", ""))
    return hits.withColumn("__name", stem(F.col(path))).where("__name <> ''").join(catalog.withColumn("__name", stem(F.col(url))), "__name").drop("__name")


def backoff_seconds(attempt: Column) -> Column:
    """The wait before the next attempt n: min(30, 0.5 * 2^(n-1)) * (1 + 0.1 * (n mod 3))."""
    return F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), attempt - 1)) * (1 + 0.1 * (attempt % 3))
