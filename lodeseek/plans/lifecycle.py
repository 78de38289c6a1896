"""The plans: index offline, search online, replay. Each stage is one DataFrame job; resume is an anti-join with what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import answers
from lodeseek.functions import text as T
from lodeseek.operators import search
from lodeseek.plans import providers
from lodeseek.session import materialise
from lodeseek.sources import records

QUERIES = "struct<queries:array<string>>"
CONFIGS = (("baseline", False, False), ("queryopt", False, True), ("semantic", True, False), ("full", True, True))


def configs(spark, single: str | None = None, every: bool = False) -> DataFrame:
    """A single configuration, else all, else the first."""
    rows = [c for c in CONFIGS if c[0] == single] if single else list(CONFIGS) if every else [CONFIGS[0]]
    if not rows:
        raise ValueError(f"unknown configuration {single!r}")
    return spark.createDataFrame(rows, "config string, use_semantic boolean, use_query_optimization boolean")


def normalise_queries(answer: str = "answer"):
    """Queries of a JSON answer, as objects or strings, trimmed, without blanks."""
    clean = T.strip(F.regexp_replace(F.col(answer), r"^\s*```(?:json)?|```\s*$", ""))
    objects = F.from_json(clean, "struct<queries:array<struct<query:string>>>")["queries"]["query"]
    strings = F.from_json(clean, QUERIES)["queries"]
    plain = F.when(clean.rlike(r'"queries"\s*:\s*\[\s*"'), strings).otherwise(objects)
    return F.filter(F.transform(F.coalesce(plain, F.array().cast("array<string>")), T.strip), lambda x: x.isNotNull() & (x != ""))


def index_offline(records: DataFrame, provider: providers.Provider, dimensions: int, indexed: DataFrame | None = None) -> DataFrame:
    """L1, L2, K8: records (dataset_id, data_profile, processable) -> (doc_id, dataset_id, variant, text, embedding): pseudo-queries
    with and without a semantic profile, each its own row; rows of ``indexed`` are not made again."""
    rows = records.where("processable AND data_profile IS NOT NULL").select("dataset_id", "data_profile")
    described = providers.complete(rows, provider, "semantic_profile", "data_profile", "semantic_profile").drop("semantic_profile_error")
    variants = described.select("dataset_id", F.lit("with_semantic").alias("variant"), F.concat_ws("\n", "data_profile", "semantic_profile").alias("prompt")).union(described.select("dataset_id", F.lit("without_semantic"), "data_profile"))
    asked = providers.complete(variants, provider, "pseudo_queries", "prompt", "answer").where("answer IS NOT NULL")
    docs = asked.select("dataset_id", "variant", F.posexplode(normalise_queries()).alias("n", "text"))
    docs = docs.select(F.concat_ws("::", "dataset_id", "variant", F.concat(F.lit("q"), F.col("n") + 1)).alias("doc_id"), "dataset_id", "variant", "text")
    if indexed is not None:
        docs = docs.join(indexed.select("doc_id"), "doc_id", "left_anti").select("doc_id", "dataset_id", "variant", "text")
    return providers.embed(docs, provider, "text", "embedding", dimensions)


def sub_queries(topics: DataFrame, provider: providers.Provider) -> DataFrame:
    """L4: (query_id, subquery_no, text): the background is broken into sub-queries; none leaves the query itself."""
    told = providers.complete(topics, provider, "background", "text", "background").drop("background_error")
    split = providers.complete(told, provider, "sub_queries", "background", "answer")
    items = T.numbered_list(F.coalesce("answer", F.lit("")))
    return split.select("query_id", F.posexplode(F.when(F.size(items) > 0, items).otherwise(F.array("text"))).alias("subquery_no", "text"))


def search_online(topics: DataFrame, corpus: DataFrame, provider: providers.Provider, dimensions: int, optimise: bool = True, hits_per_query: int = 5, k: int = 10) -> DataFrame:
    """topics (query_id, text), corpus (doc_id, dataset_id, embedding) -> (query_id, dataset_id, rank, score): sub-queries, their
    nearest documents, the least distance per dataset, the provider's ranking of all of these, then the top k; a query without
    a usable answer keeps its vector scores. The provider sees text and profiles of the nearest documents if corpus has them."""
    subs = sub_queries(topics, provider) if optimise else topics.withColumn("subquery_no", F.lit(0))
    asked = providers.embed(subs.select(F.concat_ws("#", "query_id", "subquery_no").alias("query_id"), "text"), provider, "text", "embedding", dimensions)
    near = search.knn_l2(corpus.select(F.col("doc_id").alias("dataset_id"), "embedding"), asked, hits_per_query)
    key = F.split("query_id", "#")
    hits = near.select(key[0].alias("query_id"), key[1].cast("int").alias("subquery_no"), F.col("rank").alias("hit_no"), F.col("dataset_id").alias("doc_id"), "distance").join(corpus.select("doc_id", "dataset_id"), "doc_id")
    best = search.nearest_per_dataset(hits).select("query_id", "dataset_id", "doc_id", F.col("rank").alias("seq"), search.vector_score(F.col("distance")).alias("vector_score"))
    best = materialise(best, "online-candidates")
    seen = [c for c in ("data_profile", "semantic_profile", "text") if c in corpus.columns]
    shown = best.join(corpus.select("doc_id", "dataset_id", *seen).dropDuplicates(["doc_id", "dataset_id"]), ["doc_id", "dataset_id"], "left")
    listed = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "dataset_id", "vector_score", *seen))).alias("candidates"))
    told = topics.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query")).dropDuplicates(["query_id"]).join(listed, "query_id")
    asked = told.select("query_id", F.to_json(F.struct("query", "candidates")).alias("prompt"))
    given = answers.rankings(providers.complete(asked, provider, "rerank", "prompt", "answer"))
    ranked = search.rerank(best.select("query_id", "dataset_id", "vector_score", "seq"), given)
    return ranked.where(F.col("rank") <= max(1, k)).select("query_id", "dataset_id", "rank", F.round("final_score", 6).alias("score"))


def complex_queries(topics: DataFrame, provider: providers.Provider, cache: DataFrame) -> DataFrame:
    """L3: (query_id, text): the cached complex query of each topic, and the provider's for those that the cache lacks; a
    blank answer leaves the topic's own text."""

    def ask(missing: DataFrame) -> DataFrame:
        got = providers.complete(missing, provider, "complex_query", "text", "answer")
        return got.select("query_id", F.coalesce(F.when(T.strip(F.col("answer")) != "", F.col("answer")), F.col("text")).alias("text"))

    return records.read_through(topics.select("query_id", "text"), cache.select("query_id", "text"), "query_id", ask)


def query_sets(topics: DataFrame, provider: providers.Provider, cache: DataFrame) -> DataFrame:
    """(query_set, query_id, text): the topics as they are, and as complex queries."""
    parts = {"original": topics.select("query_id", "text"), "complex": complex_queries(topics, provider, cache)}
    return parts["original"].select(F.lit("original").alias("query_set"), "*").union(parts["complex"].select(F.lit("complex"), "query_id", "text"))


def grid(configurations: DataFrame, sets: DataFrame) -> DataFrame:
    """Every query of every set under every configuration."""
    return sets.crossJoin(F.broadcast(configurations))


def ablation(topics: DataFrame, corpus: DataFrame, provider: providers.Provider, dimensions: int, **limits) -> DataFrame:
    """(config, query_id, dataset_id, rank, score): search under every configuration: with or without the semantic variant of
    the index (corpus has ``variant``), with or without sub-queries."""
    out = None
    for name, semantic, optimise in CONFIGS:
        own = corpus.where(F.col("variant") == ("with_semantic" if semantic else "without_semantic"))
        found = search_online(topics, own, provider, dimensions, optimise, **limits).select(F.lit(name).alias("config"), "*")
        out = found if out is None else out.union(found)
    return out


def described_queries(records_: DataFrame, provider: providers.Provider, task: str = "validation_queries") -> DataFrame:
    """(dataset_id, n, text): the lines that the provider gives for a profile: key points, or queries that validate
    it; list marks go."""
    asked = providers.complete(records_, provider, task, "data_profile", "answer")
    items = T.numbered_list(F.coalesce("answer", F.lit("")))
    return asked.select("dataset_id", F.posexplode(items).alias("n", "text"))


def preflight(spark: SparkSession, files: list[str], collections: dict[str, DataFrame], sets: dict[str, DataFrame]) -> DataFrame:
    """(check, ok, detail): files that a replay needs, collections and query sets that mustn't be empty."""
    rows = [(f"file {p}", records.exists(spark, p), "there" if records.exists(spark, p) else "missing") for p in files]
    for kind, frames in (("collection", collections), ("queries", sets)):
        rows += [(f"{kind} {name}", not df.isEmpty(), f"{df.count()} rows") for name, df in frames.items()]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def replay_views(queries: DataFrame, stored: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query, k, tables) for each k, cut from one hit list."""
    full = replay(queries, stored, max(ks))
    return full.select("query", F.explode(F.array(*map(F.lit, ks))).alias("k"), "tables").select("query", "k", F.slice("tables", F.lit(1), F.col("k")).alias("tables"))


def replay_summary(dimensions: DataFrame, results: DataFrame) -> DataFrame:
    """One row per cell of ``dimensions`` (dataset, variant, k); cells without results have null metrics and say so; a warning
    where a retrieval row is empty."""
    joined = dimensions.join(results, ["dataset", "variant", "k"], "left")
    state = F.when(F.col("n_queries").isNull(), "not_available").when(F.col("n_empty") > 0, "warning").otherwise("ok")
    return joined.withColumn("state", state)


def replay(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """Stored (query, rank, database_id, table_id): the first k of each query as one list; an unknown query has []."""
    first = stored.where(F.col("rank") <= k).groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "database_id", "table_id"))), lambda x: F.struct(x["database_id"].alias("database_id"), x["table_id"].alias("table_id"))).alias("tables"))
    return queries.join(first, "query", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<struct<database_id:string,table_id:string>>")))
