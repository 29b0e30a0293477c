"""Counts over collections, statistics of queries, and the quality of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text


def count_points(points: DataFrame, projects: DataFrame) -> DataFrame:
    """Points of each asked project; an unknown one has 0."""
    n = points.groupBy("project_id").count()
    return projects.join(n, "project_id", "left").select("project_id", F.coalesce("count", F.lit(0)).alias("chunk_count"))


def list_project_ids(points: DataFrame) -> DataFrame:
    """The projects that hold anything, in order."""
    return points.select("project_id").distinct().orderBy("project_id")


def list_projects(points: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """``project_id, chunk_count``; with a registry, its empty projects too."""
    n = points.groupBy("project_id").agg(F.count("*").alias("chunk_count"))
    if registry is None:
        return n
    return registry.join(n, "project_id", "full").select("project_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def get_project(points: DataFrame, requested: DataFrame) -> DataFrame:
    n = list_projects(points)
    return requested.join(n, "project_id", "left").select("project_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("chunk_count").isNotNull().alias("found"))


def stats(points: DataFrame, model: str) -> DataFrame:
    """Totals over all projects."""
    n = list_projects(points)
    return n.agg(F.count("*").alias("total_projects"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks")).withColumn("embed_model", F.lit(model))


def chunk_distribution(points: DataFrame, top: int = 8) -> DataFrame:
    """Each project's files with the most chunks, and their share of the largest."""
    name = F.coalesce(F.nullif("source_file", F.lit("")), F.lit("(unknown)"))
    n = points.groupBy("project_id", name.alias("source_file")).agg(F.count("*").alias("chunks"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("chunks").desc(), "source_file"))
    largest = F.max("chunks").over(Window.partitionBy("project_id"))
    return n.withColumns({"place": place, "share": F.col("chunks") / largest}).where(F.col("place") <= top)


def unique_files(points: DataFrame) -> DataFrame:
    return points.groupBy("project_id").agg(F.count_distinct("source_file").alias("files"))


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], group: list[str], accuracy: int = 10_000) -> DataFrame:
    """For each name the value at place round(share * (n - 1)) of each group in order.

    A sketch bounds each value from both sides; its error is proven, so the value lies
    between. Only the few values between the bounds are put in order, the rows below are counted.
    """
    known = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    slack = 2 / accuracy
    cuts = [x for s in shares.values() for x in (max(0.0, s - slack), min(1.0, s + slack))]
    bounds = known.groupBy(*group).agg(F.struct(F.count("*").alias("n"), F.percentile_approx("__v", cuts, accuracy).alias("b")).alias("__bounds"))
    met = known.join(bounds, group) if group else known.withColumn("__bounds", bounds.scalar())
    n, b, v = F.col("__bounds.n"), F.col("__bounds.b"), F.col("__v")
    few = n <= accuracy  # the error would be less than one place
    asked = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.floor(F.lit(share) * (n - 1) + 0.5).alias("place"), (few | (v <= b[2 * i + 1])).alias("counts"), F.when(few | (v >= b[2 * i]), v).alias("v"))
            for i, (name, share) in enumerate(shares.items())
        )
    )
    hist = met.select(*group, F.explode(F.filter(asked, lambda a: a["counts"])).alias("a")).groupBy(*group, "a.name", "a.place", "a.v").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hist.withColumn("upto", F.sum("n").over(order)).where("v is not null and upto > place")
    return found.groupBy(*group).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def nearest_rank(rows: DataFrame, value: str, share: float, group: list[str], name: str) -> DataFrame:
    """One share of ``nearest_ranks``."""
    return nearest_ranks(rows, value, {name: share}, group)


def latency_summary(metrics: DataFrame, group: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """Count, mean, p50 and p95 of each group; without groups one row over everything, of zeros if there is nothing."""
    group = group or []
    out = metrics.groupBy(*group).agg(F.count("*").alias("count"), F.avg(value).alias("avg_ms"))
    ranks = nearest_ranks(metrics, value, {"p50_ms": 0.5, "p95_ms": 0.95}, group)
    if group:
        return out.join(ranks, group, "left")
    return out.select("count", *(F.coalesce(c, F.lit(0.0)).alias(name) for name, c in (("avg_ms", F.col("avg_ms")), *((x, ranks.select(x).scalar()) for x in ranks.columns))))


def metrics_snapshot(metrics: DataFrame, usage: DataFrame, backend: str, value: str = "latency_ms") -> DataFrame:
    """One row: latencies of all queries, tokens by use, the backend, and the newest query's composition."""
    fields = [c for c in ("hybrid", "reranked", "candidates", "results", "dense_count", "lexical_count", "rerank_moved") if c in metrics.columns]
    last = last_query(metrics, [], fields).select(F.struct(*fields)).scalar()
    tokens = token_usage(usage)
    return latency_summary(metrics, [], value).withColumns({c: tokens.select(c).scalar() for c in tokens.columns} | {"backend": F.lit(backend)} | {f"last_{c}": last[c] for c in fields})


def approx_latency(metrics: DataFrame, group: list[str], value: str = "latency_ms", accuracy: int = 10_000) -> DataFrame:
    """p50 and p95 by a mergeable sketch."""
    p = F.percentile_approx(value, [0.5, 0.95], accuracy)
    return metrics.groupBy(*group).agg(F.count("*").alias("count"), p[0].alias("p50_ms"), p[1].alias("p95_ms"))


def latency_ring(metrics: DataFrame, group: list[str], last: int = 512, value: str = "latency_ms") -> DataFrame:
    """Statistics over each group's newest samples; the count is of all."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("ts").desc(), F.col("id").desc()))
    recent = metrics.withColumn("__n", place).where(F.col("__n") <= last)
    total = metrics.groupBy(*group).agg(F.count("*").alias("total"))
    return latency_summary(recent, group, value).drop("count").join(total, group)


def last_query(metrics: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """The fields of each group's newest query."""
    return metrics.groupBy(*group).agg(F.max_by(F.struct(*fields), F.struct("ts", "id")).alias("q")).select(*group, "q.*")


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens by use, from the usage columns that embedding and reranking return."""
    s = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("tokens"))), F.lit(0))
    return usage.agg(s("embed").alias("embed_tokens"), s("rerank").alias("rerank_tokens"), (s("embed") + s("rerank")).alias("total_tokens"))


def retrieval_breakdown(composition: DataFrame) -> DataFrame:
    """Shares of dense and lexical candidates; of none, 0."""
    n = F.col("dense_count") + F.col("lexical_count")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    return composition.select("query_id", share("dense_count").alias("dense_share"), share("lexical_count").alias("lexical_share"))


def prune_log(log: DataFrame, keep: int) -> DataFrame:
    """The newest rows by id: those above the greatest id less ``keep``."""
    return log.where(F.col("id") > log.agg(F.max("id")).scalar() - keep)


#: Types of the query log's columns.
LOG_FIELDS = {
    "id": "bigint", "ts": "timestamp", "project_id": "string", "query": "string", "results": "int", "top_score": "double",
    "top_doc_id": "string", "reranked": "boolean", "latency_ms": "double",
}


def logged(log: DataFrame) -> DataFrame:
    """Without synthetic queries; they count in the metrics only."""
    return log.where(~F.coalesce("no_log", F.lit(False)))


def recent_queries(log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; the limit lies between 1 and 1000."""
    return log.orderBy(F.col("id").desc()).limit(min(limit if limit > 0 else 50, 1000))


def recent_report(spark: SparkSession, log: DataFrame | None, limit: int = 50, fields: tuple[str, ...] = ("id", "query", "results")) -> DataFrame:
    """One row ``enabled, queries``: a log that is off (None) is told from one that is empty.

    ``queries`` has ``fields`` either way; where there is no log they have the types of the log's schema.
    """
    if log is None:
        kinds = ",".join(f"{f}:{LOG_FIELDS.get(f, 'string')}" for f in fields)
        return spark.range(1).select(F.lit(False).alias("enabled"), F.lit(None).cast(f"array<struct<{kinds}>>").alias("queries"))
    newest = recent_queries(log, limit).select(F.struct(*fields).alias("q"))
    return newest.agg(F.lit(True).alias("enabled"), F.sort_array(F.collect_list("q"), asc=False).alias("queries"))


def zero_result_queries(log: DataFrame, low: float = 0.0) -> DataFrame:
    return log.where((F.col("results") == 0) | (F.col("top_score") < low))


def coverage(results: DataFrame) -> DataFrame:
    """For each query: slots, distinct documents, and the share of text from repeat documents."""
    root = text.doc_root(F.col("doc_id"))
    again = F.row_number().over(Window.partitionBy("query_id", "root").orderBy("rank")) > 1
    rows = results.withColumn("root", root).withColumn("again", again)
    size = F.char_length("content")
    return rows.groupBy("query_id").agg(
        F.count("*").alias("slots"), F.count_distinct("root").alias("documents"), (F.sum(F.when(F.col("again"), size).otherwise(0)) / F.greatest(F.sum(size), F.lit(1))).alias("repeat_text_share")
    )


def hit_at_k(results: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of labelled questions with an acceptable document among the first k."""
    good = results.join(labels.select("query_id", F.col("acceptable_doc_id").alias("doc_id")), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    asked = labels.select("query_id").distinct().join(good, "query_id", "left")
    hit = lambda k: F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)))
    return asked.agg(F.count("*").alias("questions"), *(hit(k).alias(f"hit_at_{k}") for k in ks))


def recall_sweep(candidates: DataFrame, labels: DataFrame, recalls: tuple[int, ...] = (12, 25, 40, 60)) -> DataFrame:
    """Share of questions whose acceptable document is among the first candidates, for several recalls.

    One retrieval at the largest recall serves all."""
    good = candidates.join(labels.select("query_id", F.col("acceptable_doc_id").alias("doc_id")), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    asked = labels.select("query_id").distinct().join(good, "query_id", "left")
    asked = asked.select("best", F.explode(F.array(*map(F.lit, recalls))).alias("recall"))
    return asked.groupBy("recall").agg(F.avg(F.coalesce((F.col("best") <= F.col("recall")).cast("double"), F.lit(0.0))).alias("hit"))


def activity_by_type(events: DataFrame, kind: str = "type") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("events"))


def progress(done: DataFrame, run: str = "run_id", order: str = "batch") -> DataFrame:
    """Rows ``run, batch, done, total`` at which a run's whole percent changes."""
    pct = F.floor(F.col("done") * 100 / F.greatest(F.col("total"), F.lit(1))).cast("int")
    before = F.lag("pct").over(Window.partitionBy(run).orderBy(order))
    return done.withColumn("pct", pct).withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("pct"))).drop("__b")


