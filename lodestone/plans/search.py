"""The whole search: candidates, reranking, cap, cut, compression, and what is logged about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators import search as op
from lodestone.sources import store


def _finish(found: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, reranker: Column | None, max_per_doc: int, compress: bool) -> DataFrame:
    about = queries.select("query_id", "project_id", *(["query"] if "query" in queries.columns else []))
    found = found.join(op.small(about), "query_id").join(chunks.select("project_id", "id", "doc_id", "content", "content_hash"), ["project_id", "id"])
    found = found.withColumns({"cand_pos": F.col("rank") - 1, "reranked": F.lit(False)})
    if reranker is not None:
        found = op.rerank(found, reranker)
    found = op.truncate_k(op.cap_per_doc(found, max_per_doc), k)
    if compress:
        found = op.compress(found)
    return found.select("query_id", "rank", "id", "doc_id", "content", "content_hash", "score", "in_dense", "in_lexical", "cand_pos", "reranked")


def search(
    queries: DataFrame, chunks: DataFrame, k: int = op.DEFAULT_K, recall: int = op.DEFAULT_RECALL, hybrid: bool = False, reranker: Column | None = None, max_per_doc: int = 0, compress: bool = False
) -> DataFrame:
    """Results of every query: ``query_id, rank, id, doc_id, content, content_hash, score, in_dense, in_lexical, cand_pos, reranked``.

    ``reranker`` is a score over ``query`` and ``content``, or an ``op.scorer`` of them. All candidates
    are scored, so a cap on chunks of one document can fill up from below.
    """
    return _finish(op.retrieve_candidates(queries, chunks, max(recall, k), hybrid), queries, chunks, k, reranker, max_per_doc, compress)


def retrieve_context(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """``query_id, context``."""
    return op.context_string(search(queries, chunks, **options))


def log_rows(queries: DataFrame, results: DataFrame, latency_ms: Column | None = None, candidates: DataFrame | None = None, hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
    """(metric rows of all queries, log rows of those that are not synthetic; a null ``no_log`` is false).

    With the candidates, metric rows hold the whole composition: ``hybrid, candidates,
    dense_count, lexical_count, hybrid_fallback`` beside ``results, reranked, rerank_moved``.
    """
    top = results.groupBy("query_id").agg(F.count("*").alias("results"), F.max("reranked").alias("reranked"), F.min_by(F.struct("score", "doc_id"), "rank").alias("top"), F.count_if(F.col("reranked") & (F.col("cand_pos") != F.col("rank") - 1)).alias("rerank_moved"))
    rows = queries.join(top, "query_id", "left").withColumn("latency_ms", F.lit(0.0) if latency_ms is None else latency_ms)
    rows = rows.withColumns({"results": F.coalesce("results", F.lit(0)), "reranked": F.coalesce("reranked", F.lit(False)), "rerank_moved": F.coalesce("rerank_moved", F.lit(0))})
    metric = rows.select("query_id", "latency_ms", "results", "reranked", "rerank_moved")
    if candidates is not None:
        made = op.query_composition(candidates, results, hybrid).drop("results")
        metric = metric.join(made, "query_id", "left").withColumn("hybrid", F.lit(hybrid))
        metric = metric.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("candidates", "dense_count", "lexical_count")} | {"hybrid_fallback": F.coalesce("hybrid_fallback", F.lit(hybrid))})
    logged = metrics.logged(rows).select("query_id", "project_id", "query", "results", F.coalesce("top.score", F.lit(0.0)).alias("top_score"), F.coalesce("top.doc_id", F.lit("")).alias("top_doc_id"), "reranked", "latency_ms")
    return metric, logged


def search_with_log(
    queries: DataFrame, chunks: DataFrame, k: int = op.DEFAULT_K, recall: int = op.DEFAULT_RECALL, hybrid: bool = False, reranker: Column | None = None, max_per_doc: int = 0, compress: bool = False, latency_ms: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, metric rows, log rows) of one retrieval, which is written to the shared folder and goes with the driver's JVM."""
    found = store.kept(op.retrieve_candidates(queries, chunks, max(recall, k), hybrid), "retrieval")
    results = _finish(found, queries, chunks, k, reranker, max_per_doc, compress)
    return results, *log_rows(queries, results, latency_ms, found, hybrid)
