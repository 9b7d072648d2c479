"""Hybrid search: full-text and vector candidates, fused, filtered, hydrated and reranked."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fts as fts_ops
from . import fusion, text_index, vector

log = logging.getLogger(__name__)
Reranker = Callable[[str, list[str]], list[float]]


def hydrate(ranked: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Joins a bounded ranked list (doc_id, score) to its texts; ids without a document drop out."""
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    columns.append(F.col("metadata") if "metadata" in docs.columns else F.lit("{}").alias("metadata"))
    columns.append(F.col("chunk_of").alias("chunk_id") if "chunk_of" in docs.columns else F.lit(None).cast("long").alias("chunk_id"))
    return docs.select(*columns).join(F.broadcast(ranked), "doc_id").select("doc_id", "score", "text", "metadata", "chunk_id")


def taken(ranked: DataFrame, limit: int) -> DataFrame:
    """A list of at most `limit` rows as a table that needs no further scan."""
    return ranked.sparkSession.createDataFrame(ranked.limit(limit).collect(), ranked.schema)


def with_rank(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def rerank(rows: DataFrame, query: str, reranker: Reranker, limit: int) -> DataFrame:
    """Scores the texts of a bounded pool with a function of the whole list; its failure leaves the order as it is.

    A score that is not finite ranks last. Ties keep the order of the pool.
    """
    pool = rows.orderBy(F.desc("score"), "doc_id").collect()
    try:
        scores = [float(s) for s in reranker(query, [r.text for r in pool])]
        if len(scores) != len(pool):
            raise ValueError(f"{len(scores)} scores for {len(pool)} texts")
    except Exception:
        log.warning("reranker failed; fused order is kept", exc_info=True)
        return rows.orderBy(F.desc("score"), "doc_id").limit(limit)
    scores = [s if math.isfinite(s) else -math.inf for s in scores]
    order = sorted(range(len(pool)), key=lambda i: -scores[i])[:limit]
    spark = rows.sparkSession
    return spark.createDataFrame([(*pool[i][:1], scores[i], *pool[i][2:]) for i in order], rows.schema)


def hybrid_search(
    docs: DataFrame,
    vecs: DataFrame,
    query: str,
    query_vector: list[float] | None,
    limit: int = 10,
    alpha: float | None = None,
    fts_limit: int = 50,
    vec_limit: int = 50,
    min_score: float = 0.0,
    reranker: Reranker | None = None,
    rerank_top_n: int | None = None,
    strategy: str | vector.Strategy | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    terms: str | None = None,
    lemma: T.Lemma | None = None,
    index: str | None = None,
) -> DataFrame:
    """(doc_id, score, text, metadata, chunk_id) of the best, hydrated.

    Without a query vector it is full-text search with raw scores and no reranking. Else both candidate lists, of
    `fts_limit` and `vec_limit` ids and scores at most, are taken to the driver, since fusion looks at each several
    times and would scan the corpus as often. Fusion works on ids; texts are joined to the bounded pool only. The query is cut into words and lemmatised by `lemma`, as the column
    `terms` is that it is looked up in (the text itself, if not named). With `index`, the place of a stored
    index of that column, no text is scanned.
    """
    words = T.lemmatize_query(query, lemma)
    count = fts_limit if query_vector is not None else limit
    found = fts_ops.search(docs, words, count, terms or text, doc_id) if index is None else text_index.search(docs.sparkSession, index, words, count)
    if limit < 1:
        return hydrate(found.where("false"), docs, text, doc_id)
    if query_vector is None:
        return hydrate(found, docs, text, doc_id)
    near = vector.relevance(vector.strategy(strategy)(vecs, query_vector, vec_limit))
    fused = fusion.fuse(taken(found, fts_limit), taken(near, vec_limit), query, alpha).where(F.col("score") >= min_score)
    pool = (rerank_top_n or limit * 5) if reranker else limit
    rows = hydrate(fused.orderBy(F.desc("score"), "doc_id").limit(pool), docs, text, doc_id)
    return rerank(rows, query, reranker, limit) if reranker else rows


def federated_search(docs: DataFrame, query: str, database: str, limit: int = 10, text: str = "text", doc_id: str = "doc_id", lemma: T.Lemma | None = None) -> DataFrame:
    """(database, doc_id, score): full-text search in every database on its own, the best of all merged.

    Databases are the values of a column: statistics are grouped by it, each database keeps its top `limit`,
    and these are merged by score. One plan serves any number of databases. The query is lemmatised as in
    hybrid_search().
    """
    phrases = T.match_phrases(T.sanitize_query(T.lemmatize_query(query, lemma)))
    base = docs.select(F.col(database).alias("database"), F.col(doc_id).alias("doc_id"), T.index_terms(F.col(text)).alias("terms"))
    tf = [f"tf_{i}" for i in range(len(phrases))]
    base = base.select("database", "doc_id", F.size("terms").alias("dl"), *[fts_ops._occurrences(F.col("terms"), p).alias(c) for p, c in zip(phrases, tf)])
    if not phrases:
        return base.where("false").select("database", "doc_id", F.lit(0.0).alias("score"))
    stats = base.groupBy("database").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf])
    hits = base.where(" and ".join(f"{c} > 0" for c in tf)).join(stats, "database")
    best = Window.partitionBy("database").orderBy(F.desc("score"), "doc_id")
    hits = hits.select("database", "doc_id", fts_ops.bm25(tf).alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit).drop("nth")
    return hits.orderBy(F.desc("score"), "database", "doc_id").limit(limit)
