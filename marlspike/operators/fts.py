"""BM25 full-text ranking over columns of terms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
TASK_CHARS = 1 << 24


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, positions): the inverted index of a corpus.

    Texts are shuffled once, by id, before they are cut: rows of one document lie in one task from then on, so neither
    this grouping nor one by document after it sends occurrences about. A task has TASK_CHARS characters or so.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chars = own.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(1, math.ceil(chars / TASK_CHARS), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / (1 << 20))))
    own = own.repartition(parts, "doc_id")
    terms = own.select("doc_id", F.posexplode(T.index_terms(F.col("text"))).alias("pos", "term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, with the index's floor where it is not positive."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def term_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, df, idf) of every term of the index; document counts combine before the shuffle."""
    terms = docs.select(F.explode(F.array_distinct(T.index_terms(F.col(text)))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def _occurrences(terms: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(terms, lambda x: x == phrase[0]))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(terms), F.lit(1))), lambda i: F.slice(terms, i, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.size(at)


def bm25(tf: list[str]) -> Column:
    """The score from the columns `tf`, dl, n, avgdl and df_ before each name of tf."""
    part = [idf(F.col("n"), F.col(f"df_{c}")) * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) for c in tf]
    return reduce(lambda a, b: a + b, part)


def search(docs: DataFrame, query: str, limit: int | None = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of the documents that hold every phrase of the query, the best first by (score, doc_id).

    Scores are BM25, higher is better. A repeated term counts each time. No postings are shuffled: one scan sums
    the corpus statistics of the few phrases into a single row, a second scores and keeps the top. `limit` None
    keeps all hits.
    """
    phrases = T.match_phrases(T.sanitize_query(query))
    base = docs.select(F.col(doc_id).alias("doc_id"), T.index_terms(F.col(text)).alias("terms"))
    tf = [f"tf_{i}" for i in range(len(phrases))]
    base = base.select("doc_id", F.size("terms").alias("dl"), *[_occurrences(F.col("terms"), p).alias(c) for p, c in zip(phrases, tf)])
    if not phrases or (limit is not None and limit < 1):
        return base.where("false").select("doc_id", F.lit(0.0).alias("score"))
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf])
    hits = base.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf])).join(F.broadcast(stats))
    hits = hits.select("doc_id", bm25(tf).alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "doc_id").limit(limit)
