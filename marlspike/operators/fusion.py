"""Score fusion of ranked lists (doc_id, score); both lists are bounded by their top-k limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
QUESTIONS = {"who", "what", "where", "when", "why", "how", "which"}
CODE = re.compile(r"[a-z][A-Z]|_[a-z]|[{}\[\]()]|::|->|=>|\.\w+\(")


def min_max(scored: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 over the list; 0.5 where all are equal."""
    every = Window.partitionBy()
    low, high = F.min("score").over(every), F.max("score").over(every)
    return scored.select("doc_id", F.when(high == low, 0.5).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).alias("score"))


def relative_score_fusion(fts: DataFrame, vec: DataFrame, alpha: float | Column = 0.5) -> DataFrame:
    """(1 - alpha) * full-text + alpha * vector over min-max scaled scores; a missing side is 0."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    both = min_max(fts).withColumnRenamed("score", "f").join(min_max(vec).withColumnRenamed("score", "v"), "doc_id", "full_outer")
    return both.select("doc_id", ((1 - a) * F.coalesce("f", F.lit(0.0)) + a * F.coalesce("v", F.lit(0.0))).alias("score"))


def reciprocal_rank_fusion(fts: DataFrame, vec: DataFrame, alpha: float | Column = 0.5, k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank + 1) over both lists, ranks from 0, weights 1 - alpha and alpha."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1
    part = lambda df, w: df.select("doc_id", rank.alias("r")).select("doc_id", (w / (k + F.col("r") + 1)).alias("s"))
    return part(fts, 1 - a).unionByName(part(vec, a)).groupBy("doc_id").agg(F.sum("s").alias("score"))


def query_alpha(query: str, base: float = 0.5) -> float:
    """The weight of the vector side as far as the wording of the query tells: code less, questions more."""
    alpha = base - 0.15 if CODE.search(query) else base
    words = query.split()
    return alpha + 0.10 if words and words[0].lower() in QUESTIONS else alpha


def list_statistics(fts: DataFrame, vec: DataFrame) -> DataFrame:
    """One row: the lengths and population deviations of both lists."""
    one = lambda df, p: df.agg(F.count("*").alias(f"n_{p}"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias(f"sd_{p}"))
    return one(fts, "fts").join(one(vec, "vec"))


def adaptive_alpha(query: str, base: float = 0.5) -> Column:
    """The weight from the query and the columns of list_statistics(): spread and length of the raw lists."""
    a = F.lit(float(query_alpha(query, base)))
    ratio = F.try_divide(F.col("sd_fts"), F.col("sd_vec"))
    enough = (F.col("n_fts") >= 3) & (F.col("n_vec") >= 3) & (F.col("sd_fts") > 0) & (F.col("sd_vec") > 0)
    a = F.when(enough & (ratio > 2), a - 0.10).when(enough & (ratio < 0.5), a + 0.10).otherwise(a)
    a = F.when((F.col("n_fts") < 2) & (F.col("n_vec") >= 2), F.greatest(a, F.lit(0.8))).when((F.col("n_vec") < 2) & (F.col("n_fts") >= 2), F.least(a, F.lit(0.2))).otherwise(a)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))


def fuse(fts: DataFrame, vec: DataFrame, query: str, alpha: float | None = None) -> DataFrame:
    """(doc_id, score) of both lists in one plan: the rule is chosen by the list lengths as a column.

    One empty list leaves the other min-max scaled; a list of fewer than 3 rows asks for reciprocal ranks;
    otherwise relative scores are fused.
    """
    stats = list_statistics(fts, vec)
    a = F.lit(float(alpha)) if alpha is not None else adaptive_alpha(query)
    stats = F.broadcast(stats.select("n_fts", "n_vec", a.alias("alpha")))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1
    side = lambda df, p: df.join(min_max(df).withColumnRenamed("score", f"m_{p}"), "doc_id").select("doc_id", f"m_{p}", rank.alias(f"r_{p}"))
    both = side(fts, "f").join(side(vec, "v"), "doc_id", "full_outer").join(stats)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rsf = (1 - F.col("alpha")) * zero(F.col("m_f")) + F.col("alpha") * zero(F.col("m_v"))
    rrf = zero((1 - F.col("alpha")) / (RRF_K + F.col("r_f") + 1)) + zero(F.col("alpha") / (RRF_K + F.col("r_v") + 1))
    score = F.when(F.col("n_vec") == 0, F.col("m_f")).when(F.col("n_fts") == 0, F.col("m_v")).when((F.col("n_fts") < 3) | (F.col("n_vec") < 3), rrf).otherwise(rsf)
    return both.select("doc_id", score.alias("score"))
