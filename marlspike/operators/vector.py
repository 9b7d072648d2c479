"""Nearest-neighbour strategies over an embeddings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionError, VectorBackendError
from ..functions import vectors as V

OVERSAMPLE = 20
EXACT_BELOW = 1_000_000


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def scan(vecs: DataFrame, dimension: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(doc_id, v): the rows that an index loads: of the right length and finite."""
    return vecs.select(F.col(vec_id).alias("doc_id"), F.col(embedding).alias("v")).where(V.valid_vector(F.col("v"), dimension))


def knn_exact(vecs: DataFrame, query: list[float], k: int = 10, metric: str = "l2", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(doc_id, dist) of the k nearest, ties to the smaller id: a scan, a projection and a bounded top k per task."""
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        return scan(vecs, 1, vec_id, embedding).where("false").select("doc_id", F.lit(0.0).alias("dist"))
    rows = scan(vecs, len(query), vec_id, embedding).select("doc_id", V.distance(F.col("v"), literal(query), metric).alias("dist"))
    return rows.where(F.col("dist").isNotNull()).orderBy("dist", "doc_id").limit(max(k, 0))


def bq_prescore(vecs: DataFrame, query: list[float], m: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(doc_id, hamming, v) of the m rows whose sign codes are nearest to the query's, ties to the smaller id."""
    d = len(query)
    q = V.sign_code(literal(query), d)
    rows = scan(vecs, d, vec_id, embedding).select("doc_id", V.hamming(V.sign_code(F.col("v"), d), q).alias("hamming"), "v")
    return rows.orderBy("hamming", "doc_id").limit(m)


def knn_bq(vecs: DataFrame, query: list[float], k: int = 10, oversample: int = OVERSAMPLE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Binary-quantised search: k * oversample rows by Hamming distance, then exact distance. With no more rows than that it is exact by itself."""
    if not query:
        return knn_exact(vecs, query, k, "l2", vec_id, embedding)
    near = bq_prescore(vecs, query, k * oversample, vec_id, embedding)
    return near.select("doc_id", V.distance(F.col("v"), literal(query)).alias("dist")).orderBy("dist", "doc_id").limit(k)


def ivf_index(vecs: DataFrame, cells: int = 16, sample: int = 20_000, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[float]]]:
    """(doc_id, cell, v) and the centres of the cells, fitted by k-means on a bounded sample.

    Written partitioned by cell, a probe of a few cells reads only their files.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    first = vecs.where(F.col(embedding).isNotNull()).select(F.size(embedding)).head()
    if first is None:
        raise VectorBackendError("there are no vectors to index")
    rows = scan(vecs, first[0], vec_id, embedding)
    fitted = KMeans(k=cells, seed=seed, featuresCol="f").fit(rows.orderBy(F.xxhash64("doc_id")).limit(sample).select(array_to_vector("v").alias("f")))
    centres = [c.tolist() for c in fitted.clusterCenters()]
    away = F.array(*[V.l2_sq(F.col("v"), literal(c)) for c in centres])
    return rows.withColumn("cell", F.array_position(away, F.array_min(away)).cast("int") - 1).select("doc_id", "cell", "v"), centres


def knn_ivf(index: DataFrame, centres: list[list[float]], query: list[float], k: int = 10, probes: int = 4) -> DataFrame:
    """(doc_id, dist) of the k nearest in the `probes` cells nearest to the query: a filter on cell, then the exact top k."""
    order = sorted(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(centres[c], query)), c))
    rows = index.where(F.col("cell").isin(order[:probes])).select("doc_id", V.distance(F.col("v"), literal(query)).alias("dist"))
    return rows.orderBy("dist", "doc_id").limit(k)


def relevance(near: DataFrame) -> DataFrame:
    """(doc_id, score) with score 1 / (1 + distance); distances that are none are left out."""
    return near.where(V.valid_distance(F.col("dist"))).select("doc_id", (1 / (1 + F.col("dist"))).alias("score"))


def upsert(vecs: DataFrame, changes: DataFrame, order: str, vec_id: str = "vec_id") -> DataFrame:
    """The table after upserts: of rows with one id the latest by `order` in `changes` wins over the old one."""
    last = Window.partitionBy(vec_id).orderBy(F.desc(order))
    new = changes.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", order)
    return vecs.join(new, vec_id, "left_anti").unionByName(new)


def remove(vecs: DataFrame, ids: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    return vecs.join(ids.select(vec_id), vec_id, "left_anti")


def fetch(vecs: DataFrame, ids: list[int], vec_id: str = "vec_id") -> DataFrame:
    """The rows of these ids; the list reaches the scan as a filter."""
    return vecs.where(F.col(vec_id).isin(list(ids)))


def check_dimension(vecs: DataFrame, dimension: int, embedding: str = "embedding") -> None:
    """Raises DimensionError if a vector has another length."""
    bad = vecs.where(F.size(embedding) != dimension).select(F.size(embedding)).head()
    if bad is not None:
        raise DimensionError(f"a vector has {bad[0]} components, the corpus has {dimension}")


Strategy = Callable[[DataFrame, list[float], int], DataFrame]


def _ivf(vecs: DataFrame, query: list[float], k: int) -> DataFrame:
    index, centres = ivf_index(vecs)
    return knn_ivf(index, centres, query, k, probes=8)


STRATEGIES: dict[str, Strategy] = {"exact": knn_exact, "flat": knn_bq, "ivf": _ivf, "hnsw": _ivf, "usearch": _ivf}


def strategy(name: str | Strategy | None, rows: int | None = None) -> Strategy:
    """A search strategy by name, a callable as it is, or by table size: exact scan below EXACT_BELOW rows, else cells."""
    if name is None:
        return knn_exact if rows is None or rows < EXACT_BELOW else _ivf
    if callable(name):
        return name
    if name not in STRATEGIES:
        raise VectorBackendError(f"unknown vector strategy {name!r}; known are {sorted(STRATEGIES)}")
    return STRATEGIES[name]
