"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

TABLES = 12
PROBES = 8
SEED = 20240
BLOCK = 8192  # rows of one side that meet in a task


def usable(v: Column) -> Column:
    """Not null, not zero, and no component null or non-finite."""
    x = v.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(x, lambda c: c != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform, on zero-padded rows."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def hashed(df: DataFrame, tables: int, probes: int, seed: int, square: float | None = None) -> DataFrame:
    """(t, b, id, v): each vector under its `probes` nearest signed axes of every table; one axis indexes it.

    With `square`, the mean squared length, a vector takes `probes` times its squared length over that, rounded,
    and one axis at least: long vectors have large products at moderate angles too. Rows stay below twice as many.
    """
    kind = df.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                x, n = vectors(batch.column(1)), batch.num_rows
                width = 2 << max(0, (x.shape[1] - 1).bit_length())
                each = np.full(n, min(probes, width)) if square is None else np.clip(np.rint(probes * np.nan_to_num(((x / np.sqrt(square or 1.0)) ** 2).sum(1))), 1, width).astype(int)
                k, row = int(each.max()), pa.array(np.repeat(np.arange(n), each))
                for t in range(tables):
                    y = rotated(x, t, seed)
                    signed = np.concatenate([y, -y], 1)
                    b = signed.argmax(1)[:, None] if k == 1 else np.argsort(-signed, axis=1)[:, :k]
                    b = b[np.arange(k) < each[:, None]]
                    for at in range(0, len(b), 4000):
                        part, rows = b[at : at + 4000].astype(np.int32), row[at : at + 4000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(part), batch.column(0).take(rows), batch.column(1).take(rows)], names=["t", "b", "id", "v"])

    return df.mapInArrow(run, f"t int, b int, id long, v {kind}")


def best_of(k: int):
    """The k nearest members of a block for each query in it, scored in double precision."""

    def run(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if members.num_rows and queries.num_rows:
            ids, x = np.asarray(members["id"], np.int64), vectors(members["v"].combine_chunks())
            qids, q = np.asarray(queries["id"], np.int64), vectors(queries["v"].combine_chunks())
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ x.T
                s[qids[lo : lo + 512, None] == ids] = -np.inf
                floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                # a product may be rounded otherwise in another block: what is close to the floor stays, and is scored row by row
                i, j = np.nonzero((s >= floor[:, None] - 1e-9 * (1 + np.abs(floor[:, None]))) & (s > -np.inf) if s.shape[1] > k else s > -np.inf)
                out = [np.concatenate(p) for p in zip(out, (qids[lo + i], ids[j], (q[lo + i] * x[j]).sum(1)))]
        return pa.table([pa.array(out[0]), pa.array(out[1]), pa.array(out[2])], names=names)

    return run


def met(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best members of the buckets that it looks into."""
    # one row a bucket: at most tables * 2 * (dimensions, to a power of two), whatever the data
    count = lambda df, c: df.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    split = F.broadcast(count(members, "ms").join(count(queries, "qs"), ["t", "b"]))
    mine = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = members.join(split, ["t", "b"]).select("t", "b", mine(F.col("ms")).alias("m"), all_of("qs").alias("q"), "id", "v")
    queries = queries.join(split, ["t", "b"]).select("t", "b", mine(F.col("qs")).alias("q"), all_of("ms").alias("m"), "id", "v")
    on = ["t", "b", "m", "q"]
    found = members.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(best_of(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vecs: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest vectors found, by inner product.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the query's id.
    All rows are indexed: a vector lies in the bucket of its nearest signed axis after a pseudo-random rotation,
    once in each table (a longer one also in the next nearest, as many as its squared length is times the mean,
    since a product may be large at a moderate angle), and a query looks into the buckets of its `probes` nearest axes. Every candidate met is
    scored on the original vectors in double precision; ties go to the smaller id. A query that met fewer
    than k candidates looks into every bucket of one table, so it gets all there is.

    Buckets that hold many members or meet many queries are split by a hash of the id into blocks of about
    BLOCK rows a side; a block keeps only its best k for each query, so no group is larger and no pair list is
    built. Null ids, null or zero vectors, vectors with null or non-finite components, and those of another
    length than most take no part; of rows with one id the smallest vector counts. Other columns are not read.
    """
    v = vecs.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v"))
    v = v.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    if not lengths:
        return vecs.sparkSession.sql("SELECT 0L query_id, 0 rank, 0L vec_id, 0D score WHERE false")
    dims = lengths[0]["d"]
    v = v.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    asked = v.where(F.col("id") % every == 0)
    square = v.agg(F.avg(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c))).head()[0]
    found = written(met(hashed(v, tables, 1, seed, square), hashed(asked, tables, probes, seed), k), "neighbours")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if not short.head(1):
        return found
    rest = met(hashed(v, 1, 1, seed), hashed(short, 1, 4 * dims, seed), k)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
