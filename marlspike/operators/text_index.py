"""A stored inverted index: postings by term on disk, so that a query reads the files of its terms only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import fts

BUCKETS = 64
STRETCH = 1 << 19  # terms that are packed at a time
GROUP = 1 << 20  # terms that a group of postings has, about


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def _known_buckets(spark: SparkSession, path: str) -> int | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sizes")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(f"{path}/sizes").agg(F.max("buckets")).head()[0]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a stretch of documents in a row a (bucket, salt), so that terms and buckets travel once a stretch.

    Reads (doc_id, salt, terms, buckets), a bucket a term. Documents without an id have the salt -1.
    """
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch["terms"]), 0))
        ends = np.cumsum(np.asarray(pc.list_value_length(batch["terms"]), np.int64))
        lo = 0
        while lo < batch.num_rows:  # at least one document, then as many as have STRETCH terms
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, "right")))
            yield _pack(batch.slice(lo, hi - lo))
            lo = hi


def _pack(docs: pa.RecordBatch) -> pa.RecordBatch:
    size = np.asarray(pc.list_value_length(docs["terms"]), np.int64)
    words = docs["terms"].flatten().dictionary_encode()
    code = np.asarray(words.indices, np.int64)
    bucket = np.zeros(len(words.dictionary), np.int64)
    bucket[code] = np.asarray(docs["buckets"].flatten())
    doc, salt = np.repeat(np.arange(len(size)), size), np.asarray(docs["salt"], np.int64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty_like(by_bucket)
    rank[by_bucket] = np.arange(len(rank))
    key = (salt[doc] + 1) * len(rank) + rank[code]  # by salt, bucket and term; documents and places are in order already
    order = np.argsort(key, kind="stable")
    key, doc, at = key[order], doc[order], at[order]
    new_term = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1]))  # of each posting
    tf = np.diff(np.append(first, len(key)))
    term = np.flatnonzero(new_term[first])  # first posting of each term
    key_t = key[first[term]]
    group = (key_t // len(rank)) * (bucket.max() + 1) + bucket[by_bucket[key_t % len(rank)]]
    row = np.flatnonzero(np.append(True, group[1:] != group[:-1]))  # first term of each row

    def lists(values: pa.Array, begin: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), values)

    ids = pc.fill_null(docs["doc_id"], 0)
    return pa.record_batch(
        [
            pa.array(group[row] % (bucket.max() + 1), pa.int32()),
            pa.array(key_t[row] // len(rank) - 1, pa.int32()),
            lists(words.dictionary.take(pa.array(by_bucket[key_t % len(rank)])), row),
            lists(pa.array(np.diff(np.append(term, len(first))), pa.int32()), row),
            lists(ids.take(pa.array(doc[first])), term[row]),
            lists(pa.array(size[doc[first]], pa.int32()), term[row]),
            lists(pa.array(tf, pa.int32()), term[row]),
            lists(pa.array(at, pa.int32()), first[term[row]]),
        ],
        names=["bucket", "salt", "terms", "n", "ids", "dl", "tf", "at"],
    )


def merged(key: tuple, rows: pa.Table) -> pa.Table:
    """The postings of a (bucket, salt), by term and document; rows that repeat a document of one length are one."""
    flat = {c: pc.list_flatten(rows[c].combine_chunks()) for c in ("terms", "n", "ids", "dl", "tf", "at")}
    words = flat["terms"].dictionary_encode()
    by_word = np.asarray(pc.array_sort_indices(words.dictionary))
    rank = np.empty_like(by_word)
    rank[by_word] = np.arange(len(rank), dtype=by_word.dtype)
    term = np.repeat(rank[np.asarray(words.indices)].astype(np.int64), np.asarray(flat["n"]))
    doc, dl, tf = (np.asarray(flat[c], np.int64) for c in ("ids", "dl", "tf"))
    order = np.lexsort((dl, doc, term))
    posting = np.empty_like(order)
    posting[order] = np.cumsum(np.append(False, np.any([x[order][1:] != x[order][:-1] for x in (term, doc, dl)], axis=0)))
    first = order[np.flatnonzero(np.append(True, np.diff(posting[order]) > 0))]
    places, of = np.asarray(flat["at"]), np.repeat(posting, tf)
    by = np.lexsort((places, of))
    tf = np.bincount(of, minlength=len(first))
    ids = pa.array(doc[first]) if key[1].as_py() >= 0 else pa.nulls(len(first), pa.int64())
    at = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(places[by], pa.int32()))
    texts = words.dictionary.take(pa.array(by_word)).take(pa.array(term[first]))
    return pa.table([texts, ids, pa.array(tf, pa.int32()), pa.array(dl[first], pa.int32()), at, pa.array(np.full(len(first), key[0].as_py()), pa.int32())], names=["term", "doc_id", "tf", "dl", "positions", "bucket"])


def add(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Adds documents to the index at `path`, which need not exist yet; one that does keeps its number of buckets.

    `postings` holds (term, doc_id, tf, dl, positions) in folders by a hash of the term, sorted by term inside a
    file so that row groups are skipped too; `sizes` has one row an addition: documents, those with a text, and terms.
    Ids are whole numbers. Occurrences are counted where the documents are read, and postings are shuffled once, packed,
    to (bucket, salt). There are as many salts of documents as keep a group near GROUP terms, so a term that every
    document holds is spread over all of them.
    """
    spark = docs.sparkSession
    buckets = _known_buckets(spark, path) or buckets
    terms = docs.select(F.col(doc_id).alias("doc_id"), T.index_terms(F.col(text)).alias("terms"))
    one = terms.agg(F.count("*").alias("n"), F.count("terms").alias("texts"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets"))
    sizes = one.collect()
    spark.createDataFrame(sizes, one.schema).coalesce(1).write.mode("append").parquet(f"{path}/sizes")
    total, kind = sizes[0].total, terms.schema["doc_id"].dataType
    salts, parts = max(1, math.ceil(total / buckets / GROUP)), max(1, math.ceil(total / GROUP))
    salt = F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(salts))).cast("int").alias("salt")
    rows = terms.select(F.col("doc_id").cast("long").alias("doc_id"), salt, "terms", F.transform("terms", lambda x: bucket_of(x, buckets)).alias("buckets"))
    rows = rows.mapInArrow(packed, "bucket int, salt int, terms array<string>, n array<int>, ids array<long>, dl array<int>, tf array<int>, at array<int>")
    rows = rows.repartition(parts, "bucket", "salt").groupBy("bucket", "salt").applyInArrow(merged, "term string, doc_id long, tf int, dl int, positions array<int>, bucket int")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(kind)).sortWithinPartitions("bucket", "term", "doc_id")
    rows.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings").select("term", "doc_id", "tf", "dl", "positions", "bucket")


def search(spark: SparkSession, path: str, query: str, limit: int | None = 20) -> DataFrame:
    """(doc_id, score) as fts.search() gives them, from the index: the folders of the query's terms are read."""
    phrases = T.match_phrases(T.sanitize_query(query))
    rows = postings(spark, path)
    if not phrases or (limit is not None and limit < 1):
        return rows.where("false").select("doc_id", F.lit(0.0).alias("score"))
    n, texts, total, buckets = spark.read.parquet(f"{path}/sizes").agg(F.sum("n"), F.sum("texts"), F.sum("total"), F.max("buckets")).head()
    terms = sorted({t for p in phrases for t in p})
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets)).collect()]
    rows = rows.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(terms))
    place = {t: i for i, t in enumerate(terms)}
    alone = all(len(p) == 1 for p in phrases)
    held = "tf" if alone else F.struct("tf", "positions")
    docs = rows.groupBy("doc_id").agg(F.first("dl").alias("dl"), *[F.first(F.when(F.col("term") == t, F.col(held) if alone else held), ignorenulls=True).alias(f"t{i}") for t, i in place.items()])

    def occurrences(p: list[str]) -> Column:
        first = f"t{place[p[0]]}"
        if len(p) == 1:
            return F.coalesce(F.col(first if alone else f"{first}.tf"), F.lit(0))
        here = lambda x: reduce(lambda a, b: a & b, [F.array_contains(F.col(f"t{place[t]}.positions"), (x + i).cast("int")) for i, t in enumerate(p[1:], 1)])
        return F.coalesce(F.when(reduce(lambda a, b: a & b, [F.col(f"t{place[t]}").isNotNull() for t in p]), F.size(F.filter(F.col(f"{first}.positions"), here))), F.lit(0))

    tf = [f"tf_{i}" for i in range(len(phrases))]
    docs = docs.select("doc_id", "dl", *[occurrences(p).alias(c) for p, c in zip(phrases, tf)])
    stats = docs.agg(F.lit(n).alias("n"), F.lit(total / texts if texts else 0.0).alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf])
    hits = docs.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf])).join(F.broadcast(stats))
    hits = hits.select("doc_id", fts.bm25(tf).alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "doc_id").limit(limit)
