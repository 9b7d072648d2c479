"""Groups of whole texts that exchange packed keys: each group learns which of its keys others have too.

A table of texts is shuffled once into groups of about GROUP_BYTES. A round sends the distinct keys of each
group, packed, to buckets, and answers come back to the groups. A key that a third of all rows share costs one
entry for each group, so no key makes a bucket or a task large. There is a bucket for so many groups, so that
a row from a group to a bucket holds many keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Words, find_words, lowered, span_hashes, utf8
from ._shared import partitions

GROUP_BYTES = 3 << 20
GROUPS_A_BUCKET = 8
LOW = np.uint64((1 << 32) - 1)
LAST = np.iinfo(np.int64).max
U = np.uint64


def grouped(docs: DataFrame, doc_id: str, text: str, rest: list[str]) -> tuple[DataFrame, int]:
    """(g, id, text, *rest) in groups by a hash of id and text, and the number of groups."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).head()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    g = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), groups).cast("int")
    t = docs.select(g.alias("g"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(rest)])
    return t.repartition(max(1, min(groups, partitions(docs.sparkSession))), "g"), groups


class Group:
    """The rows of a group by (id, hash of the text), null ids last, and their words."""

    def __init__(self, table: pa.Table, lower: bool = False) -> None:
        ids = np.asarray(table["id"].combine_chunks().fill_null(LAST), np.int64)
        raw, at = utf8(table["text"])
        order = np.lexsort((span_hashes(raw, at[:-1], at[1:]), ids))
        if not (order[1:] > order[:-1]).all():
            table = table.take(pa.array(order))
            raw, at = utf8(table["text"])
        self.table, self.ids = table, ids[order]
        self.words: Words = find_words(lowered(raw) if lower else raw, at)
        self.texts = at


def buckets_of(groups: int) -> int:
    return math.ceil(groups / GROUPS_A_BUCKET)


def composite(key: np.ndarray, bucket_of: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above, 32 bits of the key below: sorted, the keys of a bucket lie together.

    Buckets grow with the groups, so a bucket's share of 2^32 stays about 1 in 1,000 at any size. Keys that fall
    together by chance only make a few more candidates.
    """
    return ((bucket_of % U(buckets)) << U(32)) | (key & LOW)


def pack(codes: np.ndarray, g: int) -> pa.Table:
    """Rows (b, g, keys) of sorted distinct codes, four bytes a key."""
    b = (codes >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    low = (codes & LOW).astype("<u4").tobytes()
    last = np.append(first[1:], len(b))
    return pa.table([pa.array(b[first].astype(np.int32)), pa.array(np.full(len(first), g, np.int32)), pa.array([low[4 * i : 4 * j] for i, j in zip(first.tolist(), last.tolist())], pa.binary())], names=["b", "g", "keys"])


def level(count: np.ndarray | int) -> np.ndarray:
    """A count as one byte that rises with its logarithm: 0 for one, 255 for four billion."""
    return np.minimum(np.rint(8 * np.log2(count)), 255).astype(np.uint8)


def answer_counts(key: tuple, table: pa.Table) -> pa.Table:
    """For each group of a bucket, in how many groups each of its keys is, as the level of that count."""
    blobs = [np.frombuffer(x.as_buffer(), "<u4") for x in table["keys"]]
    size = [len(x) for x in blobs]
    _, which, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    seen, ends = level(count)[which].tobytes(), np.cumsum(size).tolist()
    return pa.table([table["g"], pa.array(np.full(len(size), key[0].as_py(), np.int32)), pa.array([seen[e - n : e] for e, n in zip(ends, size)], pa.binary())], names=["g", "b", "seen"])


def in_order(table: pa.Table) -> np.ndarray:
    """The answers of all buckets, in the order of the codes that pack() was given."""
    if not table.num_rows:
        return np.zeros(0, np.uint8)
    rows = sorted(zip(table["b"].to_pylist(), table["seen"].to_pylist()))
    return np.frombuffer(b"".join(x for _, x in rows), np.uint8)
