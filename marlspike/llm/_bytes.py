"""Vectorised text scanning: words, word hashes and chunk encoding over the UTF-8 bytes of an Arrow column.

Everything here works on a whole batch at once with numpy; no loop runs per word or per character.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_LONG = 256  # words longer than this many bytes are hashed one by one
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection with full avalanche."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each text begins (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """start, end: byte positions of each word; of: first word of each text, one more entry at the end."""

    raw: np.ndarray
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end, seed)


def find_words(raw: np.ndarray, texts: np.ndarray) -> Words:
    solid = ~_SPACE[raw]
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    before = np.empty(n, bool)  # the byte before belongs to the same text and to a word
    if n:
        before[0] = False
        before[1:] = solid[:-1]
        before &= ~first[:n]
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
        after &= ~first[1:]
    end = np.flatnonzero(solid & ~after) + 1
    return Words(raw, texts, start, end, np.searchsorted(start, texts))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64))
    if not len(size):
        return h
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    todo = np.flatnonzero(size > 0) if size.min() == 0 else None
    for k in range(0, min(int(size.max()), _LONG), 8):
        if k:
            todo = np.flatnonzero(size > k)
        s, z = (start, size) if todo is None else (start[todo], size[todo])
        part = eights[s + k] & _MASK[np.minimum(z - k, 8)]
        if todo is None:
            h = mix((h ^ part) * U(0x9FB21C651E98DF25) + U(k + 1))
        else:
            h[todo] = mix((h[todo] ^ part) * U(0x9FB21C651E98DF25) + U(k + 1))
    for i in np.flatnonzero(size > _LONG):
        h[i] ^= U(xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), seed))
    return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive values; entry i covers h[i : i + size]."""
    if len(h) < size:
        return np.zeros(0, U)
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, done = power, width
            else:
                m = len(h) - done - width + 1
                out, done = mix(out[:m] * U(0x9E3779B97F4A7C15) + power[done : done + m] + U(width)), done + width
        if done == size:
            return out
        m = len(power) - width
        power, width = mix(power[:m] * U(0xC2B2AE3D27D4EB4F) + power[width : width + m] + U(2 * width)), 2 * width


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths: the row of each element, and its place in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def encode_chunks(raw: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable[[list[str]], list]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all chunks, end to end, and the count of each chunk; equal chunks are encoded once."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.empty(len(start), dtype=[("a", "<u8"), ("b", "<u8")])
    pair["a"], pair["b"] = span_hashes(raw, start, end, 1), span_hashes(raw, start, end, 2)
    order = np.argsort(pair["a"], kind="stable")
    same = pair[order]
    new = np.ones(len(order), bool)
    new[1:] = (same["a"][1:] != same["a"][:-1]) | (same["b"][1:] != same["b"][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    data = raw.tobytes()
    ids = encode([data[s:e].decode("utf-8") for s, e in zip(start[one].tolist(), end[one].tolist())])
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
    base = np.cumsum(size) - size
    count = size[which]
    _, place = ragged(count)
    return flat[np.repeat(base[which], count) + place], count


def slices(column: pa.Array, limit: int = 8 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each; a longer text is a range of its own."""
    at = utf8(column)[1]
    out, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of rows of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with these columns at its end; columns of the same names are replaced."""
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(new.values()), [batch.schema.names[i] for i in keep] + list(new))


def out_schema(df, **new: str):
    """The schema that with_columns() gives: the columns of `df`, then these, as Spark type names."""
    from pyspark.sql.types import DataType, StructType

    s = StructType([f for f in df.schema.fields if f.name.lower() not in new])
    for name, kind in new.items():
        s = s.add(name, DataType.fromDDL(kind))
    return s
