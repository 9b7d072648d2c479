"""SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models, normalizers

from ._bytes import encode_chunks, list_array, out_schema, ragged, slices, utf8, with_columns

MODEL = "piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message as (number, value)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Model:
    """What the encoder needs of a model file."""

    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    unk: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    unk_surface: str


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    pieces = []
    for number, value in top:
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode("utf-8"), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
    trainer = dict(x for n, v in top if n == 2 for x in _fields(v))
    norm = dict(x for n, v in top if n == 3 for x in _fields(v))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return Model(pieces, kind == 1, bool(trainer.get(35, 0)), unk, norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), trainer.get(44, " ⁇ ".encode()).decode("utf-8"))


class Codec:
    """A SentencePiece model as a tokenizers model: ids of texts, and texts of ids.

    White space of a text becomes the metaspace mark. Where no piece has a mark after another character, no token
    reaches over the begin of a run of marks, and texts are encoded run by run, equal runs once.
    """

    def __init__(self, path: str) -> None:
        m = self.model = read_model(path)
        unk = m.pieces[m.unk][0]
        if m.unigram:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
        else:
            text = {p: (s, i) for i, (p, s, t) in enumerate(m.pieces) if t in (NORMAL, USER)}
            merges = []
            for p, (score, _) in text.items():
                merges += [(-score, text[p[:k]][1], text[p[k:]][1], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in text and p[k:] in text]
            merges.sort()
            core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, [x[3:] for x in merges], unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        self.splits = m.escape and not any(MARK in p.lstrip(MARK) for p, _, t in m.pieces if t in (NORMAL, USER))
        surface = []
        for i, (p, _, t) in enumerate(m.pieces):
            surface.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else m.unk_surface.encode() if i == m.unk else p.replace(MARK, " ").encode() if m.escape else p.encode())
        self.width = np.array([len(x) for x in surface], np.int64)
        self.base = np.cumsum(self.width) - self.width
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def normal(self, column: pa.Array) -> pa.Array:
        if self.normalizer is None:
            return column
        return pa.array([None if t is None else self.normalizer.normalize_str(t) for t in column.to_pylist()], pa.large_string())

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        chunks = [c.replace(" ", MARK) for c in chunks] if self.model.escape else chunks
        return [e.ids for k in range(0, len(chunks), 20_000) for e in self.tokenizer.encode_batch_fast(chunks[k : k + 20_000], add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the count of each; null and empty texts have none."""
        column = self.normal(column)
        if self.model.escape:  # a mark in the text itself is no other symbol than a space
            column = pc.replace_substring(column, MARK, " ")
        raw, texts = utf8(column)
        full = np.diff(texts) > 0
        if self.model.dummy_prefix:
            raw = np.insert(raw, texts[:-1][full], 32)
            texts = texts + np.concatenate([[0], np.cumsum(full)])
        begin = texts[:-1][full]
        cut = np.zeros(len(raw), bool)
        if self.splits and len(raw):
            cut = raw == 32
            cut[1:] &= raw[:-1] != 32
        cut[begin] = True
        start = np.flatnonzero(cut)
        ids, count = encode_chunks(raw, start, np.append(start[1:], len(raw))[: len(start)], self._ids)
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(upto[np.searchsorted(start, texts)])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all decoded texts, end to end, and the size of each; the dummy prefix is taken off."""
        width = self.width[ids]
        _, place = ragged(width)
        raw = self.surface[np.repeat(self.base[ids], width) + place]
        at = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(count)])]
        if self.model.dummy_prefix and len(raw):
            begin = at[:-1][np.diff(at) > 0]
            drop = begin[raw[begin] == 32]
            keep = np.ones(len(raw), bool)
            keep[drop] = False
            at = at - np.searchsorted(drop, at)
            raw = raw[keep]
        return raw, np.diff(at)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def same_texts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which texts, given as bytes and sizes, are equal in both."""
    same = a[1] == b[1]
    ends = np.cumsum(a[1]), np.cumsum(b[1])
    if same.all():
        row = np.repeat(np.arange(len(same)), a[1])
        return np.bincount(row[a[0] != b[0]], minlength=len(same)) == 0
    return np.array([s and bool((a[0][i - n : i] == b[0][j - n : j]).all()) for s, n, i, j in zip(same, a[1], *ends)], bool)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ids (array of int), n_tokens and round_trip to every row.

    round_trip tells whether the ids decode to the normalised text; it is false where an unknown piece stands
    for characters that the model cannot write, or where the text itself holds the metaspace mark. A null text has null ids, 0 tokens and a null round_trip, an
    empty one empty ids. Repeated rows are kept; columns of the input with these names are replaced. Batches are
    encoded in ranges of 2 MB of text, by as many threads as the library is allowed.
    """
    path = path or model_path()
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for lo, hi in slices(whole.column(place), 2 << 20):
                batch = whole.slice(lo, hi - lo)
                column = batch.column(place)
                ids, count = c.encode(column)
                raw, texts = utf8(c.normal(column))
                ok = same_texts((raw, np.diff(texts)), c.decode(ids, count))
                null = ~np.asarray(column.is_valid())
                lists = list_array(ids.astype(np.int32), count, pa.int32())
                if null.any():
                    lists = lists.take(pa.array(np.arange(len(null)), mask=null))
                yield with_columns(batch, ids=lists, n_tokens=pa.array(count, pa.int64()), round_trip=pa.array(ok, mask=null))

    return docs.mapInArrow(run, out_schema(docs, ids="array<int>", n_tokens="long", round_trip="boolean"))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids give null. Bytes that are no UTF-8 become U+FFFD."""
    path = path or model_path()
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(place)
            lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
            raw, size = c.decode(np.asarray(column.flatten(), np.int64), lengths)
            data, ends = raw.tobytes(), np.cumsum(size)
            texts = [data[e - n : e].decode("utf-8", "replace") if v else None for e, n, v in zip(ends.tolist(), size.tolist(), column.is_valid().to_pylist())]
            yield with_columns(batch, **{out: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, out_schema(rows, **{out: "string"}))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).drop("text")
