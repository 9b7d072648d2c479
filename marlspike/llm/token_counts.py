"""Token counts: whole documents are encoded once and each token is attributed to the section that its span lies in."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._bytes import encode_chunks, ragged, slices, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "most", "share")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The byte-level BPE of a rank file, and the bytes that each of its ids stands for."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def safe_cuts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where every text begins, and each space after something that is surely no white space.

    The pattern never lets a piece reach over such a space, so the text may be cut there without any change of
    its tokens. Bytes that may end a Unicode space only make chunks longer.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    p1 = np.concatenate([[0], raw[:-1]]).astype(np.uint8)
    p2 = np.concatenate([[0, 0], raw[:-2]])[:n].astype(np.uint8)
    p3 = np.concatenate([[0, 0, 0], raw[:-3]])[:n].astype(np.uint8)
    odd = ((p2 == 0xC2) & ((p1 == 0xA0) | (p1 == 0x85))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & (p2 >= 0x80) & (p2 <= 0x9A))
    cut = (raw == 32) & (((p1 > 32) & (p1 < 127)) | ((p1 >= 128) & ~odd))
    begin = texts[:-1][np.diff(texts) > 0]
    cut[begin] = True
    return np.flatnonzero(cut)


def tokens(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, the byte at which each begins and ends in the joined texts, and where the tokens of each text begin."""
    bpe, width = encoder(path)
    raw, texts = utf8(column)
    start = safe_cuts(raw, texts)
    end = np.append(start[1:], len(raw))[: len(start)]
    ids, _ = encode_chunks(raw, start, end, lambda xs: [bpe.encode_ordinary(x) for x in xs])
    upto = np.cumsum(width[ids])
    return ids, upto - width[ids], upto, np.searchsorted(upto - width[ids], texts)


def line_bounds(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins (a line keeps its line feed), and the first line of each text; an empty text is one line."""
    feed = np.flatnonzero(raw == 10) + 1
    feed = feed[~np.isin(feed, texts)]
    row = np.concatenate([np.searchsorted(texts, feed, "right") - 1, np.arange(len(texts) - 1)])
    at = np.concatenate([feed, texts[:-1]])
    order = np.lexsort((at, row))
    return at[order], np.searchsorted(row[order], np.arange(len(texts)))


def attribute(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [low, high): sections lie end to end, so an interval join is two binary searches."""
    sections = len(low)
    out = np.zeros(sections)
    if not len(begin):
        return out
    solid = np.flatnonzero(high > low)
    a = solid[np.searchsorted(low[solid], begin, "right") - 1]
    b = solid[np.searchsorted(low[solid], end - 1, "right") - 1]
    inside = a == b
    out += np.bincount(a[inside | (rule == "start")], minlength=sections)
    over = np.flatnonzero(~inside)
    if rule == "start" or not len(over):
        return out
    token, k = ragged(b[over] - a[over] + 1)
    section = a[over][token] + k
    part = np.minimum(end[over][token], high[section]) - np.maximum(begin[over][token], low[section])
    if rule == "share":
        np.add.at(out, section, part / (end - begin)[over][token])
        return out
    order = np.lexsort((k, -part, token))
    first = order[np.concatenate([[True], token[order][1:] != token[order][:-1]])]
    return out + np.bincount(section[first], minlength=sections)


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, rule: str = "most") -> DataFrame:
    """(doc_id, section, n_bytes, n_tokens): the lines of every text with the tokens attributed to them.

    A line keeps its line feed, so the sections cover the text. A token that crosses lines goes, by `rule`, to
    the line with its first byte (start), to that with most of its bytes, ties to the earlier one (most), or to
    all by their bytes (share). Counts of a document always add up to the tokens of the whole text.

    A null text has no sections; an empty one has section 0 with no tokens. Repeated rows and null ids are kept
    as they are, other columns are not read. Texts are encoded in ranges of 8 MB, so memory does not depend on
    the partition; a longer text is a range of its own.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or vocabulary_path()
    key = docs.schema[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column(1)):
                batch = whole.slice(lo, hi - lo).filter(whole.column(1).slice(lo, hi - lo).is_valid())
                if not batch.num_rows:
                    continue
                raw, texts = utf8(batch.column(1))
                _, begin, end, _ = tokens(batch.column(1), path)
                low, of = line_bounds(raw, texts)
                row, place = ragged(np.diff(of))
                high = np.append(low[1:], len(raw))
                n = attribute(begin, end, low, high, rule)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(high - low, pa.int64()), pa.array(n, pa.float64()) if rule == "share" else pa.array(n.astype(np.int64))], names=["doc_id", "section", "n_bytes", "n_tokens"])

    kind = "double" if rule == "share" else "long"
    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(run, f"doc_id {key.dataType.simpleString()}, section int, n_bytes long, n_tokens {kind}")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
