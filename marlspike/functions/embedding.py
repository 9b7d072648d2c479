"""What may embed texts: a function of columns, a function of a list of texts, or an object with two methods."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmbeddingError

BatchFn = Callable[[list[str]], list[list[float]]]


@runtime_checkable
class Embedder(Protocol):
    """Documents and queries may be embedded in different ways."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class batch:  # noqa: N801
    """Marks a function from a list of texts to their vectors, which runs on batches of rows on the executors."""

    def __init__(self, fn: BatchFn, size: int = 256) -> None:
        self.fn, self.size = fn, size

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self.fn(texts)

    def embed_query(self, text: str) -> list[float]:
        out = self.fn([text])
        if not out:
            raise EmbeddingError("no vector came back for a query")
        return out[0]


def checked(vectors: object, n: int) -> list[list[float]]:
    """One vector a text, none of them empty or with components that are no finite numbers; all of one length."""
    if vectors is None or len(vectors) != n:
        raise EmbeddingError(f"{0 if vectors is None else len(vectors)} vectors for {n} texts")
    out = [[float(x) for x in v] if v is not None else [] for v in vectors]
    for v in out:
        if not v or not all(map(math.isfinite, v)):
            raise EmbeddingError("a vector is empty or has a component that is no finite number")
        if len(v) != len(out[0]):
            raise EmbeddingError(f"vectors of {len(out[0])} and of {len(v)} components in one batch")
    return out


def _embedder(embed: object) -> Embedder | None:
    """The object as an Embedder; None for a function. An object with one of the two methods is refused."""
    have = [callable(getattr(embed, m, None)) for m in ("embed_documents", "embed_query")]
    if all(have):
        return embed
    if any(have):
        raise TypeError("an embedder needs embed_documents() and embed_query()")
    if not callable(embed):
        raise TypeError(f"embed is a function or an embedder, not {type(embed).__name__}")
    return None


def is_embedder(embed: object) -> bool:
    return _embedder(embed) is not None


def column_function(embed: object) -> Callable[[Column], Column]:
    """How to embed a column of texts: embedders run in Arrow batches, functions of columns as they are."""
    e = _embedder(embed)
    if e is None:
        return embed
    size = getattr(embed, "size", 256)

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        at = [i for i, t in enumerate(every) if t is not None]
        out: list[list[float] | None] = [None] * len(every)
        for lo in range(0, len(at), size):
            part = at[lo : lo + size]
            for i, v in zip(part, checked(e.embed_documents([every[i] for i in part]), len(part))):
                out[i] = v
        return pa.array(out, pa.list_(pa.float32()))

    return run


def query_vector(embed: object, query: str) -> list[float]:
    """The vector of a query, by an embedder or by batch(); a function of columns cannot tell one."""
    e = _embedder(embed)
    if e is None:
        raise TypeError(f"{inspect.getattr_static(embed, '__name__', 'embed')} embeds columns; wrap a function of texts in batch()")
    return checked([e.embed_query(query)], 1)[0]
