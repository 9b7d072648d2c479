"""The engine: one corpus directory, SQL over its tables, ingestion and search."""

from __future__ import annotations

import asyncio
import json
import logging
import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import DimensionError, EngineClosedError, SchemaError
from .functions import embedding as E
from .functions.text import Lemma
from .operators import hybrid, text_index
from .operators.vector import check_dimension
from .sources import corpus as C

log = logging.getLogger(__name__)
INDEX = "text_index"


class Engine:
    """A corpus in a directory of parquet tables: `documents` is the corpus, others are the user's.

    Writes append files; reads see a table as it is when an action runs. The dimension of vectors is locked by
    the first ones written and kept beside the tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        strategy: str | None = None,
        lemma: Lemma | None = None,
        embed: object | None = None,
        error_callback: Callable[[Exception], None] | None = None,
    ) -> None:
        self.spark, self.path, self.strategy, self._open = spark, path.rstrip("/"), strategy, True
        self.lemma, self.embed, self.error_callback = lemma, embed, error_callback
        self._startup: list[Callable[[Engine], None]] = []

    def on_startup(self, hook: Callable[[Engine], None]) -> None:
        self._startup.append(hook)

    def start(self) -> Engine:
        self._open = True
        for hook in self._startup:
            hook(self)
        return self

    def close(self) -> None:
        self._open = False

    __enter__ = start

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def is_running(self) -> bool:
        return self._open

    def _at(self, name: str) -> str:
        if not self._open:
            raise EngineClosedError("the engine is closed")
        if not C.NAME.match(name):
            raise SchemaError(f"table name {name!r} is not of letters, digits, - and _")
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def tables(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_")) if fs.exists(p) else []

    def table(self, name: str = "documents") -> DataFrame:
        if not self._exists(name):
            raise SchemaError(f"there is no table {name}")
        return self.spark.read.parquet(self._at(name))

    def sql(self, query: str, args: list | dict | None = None) -> DataFrame:
        """Any SQL over the tables of the directory, as a lazy plan; `?` or named parameters."""
        for name in self.tables():
            if name != INDEX:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def fetch_all(self, query: str, args: list | dict | None = None) -> list[Row]:
        return self.sql(query, args).collect()

    def fetch_one(self, query: str, args: list | dict | None = None) -> Row | None:
        return self.sql(query, args).head()

    def reader(self, query: str, args: list | dict | None = None) -> Iterator[Row]:
        return self.sql(query, args).toLocalIterator()

    def write(self, name: str, rows: DataFrame) -> None:
        self._told(lambda: rows.write.mode("append").parquet(self._at(name)))

    def write_many(self, name: str, rows: Iterable[tuple], schema: str) -> None:
        """Appends rows that are at hand on the driver, in one action."""
        self.write(name, self.spark.createDataFrame(list(rows), schema))

    def _told(self, action: Callable[[], object]) -> object:
        """Runs an action; what it raises goes to error_callback too, whose own failure is only logged."""
        try:
            return action()
        except Exception as e:
            if self.error_callback is not None:
                try:
                    self.error_callback(e)
                except Exception:
                    log.warning("error_callback failed", exc_info=True)
            raise

    def register_function(self, name: str, fn: Callable[..., object], kind: str = "string") -> None:
        """Makes a Python function known to SQL under this name; Column functions need none of this."""
        self._at("documents")
        self.spark.udf.register(name, fn, kind)

    def vectors(self, ids: list[int]) -> DataFrame:
        """(id, embedding) of the rows with these ids."""
        return self.table().where(F.col("id").isin(list(ids)) & F.col("embedding").isNotNull()).select("id", "embedding")

    def sample(self, n: int, seed: int | None = None, name: str = "documents") -> DataFrame:
        """n rows at random: a bounded top of a random key in each task."""
        return self.table(name).orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)

    def execute(self, fn: Callable[[Engine], object]) -> object:
        self._at("documents")
        return fn(self)

    def _dimension(self, new: int | None = None) -> int | None:
        where = os.path.join(self.path, "dimension.json")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(where)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            locked = json.loads("".join(r.value for r in self.spark.read.text(where).collect()))
            if new is not None and new != locked:
                raise DimensionError(f"the corpus has dimension {locked}, not {new}")
            return locked
        if new is not None:
            out = fs.create(p, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
        return new

    def ingest(self, docs: DataFrame, embed: object | None = None, dimension: int | None = None, **how: object) -> None:
        embed = self.embed if embed is None else embed
        how.setdefault("lemma", self.lemma)
        if embed is not None and dimension is None and self._dimension() is None:
            raise SchemaError("the first ingestion with vectors names their dimension")
        locked = self._dimension(dimension)
        rows = C.ingest(docs, embed=embed, dimension=locked, **how)
        if self._exists(INDEX):  # what is indexed is what was written
            rows = C.staged(rows, f"{self.path}/_staged")
        self.write("documents", rows)
        if self._exists(INDEX):
            self._told(lambda: text_index.add(rows.where("fts_indexed"), self._at(INDEX), "content_lemmatized", "id"))

    def index_text(self, buckets: int = text_index.BUCKETS) -> None:
        """Builds the stored index of the corpus anew; from then on ingest() adds to it and search() reads it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(INDEX))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        text_index.add(C.leaves(self.table()).where("fts_indexed"), self._at(INDEX), "content_lemmatized", "id", buckets)

    def search(self, query: str, query_vector: list[float] | None = None, **how: object) -> DataFrame:
        """Hybrid search over the leaves, in the lemmas that ingestion wrote; an embedder of the engine embeds the query."""
        docs = C.leaves(self.table())
        if query_vector is None and self.embed is not None and E.is_embedder(self.embed):
            query_vector = E.query_vector(self.embed, query)
        if query_vector is not None and (locked := self._dimension()) is not None and len(query_vector) != locked:
            raise DimensionError(f"the corpus has dimension {locked}, not {len(query_vector)}")
        vecs = docs.where("vec_indexed").select(F.col("id").alias("vec_id"), "embedding")
        return hybrid.hybrid_search(docs.where("fts_indexed"), vecs, query, query_vector, text="content", doc_id="id", terms="content_lemmatized", lemma=how.pop("lemma", self.lemma), index=self._at(INDEX) if self._exists(INDEX) else None, strategy=how.pop("strategy", self.strategy), **how)

    def state(self) -> C.State:
        return C.detect_state(self.table() if self._exists("documents") else None)

    def verify(self) -> bool:
        """Whether every vector that is marked as indexed is there and of the corpus dimension."""
        if (locked := self._dimension()) is not None:
            check_dimension(self.table().where("embedding is not null"), locked)
        return self.table().where("vec_indexed and embedding is null").isEmpty()

    def backup(self, target: str, progress: Callable[[int, int], None] | None = None) -> None:
        """A snapshot of every table; `progress` hears how many are left of how many after each."""
        names = [n for n in self.tables() if n != INDEX]
        for i, name in enumerate(names, 1):
            self._told(lambda name=name: C.backup(self.table(name), self._at(name), f"{target.rstrip('/')}/{name}"))
            if progress is not None:
                progress(len(names) - i, len(names))

    def vacuum(self, target: str, files: int = 1) -> None:
        for name in [n for n in self.tables() if n != INDEX]:
            C.compact(self.table(name), f"{target.rstrip('/')}/{name}", files)

    def diagnostics(self) -> dict[str, object]:
        return {"path": self.path, "running": self._open, "tables": [n for n in self.tables() if n != INDEX], "text_index": self._exists(INDEX), "dimension": self._dimension(), "state": self.state().name}


class Manager:
    """Many engines under one directory."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._engines: dict[str, Engine] = {}

    def get_or_create(self, name: str, **how: object) -> Engine:
        if not C.NAME.match(name):
            raise SchemaError(f"database name {name!r} is not of letters, digits, - and _")
        return self._engines.setdefault(name, Engine(self.spark, f"{self.path}/{name}", **how))

    __getitem__ = get_or_create

    @property
    def names(self) -> list[str]:
        return sorted(self._engines)

    def drop(self, name: str, delete: bool = False) -> None:
        engine = self._engines.pop(name)
        engine.close()
        if delete:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(engine.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def search_all(self, query: str, limit: int = 10, lemma: Lemma | None = None) -> DataFrame:
        """Full-text search in every database that is searchable, merged by score, in one plan."""
        ready = {n: C.leaves(e.table()).where("fts_indexed") for n, e in self._engines.items() if e._exists("documents")}
        return hybrid.federated_search(C.union_databases(ready), query, "database", limit, "content_lemmatized", "id", lemma)


class AsyncEngine:
    """The engine's actions as coroutines; each runs in a thread, and Spark schedules them side by side."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def __getattr__(self, name: str) -> Callable[..., object]:
        method = getattr(self.engine, name)

        async def call(*args: object, **kwargs: object) -> object:
            return await asyncio.to_thread(method, *args, **kwargs)

        return call
