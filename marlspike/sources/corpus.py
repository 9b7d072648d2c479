"""Corpus tables: schemas, reading, writing, chunk trees, pending work, snapshots."""

from __future__ import annotations

import enum
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions import text as X
from ..functions.chunkers import Chunker, chunks
from ..functions.embedding import column_function
from ..operators.vector import check_dimension

CORPUS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("content_lemmatized", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("chunk_of", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("vec_indexed", T.BooleanType()),
        T.StructField("fts_indexed", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
NAME = re.compile(r"^[a-zA-Z0-9_-]+$")
CHUNK_SPAN = 1 << 20  # ids that the chunks of one document may take


class State(enum.IntEnum):
    """How far a corpus is built; INDEXED (vectors) and SEARCHABLE (text) are independent of each other."""

    EMPTY = 0
    BASE = 1
    INDEXED = 2
    SEARCHABLE = 3
    ENRICHED = 4


def detect_state(corpus: DataFrame | None) -> State:
    """The state of a corpus table, told from its columns and flags in one aggregate."""
    if corpus is None or not {"id", "content"} <= set(corpus.columns):
        return State.EMPTY
    flag = lambda c: F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) if c in corpus.columns else F.lit(0)
    vec, fts = corpus.agg(flag("vec_indexed"), flag("fts_indexed")).head()
    return State.ENRICHED if vec and fts else State.SEARCHABLE if fts else State.INDEXED if vec else State.BASE


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")) > 0)


def valid_content(c: Column) -> Column:
    """Not empty after stripping and without NUL characters."""
    return not_blank(c) & ~F.contains(c, F.lit("\0"))


def metadata_map(c: Column) -> Column:
    """Metadata as a map of strings; what is no JSON object is empty."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def ingest(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    metadata: str | None = None,
    chunker: Chunker | None = None,
    embed: object | None = None,
    lemma: X.Lemma | None = None,
    dimension: int | None = None,
    searchable: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Corpus rows of documents: with a chunker a parent and its chunks, else the document alone.

    Only leaves carry lemmas, embeddings and flags: a chunked parent is stored but never searched. Chunks have the
    parent's metadata and the ids parent * CHUNK_SPAN + 1, 2, ... in order. Content that is blank or holds NUL is
    refused when the table is evaluated; with `strict` off it is taken as it is, and null or blank documents have no
    chunks, so that one such row does not fail a whole table. A dimension locks the length of embeddings. `embed` is a function of
    columns, batch() around a function of texts, or an Embedder; parents never reach it, nor `lemma`.
    """
    meta = F.col(metadata) if metadata else F.lit("{}")
    content = F.when(valid_content(F.col(text)), F.col(text)).otherwise(F.raise_error(F.lit("content is empty or holds NUL"))) if strict else F.col(text)
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), content.alias("content"), F.coalesce(meta, F.lit("{}")).alias("metadata"))
    if chunker is None:
        rows = base.select((F.col("doc") * CHUNK_SPAN).alias("id"), "content", "metadata", F.lit(None).cast("long").alias("chunk_of"), F.lit(True).alias("leaf"))
    else:
        cut = chunks(F.col("content"), chunker)
        parts = F.concat(F.array("content"), cut if strict else F.when(not_blank(F.col("content")), cut).otherwise(F.array().cast("array<string>")))
        rows = base.select("doc", "metadata", F.posexplode(parts).alias("place", "content"))
        own = F.col("doc") * CHUNK_SPAN
        rows = rows.select((own + F.col("place")).alias("id"), "content", "metadata", F.when(F.col("place") > 0, own).alias("chunk_of"), (F.col("place") > 0).alias("leaf"))
    vector = column_function(embed)(F.col("content")).cast("array<float>") if embed is not None else F.lit(None).cast("array<float>")
    if dimension is not None and embed is not None:
        vector = F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.lit(f"embedding is not of dimension {dimension}")))
    now = F.current_timestamp().alias("created_at")
    made = [X.lemmatize(F.col("content"), lemma).alias("content_lemmatized"), "metadata", "chunk_of", vector.alias("embedding")]
    own = rows.where("leaf").select("id", "content", *made, F.lit(embed is not None).alias("vec_indexed"), F.lit(searchable).alias("fts_indexed"), now)
    if chunker is None:
        return own
    none = [F.lit(None).cast("string").alias("content_lemmatized"), "metadata", "chunk_of", F.lit(None).cast("array<float>").alias("embedding")]
    return own.union(rows.where("not leaf").select("id", "content", *none, F.lit(False).alias("vec_indexed"), F.lit(False).alias("fts_indexed"), now))


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once beside the corpus and read back, so that two tables made of them agree."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def leaves(corpus: DataFrame) -> DataFrame:
    """Rows that search sees: chunks, and documents without chunks."""
    parents = corpus.where("chunk_of is not null").select(F.col("chunk_of").alias("id")).distinct()
    return corpus.join(parents, "id", "left_anti")


def chunk_tree(corpus: DataFrame) -> DataFrame:
    """(parent, chunk, content) of every chunk joined to its parent."""
    c, p = corpus.alias("c"), corpus.alias("p")
    return c.join(p, F.col("c.chunk_of") == F.col("p.id")).select(F.col("p.id").alias("parent"), F.col("c.id").alias("chunk"), F.col("c.content").alias("content"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return rows.join(done.select(key), key, "left_anti")


def backfill_vectors(corpus: DataFrame, embed: object, dimension: int | None = None) -> DataFrame:
    """The corpus with vectors for leaves that had none; only these rows reach the embedder."""
    if dimension is not None:
        check_dimension(corpus.where("embedding is not null"), dimension)
    open_ = corpus.where("not coalesce(vec_indexed, false)")
    parents = corpus.where("chunk_of is not null").select(F.col("chunk_of").alias("id")).distinct()
    made = column_function(embed)(F.col("content")).cast("array<float>")
    new = open_.join(parents, "id", "left_anti").select(corpus.columns).withColumn("embedding", made).withColumn("vec_indexed", F.lit(True))
    rest = open_.join(parents, "id", "left_semi").select(corpus.columns).withColumn("vec_indexed", F.lit(False))
    return corpus.where("coalesce(vec_indexed, false)").unionByName(new).unionByName(rest)


def backfill_text(corpus: DataFrame, lemma: Callable[[str, str], str] | None = None) -> DataFrame:
    """The corpus with lemmas for rows whose text is not indexed yet; only these reach `lemma`."""
    todo = corpus.where("not coalesce(fts_indexed, false)").withColumn("content_lemmatized", X.lemmatize(F.col("content"), lemma))
    return corpus.where("coalesce(fts_indexed, false)").unionByName(todo.withColumn("fts_indexed", F.lit(True)))


def backup(table: DataFrame, source: str, target: str) -> None:
    """A snapshot of a table at another place."""
    if source.rstrip("/") == target.rstrip("/"):
        raise SchemaError("a backup goes to another place than the table")
    table.write.mode("errorifexists").parquet(target)


def compact(table: DataFrame, target: str, files: int) -> None:
    """Rewrites a table as so many files."""
    table.repartition(files).write.mode("errorifexists").parquet(target)


def union_databases(tables: dict[str, DataFrame]) -> DataFrame:
    """All databases in one table with a column database; names are letters, digits, - and _."""
    out = None
    for name, df in sorted(tables.items()):
        if not NAME.match(name):
            raise SchemaError(f"database name {name!r} is not of letters, digits, - and _")
        part = df.withColumn("database", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise SchemaError("there are no databases")
    return out
