import asyncio

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspike.engine import AsyncEngine, Engine, Manager
from marlspike.errors import DimensionError, EngineClosedError, SchemaError
from marlspike.functions import vectors as V
from marlspike.functions.chunkers import paragraph_chunker
from marlspike.plans import catalog
from marlspike.sources import corpus as C
from marlspike.streaming import events as S

TEXTS = [(1, "The database stores rows"), (2, "A server answers requests"), (3, "The sensor reads values")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def embed(t):
    return V.length_vector(t, 4)


def test_ingest_search_and_lock(spark, docs, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        assert e.state() == C.State.EMPTY
        with pytest.raises(SchemaError):
            e.ingest(docs, embed)
        e.ingest(docs, embed, 4)
        assert e.state() == C.State.ENRICHED and e.verify()
        assert [r.text for r in e.search("sensor").collect()] == ["The sensor reads values"]
        assert e.search("the", [24.0] * 4, limit=2).count() == 2
        with pytest.raises(DimensionError):
            e.ingest(docs, lambda t: V.length_vector(t, 8), 8)
        with pytest.raises(DimensionError):
            e.search("x", [1.0])
        assert e.fetch_one("SELECT count(*) AS n FROM documents WHERE id > ?", [0]).n == 3
        assert len(list(e.reader("SELECT id FROM documents"))) == 3
        e.backup(str(tmp_path / "copy"))
        assert spark.read.parquet(str(tmp_path / "copy" / "documents")).count() == 3
        e.vacuum(str(tmp_path / "small"))
        assert e.diagnostics()["tables"] == ["documents"]
        with pytest.raises(SchemaError):
            C.backup(e.table(), "x/", "x")
    with pytest.raises(EngineClosedError):
        e.table()


def test_chunk_tree(spark):
    text = "\n\n".join(f"Paragraph {i} " + "words " * 20 for i in range(3))
    rows = C.ingest(spark.createDataFrame([(7, text)], "doc_id long, text string"), chunker=paragraph_chunker(max_size=150)).cache()
    assert rows.count() == 4 and rows.where("chunk_of is null").head().content_lemmatized is None
    assert C.leaves(rows).count() == 3 and C.chunk_tree(rows).select("parent").distinct().count() == 1


def test_content_is_checked(spark):
    for bad in ("   ", "a\0b", None):
        with pytest.raises(Exception, match="content is empty"):
            C.ingest(spark.createDataFrame([(1, bad)], "doc_id long, text string")).select("content").collect()


def test_backfills(spark, docs):
    rows = C.ingest(docs, searchable=False)
    done = C.backfill_text(C.backfill_vectors(rows, embed, 4))
    assert done.where("vec_indexed and fts_indexed and size(embedding) = 4 and content_lemmatized is not null").count() == 3
    calls = C.backfill_vectors(done, lambda t: F.raise_error(F.lit("again")).cast("array<float>"))
    assert calls.where("embedding is null").count() == 0
    assert C.pending(docs, docs.where("doc_id = 1"), "doc_id").count() == 2


def test_metadata(spark):
    df = spark.sql("SELECT * FROM VALUES ('{\"a\": 1}'), ('nonsense'), (NULL) AS t(m)").select(C.metadata_map(F.col("m")))
    assert sorted((r[0] for r in df.collect()), key=str) == sorted([{"a": "1"}, {}, {}], key=str)


def test_manager_and_federation(spark, docs, tmp_path):
    m = Manager(spark, str(tmp_path))
    for name in ("a", "b"):
        m[name].ingest(docs)
    m.get_or_create("empty")
    got = m.search_all("sensor").collect()
    assert sorted(r.database for r in got) == ["a", "b"] and m.names == ["a", "b", "empty"]
    m.drop("a", delete=True)
    assert not (tmp_path / "a").exists()
    with pytest.raises(SchemaError):
        m.get_or_create("../x")


def test_async(spark, docs, tmp_path):
    e = AsyncEngine(Engine(spark, str(tmp_path / "db")))

    async def run():
        await e.ingest(docs)
        return await asyncio.gather(e.fetch_all("SELECT id FROM documents"), e.fetch_one("SELECT count(*) AS n FROM documents"))

    rows, one = asyncio.run(run())
    assert len(rows) == one.n == 3


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), 1)
    q = S.windowed(stream, "1 day", late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, S.windowed(events, "1 day").collect()))
    got = []
    S.ingest_stream(stream, lambda df, i: got.append(df.count()), str(tmp_path / "c")).awaitTermination(120)
    assert sum(got) == events.count()


def test_stream_cooldown(spark, tmp_path):
    spark.createDataFrame([("a", t) for t in (0, 5, 10, 11, 25)], "k string, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.cooldown(S.read_stream(spark, str(tmp_path / "in")), "k", "t", 10).writeStream.format("memory").queryName("cool").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.t for r in spark.table("cool").collect()) == [0, 10, 25]


@pytest.mark.parametrize("name", ["ingest_leaves", "parent_chunk_join"])
def test_rows_without_content_do_not_fail_a_table(spark, tmp_path, name):
    rows = [(1, "one line\nand another"), (2, None), (3, ""), (4, "   "), (5, "a\0b c"), (6, "\n \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(db.execute(catalog.ORACLES[name]).fetchall(), key=str)


def test_chunk_counts_pass_over_rows_without_content(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, None), (3, " "), (4, "a\0b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.parent // C.CHUNK_SPAN: (r.chunks, r.chars) for r in catalog.QUERIES["chunk_tree_counts"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 3), 4: (1, 3)}
