import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.engine import Engine
from marlspike.errors import EmbeddingError
from marlspike.functions import embedding as E
from marlspike.functions import text as T
from marlspike.operators import fts, graph, hybrid, text_index
from marlspike.sources import corpus as C

ROWS = [(1, "foo bar baz"), (2, "bar foo"), (3, "x foo_bar y foo bar"), (4, "Other, words"), (5, None), (6, ""), (7, "bar bar bar"), (8, "here")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    text_index.add(docs.where("doc_id < 4"), path, buckets=5)
    text_index.add(docs.where("doc_id >= 4"), path, buckets=5)
    return path, docs


@pytest.mark.parametrize("query", ["foo", "BAR", "foo bar", "bar bar", "foo_bar", "foo_bar here", "nothing", "foo nothing", "", "a?b"])
def test_stored_index_ranks_as_a_scan(spark, index, query):
    path, docs = index
    want = [(r.doc_id, round(r.score, 9)) for r in fts.search(docs, query, 10).collect()]
    assert [(r.doc_id, round(r.score, 9)) for r in text_index.search(spark, path, query, 10).collect()] == want
    assert text_index.search(spark, path, query, 0).count() == 0


def test_stored_index_reads_the_folders_of_its_terms(spark, index):
    plan = text_index.search(spark, index[0], "foo", 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,foo)" in plan
    rows = text_index.postings(spark, index[0])
    assert rows.where("term = 'bar' and doc_id = 7").head().positions == [0, 1, 2] and rows.where("doc_id in (5, 6)").count() == 0


def test_queries_are_cut_into_words(spark):
    docs = spark.createDataFrame([(1, "a cat stored rows"), (2, "other")], "doc_id long, text string")
    vecs = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    for query in ("stored", "stored?", "a cat", "rows, stored", "(cat)", "cat -"):
        assert [r.doc_id for r in hybrid.hybrid_search(docs, vecs, query, None).collect()] == [1], query
        assert [r.doc_id for r in hybrid.federated_search(docs.withColumn("db", F.lit("x")), query, "db").collect()] == [1], query
    assert hybrid.hybrid_search(docs, vecs, "?", None).count() == 0


def test_engine_searches_lemmas_and_keeps_its_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "dogs run"), (2, "cats sleep")], "doc_id long, text string")
    e = Engine(spark, str(tmp_path / "db"), lemma=lambda word, lang: word[:-1] if word.endswith("s") else word)
    e.ingest(docs)
    assert [r.text for r in e.search("Dog?").collect()] == ["dogs run"] and [r.text for r in e.search("cats").collect()] == ["cats sleep"]
    e.index_text(buckets=3)
    e.ingest(spark.createDataFrame([(3, "a dog sleeps")], "doc_id long, text string"))
    assert {r.text for r in e.search("dogs").collect()} == {"dogs run", "a dog sleeps"}
    assert e.tables() == ["documents", "text_index"] and e.diagnostics()["text_index"]
    told = []
    e.backup(str(tmp_path / "copy"), lambda left, of: told.append((left, of)))
    assert told == [(0, 1)]


def test_engine_small_actions(spark, tmp_path):
    heard = []
    e = Engine(spark, str(tmp_path / "db"), embed=E.batch(lambda texts: [[float(len(t)), 1.0] for t in texts]), error_callback=heard.append)
    e.ingest(spark.createDataFrame([(i, "w" * i) for i in range(1, 6)], "doc_id long, text string"), dimension=2)
    ids = [r.id for r in e.table().collect()]
    assert sorted(r.embedding[0] for r in e.vectors(ids[:2]).collect()) == sorted(r.embedding[0] for r in e.table().collect() if r.id in ids[:2])
    assert e.search("www").orderBy(F.desc("score")).head().text == "www"
    assert e.sample(3, seed=1).count() == 3 and e.sample(99).count() == 5
    e.register_function("twice", lambda s: s * 2)
    assert e.fetch_one("SELECT twice('ab') AS x").x == "abab"
    e.write_many("notes", [(1, "x"), (2, "y")], "id long, note string")
    assert e.table("notes").count() == 2
    with pytest.raises(Exception, match="content is empty"):
        e.ingest(spark.createDataFrame([(9, " ")], "doc_id long, text string"))
    assert len(heard) == 1


def test_embedders(spark):
    class Both:
        def embed_documents(self, texts):
            return [[1.0, len(t)] for t in texts]

        def embed_query(self, text):
            return [2.0, len(text)]

    class Half:
        def embed_query(self, text):
            return [1.0]

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.v for r in rows.select("id", E.column_function(Both())(F.col("t")).alias("v")).collect()}
    assert got == {1: [1.0, 2.0], 2: None, 3: [1.0, 0.0]} and E.query_vector(Both(), "abc") == [2.0, 3.0]
    for bad in (Half(), 7):
        with pytest.raises(TypeError):
            E.column_function(bad)
    with pytest.raises(TypeError):
        E.query_vector(lambda c: c, "x")
    for wrong in ([], [[1.0], [2.0]], [[]], [None], [[float("nan")]]):
        with pytest.raises(EmbeddingError):
            E.checked(wrong, 1)
    with pytest.raises(EmbeddingError):
        E.checked([[1.0], [1.0, 2.0]], 2)
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        rows.where("id = 1").select(E.column_function(E.batch(lambda texts: []))(F.col("t"))).collect()


def test_backfill_embeds_only_what_is_missing(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(texts):
        seen.add(len(texts))
        return [[1.0, 2.0] for _ in texts]

    rows = C.ingest(spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string"))
    done = rows.where("id < 3 * 1048576").withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).withColumn("vec_indexed", F.lit(True))
    out = C.backfill_vectors(done.unionByName(rows.where("id >= 3 * 1048576")), E.batch(count)).collect()
    assert len(out) == 6 and all(r.vec_indexed and r.embedding == [1.0, 2.0] for r in out) and seen.value == 3


def test_lemmatizer_chain():
    def fails(word, lang):
        raise ValueError(word)

    chain = T.lemmatizer_chain(fails, lambda w, lang: {"mice": "mouse"}.get(w), *T.installed_lemmatizers())
    assert chain("mice", "en") == "mouse" and T.lemmatizer_chain(fails)("word", "en") == "word"
    assert T.lemmatize_query("Mice AND x", chain) == "mouse AND"


def test_neighbour_graph_in_blocks_is_exact(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    vecs = vecs.unionByName(spark.createDataFrame([(9001, None, 0), (9002, [float("nan")] * 64, 0), (9003, [1.0], 0)], vecs.schema))
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in vecs.collect() if r.embedding and len(r.embedding) == 64 and r.vec_id != 9002}
    want = set()
    for i, a in rows.items():
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in rows.items() if j != i)[:5]
        want |= {(i, j, n) for n, (_, j) in enumerate(near, 1)}
    got = {(r.src, r.dst, r["rank"]) for r in graph.knn_edges(vecs, 5, rows=50).collect()}
    assert got == want


def test_neighbour_graph_shuffles_no_vectors_twice(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    edges = graph.knn_edges(vecs, 5, rows=10)
    plan = edges._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "Generate" not in plan and "MapInArrow" in plan
    got = edges.collect()
    few = graph.knn_edges(vecs, 5, rows=10, sources=[3, 7]).collect()
    assert sorted(map(tuple, few)) == sorted(tuple(r) for r in got if r.src in (3, 7)) and len(few) == 10


def test_neighbour_graph_of_equal_vectors_and_repeated_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(0, [5.0, 5.0]), (41, [5.0, 5.0])]
    edges = graph.knn_edges(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, rows=7)
    got = {}
    for r in edges.orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, r.dist))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and got[9] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert got[41][0] == (0, 0.0) and len(got[41]) == 3


def test_stored_index_packs_postings_before_they_travel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "GROUP", 40)  # several salts
    rows = [(i, "the " * (i % 3 + 1) + f"word{i % 7} end") for i in range(60)] + [(5, "the end"), (5, "the end"), (None, "the null"), (90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text_index.add(docs, str(tmp_path / "index"), buckets=3)
    want = {}
    for i, t in rows:
        words = (t or "").split()
        for at, w in enumerate(words):
            want.setdefault((w, i, len(words)), []).append(at)
    got = text_index.postings(spark, str(tmp_path / "index")).collect()
    assert len(got) == len(want)
    assert {(r.term, r.doc_id, r.dl): (r.tf, r.positions) for r in got} == {k: (len(v), sorted(v)) for k, v in want.items()}
    assert {r.bucket for r in got if r.term == "the"} == {spark.range(1).select(text_index.bucket_of(F.lit("the"), 3)).head()[0]}
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()), pa.array([["a", "b"]] * 3), pa.array([[0, 1]] * 3, pa.list_(pa.int32()))], names=["doc_id", "salt", "terms", "buckets"])
    assert [b.num_rows for b in text_index.packed([batch])] == [2]  # six postings of two buckets


def test_postings_of_documents_shuffle_texts_only(spark, monkeypatch):
    monkeypatch.setattr(fts, "TASK_CHARS", 5)
    docs = spark.createDataFrame([(1, "foo bar foo"), (2, "bar"), (1, "foo"), (3, None), (4, "")], "doc_id long, text string")
    rows = fts.postings(docs)
    assert {(r.doc_id, r.term): (r.tf, r.positions) for r in rows.collect()} == {(1, "foo"): (3, [0, 0, 2]), (1, "bar"): (1, [1]), (2, "bar"): (1, [0])}
    plan = rows.groupBy("doc_id").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == 1
