import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlspike.errors import DimensionError, VectorBackendError
from marlspike.functions import vectors as V
from marlspike.operators import fts, fusion, graph, hybrid, telemetry, vector

WORDS = [(1, "python program language"), (2, "java enterprise develop"), (3, "python web framework flask"), (4, "ruby gem web"), (5, "café du monde")]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scored(spark, rows):
    return table(spark, [(i, float(s)) for i, s in rows], "doc_id long, score double")


def as_dict(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_full_text_finds_documents_with_all_terms(spark):
    docs = table(spark, WORDS, "doc_id long, text string")
    assert set(as_dict(fts.search(docs, "python"))) == {1, 3}
    assert set(as_dict(fts.search(docs, "python web"))) == {3}
    assert set(as_dict(fts.search(docs, "CAFE"))) == {5}
    assert as_dict(fts.search(docs, "a.b")) == {} and as_dict(fts.search(docs, "")) == {} and as_dict(fts.search(docs, "python", 0)) == {}


@pytest.mark.parametrize("query", ["python", "web", "python web", "web web", "python flask"])
def test_bm25_equals_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", WORDS)
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (query,))}
    got = as_dict(fts.search(table(spark, WORDS, "doc_id long, text string"), query))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_min_max(spark):
    assert as_dict(fusion.min_max(scored(spark, [(1, 10), (2, 20), (3, 30)]))) == {1: 0, 2: 0.5, 3: 1}
    assert as_dict(fusion.min_max(scored(spark, [(1, 5), (2, 5)]))) == {1: 0.5, 2: 0.5}
    assert as_dict(fusion.min_max(scored(spark, []).where("false"))) == {}


def test_relative_score_fusion(spark):
    f, v = scored(spark, [(1, 10), (2, 5)]), scored(spark, [(1, 0.8), (2, 0.6)])
    assert as_dict(fusion.relative_score_fusion(f, v, 0.0)) == {1: 1.0, 2: 0.0}
    v = scored(spark, [(2, 0.9), (3, 0.5)])
    assert as_dict(fusion.relative_score_fusion(f, v, 1.0)) == {1: 0.0, 2: 1.0, 3: 0.0}


def test_reciprocal_rank_fusion(spark):
    got = as_dict(fusion.reciprocal_rank_fusion(scored(spark, [(1, 10), (2, 5)]), scored(spark, [(2, 0.9), (3, 0.5)])))
    assert max(got, key=got.get) == 2 and got[1] == pytest.approx(0.5 / 61) and got[2] == pytest.approx(0.5 / 62 + 0.5 / 61)


def test_adaptive_alpha(spark):
    def alpha(query, f, v):
        stats = fusion.list_statistics(scored(spark, f) if f else scored(spark, [(0, 0)]).where("false"), scored(spark, v) if v else scored(spark, [(0, 0)]).where("false"))
        return stats.select(fusion.adaptive_alpha(query)).head()[0]

    f, v = [(i, 10 - i) for i in range(5)], [(i, 0.9 - 0.1 * i) for i in range(5)]
    assert alpha("plain", f, v) == pytest.approx(0.4)
    assert alpha("getUserName", f, v) == pytest.approx(0.25)
    assert alpha("what is it", v, f) == pytest.approx(0.7)
    assert alpha("plain", [(1, 1)], v) == pytest.approx(0.8) and alpha("plain", f, []) == pytest.approx(0.2)


def test_fuse_chooses_by_list_lengths(spark):
    f, v = scored(spark, [(1, 3), (2, 2)]), scored(spark, [(2, 0.9), (3, 0.5), (4, 0.4)])
    got = as_dict(fusion.fuse(f, v, "q", 0.5))
    assert got[2] == pytest.approx(0.5 / 62 + 0.5 / 61)
    none = f.where("false")
    assert as_dict(fusion.fuse(none, v, "q", 0.5)) == as_dict(fusion.min_max(v))
    assert as_dict(fusion.fuse(f, none, "q", 0.5)) == as_dict(fusion.min_max(f))


VECS = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.7, 0.7, 0.0, 0.0])]


def test_exact_search_and_validity(spark):
    vecs = table(spark, [*VECS, (4, [float("nan")] * 4), (5, [1.0]), (6, None), (7, [float("inf"), 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.doc_id for r in vector.knn_exact(vecs, [1.0, 0, 0, 0], 9).collect()] == [1, 3, 2]
    assert vector.knn_exact(vecs, [], 3).count() == 0 and vector.knn_exact(vecs, [float("nan")], 3).count() == 0
    rel = as_dict(vector.relevance(vector.knn_exact(vecs, [1.0, 0, 0, 0], 9)))
    assert rel[1] == 1.0 and rel[2] == pytest.approx(1 / (1 + math.sqrt(2)))
    with pytest.raises(DimensionError):
        vector.check_dimension(vecs, 4)


def test_binary_quantised_equals_exact_when_it_keeps_all(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = list(vecs.where("vec_id = 3").head().embedding)
    exact = [tuple(r) for r in vector.knn_exact(vecs, q, 10).collect()]
    assert [tuple(r) for r in vector.knn_bq(vecs, q, 10, 100).collect()] == exact
    near = {r.doc_id for r in vector.knn_bq(vecs, q, 10, 20).collect()}
    assert len(near & {i for i, _ in exact}) >= 5


def test_cell_index_with_all_probes_is_exact(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = list(vecs.where("vec_id = 3").head().embedding)
    index, centres = vector.ivf_index(vecs, 4)
    assert [r.doc_id for r in vector.knn_ivf(index, centres, q, 10, 4).collect()] == [r.doc_id for r in vector.knn_exact(vecs, q, 10).collect()]


def test_sign_codes_of_long_vectors(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(130)]
    code = spark.range(1).select(V.sign_code(vector.literal(v), 130)).head()[0]
    assert [(code[i // 64] >> (i % 64)) & 1 for i in range(130)] == [int(x > 0) for x in v]


def test_strategies():
    assert vector.strategy(None, 10) is vector.knn_exact and vector.strategy("flat") is vector.knn_bq
    assert vector.strategy(None, 10**9) is not vector.knn_exact
    with pytest.raises(VectorBackendError):
        vector.strategy("nope")


def test_upsert_and_remove(spark):
    vecs = table(spark, VECS, "vec_id long, embedding array<double>")
    new = table(spark, [(1, [9.0], 1), (1, [8.0], 2), (5, [7.0], 1)], "vec_id long, embedding array<double>, at int")
    assert {r.vec_id: r.embedding for r in vector.upsert(vecs, new, "at").collect()} == {1: [8.0], 2: VECS[1][1], 3: VECS[2][1], 5: [7.0]}
    assert {r.vec_id for r in vector.remove(vecs, table(spark, [(2,)], "vec_id long")).collect()} == {1, 3}


def test_hybrid_search_and_rerank(spark):
    docs = table(spark, WORDS, "doc_id long, text string")
    vecs = table(spark, [(i, [float(i == k) for k in range(1, 6)]) for i in range(1, 6)], "vec_id long, embedding array<double>")
    q = [0.0, 0.0, 1.0, 0.0, 0.0]
    top = hybrid.hybrid_search(docs, vecs, "python", q, 3, 0.7).orderBy(F.desc("score")).collect()
    assert top[0].doc_id == 3 and len(top) == 3
    flipped = hybrid.hybrid_search(docs, vecs, "python", q, 2, reranker=lambda query, texts: [float("java" in t) for t in texts]).collect()
    assert flipped[0].doc_id == 2
    nan = hybrid.hybrid_search(docs, vecs, "python", q, 5, reranker=lambda query, texts: [float("nan") if "flask" in t else 1.0 for t in texts]).collect()
    assert nan[-1].doc_id == 3
    broken = hybrid.hybrid_search(docs, vecs, "python", q, 2, 0.7, reranker=lambda query, texts: [1.0]).collect()
    assert broken[0].doc_id == 3
    assert hybrid.hybrid_search(docs, vecs, "python", q, 0).count() == 0
    assert {r.doc_id for r in hybrid.hybrid_search(docs, vecs, "python", None).collect()} == {1, 3}
    assert hybrid.hybrid_search(docs, vecs, "python", q, 5, min_score=2.0).count() == 0


def test_graph(spark):
    vecs = table(spark, [(i, [float(i), 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    edges = graph.knn_edges(vecs, 2)
    assert {(r.src, r.dst) for r in edges.collect() if r.src == 0} == {(0, 1), (0, 2)}
    stats = graph.graph_stats(edges, vecs).head()
    assert (stats.nodes, stats.edges) == (6, 12)
    trace = graph.search_trace(edges, vecs, [5.0, 0.0], 0)
    assert trace[0][:2] == ("entry", 0) and trace[-1][:2] == ("found", 5)


def test_cooldown_and_thresholds(spark):
    assert list(telemetry.cooled([0, 5, 10, 11, 25], 10)) == [0, 2, 4]
    alerts = table(spark, [("a", t, t) for t in (0, 5, 10, 11, 25)] + [("b", 3, 30)], "k string, t long, id long")
    got = sorted((r.k, r.t) for r in telemetry.alert_cooldown(alerts, "k", "t", "id", 10).collect())
    assert got == [("a", 0), ("a", 10), ("a", 25), ("b", 3)]
    events = table(spark, [("x", 1.0), ("x", 9.0), ("y", 9.0)], "event_type string, value double")
    limits = table(spark, [("x", None, 5.0)], "event_type string, lo double, hi double")
    assert [r.value for r in telemetry.threshold_alerts(events, limits).collect()] == [9.0]
