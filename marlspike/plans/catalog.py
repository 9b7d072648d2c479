"""Every query by name, and its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunkers as K
from ..functions import embedding as E
from ..functions import text as T
from ..functions import vectors as V
from ..operators import fts, fusion, graph, hybrid, telemetry, text_index, vector
from ..sources import corpus as C
from ..sources.scratch import shared_folder
from ..streaming import events as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_(spark: SparkSession, d: str) -> DataFrame:
    return C.read_table(spark, d, "documents")


def vecs_(spark: SparkSession, d: str) -> DataFrame:
    return C.read_table(spark, d, "embeddings")


def events_(spark: SparkSession, d: str) -> DataFrame:
    return C.read_table(spark, d, "events")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(vecs_(spark, d).where(F.col("vec_id") == vec_id).head()["embedding"])


# ---- SQL fragments shared by the oracles -------------------------------------------------------------------

TOKENS = r"list_transform(list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2), lambda x: lower(x))"
BASE = r"base AS (SELECT doc_id, lang, text, regexp_extract_all(lower(strip_accents(array_to_string(" + TOKENS.format(t="text") + r", ' '))), '[\p{L}\p{N}]+') AS terms FROM documents)"


def bm25(terms: list[str], name: str = "hits") -> str:
    """Common table expressions that end in `name`(doc_id, score) for all documents with all terms."""
    tf = ", ".join(f"len(list_filter(terms, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)"
    part = " + ".join(f"{idf(i)} * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    found = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"{BASE}, tfs AS (SELECT doc_id, lang, text, len(terms) AS dl, {tf} FROM base), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tfs), {name} AS (SELECT doc_id, {part} AS score FROM tfs, stats WHERE {found})"


Q0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
NEAR = Q0 + ", near AS (SELECT vec_id AS doc_id, list_distance(embedding::DOUBLE[], q) AS dist FROM embeddings, q)"
LISTS = bm25(["ndon"]) + ", fl AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM hits ORDER BY score DESC, doc_id LIMIT 50), " + NEAR + ", vl AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT doc_id, 1 / (1 + dist) AS score FROM near ORDER BY dist, doc_id LIMIT 50))"
MINMAX = "fm AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 0.5 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM fl), vm AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 0.5 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM vl)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def ranked(df: DataFrame, limit: int = 10) -> DataFrame:
    return rounded(hybrid.with_rank(df.orderBy(F.desc("score"), "doc_id").limit(limit)), "score")


# ---- text functions ----------------------------------------------------------------------------------------


@query("SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, " + TOKENS.format(t="text") + " AS t FROM documents)")
def tokenize_docs(spark, d):
    t = docs_(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("joined"))


LETTERS = r"left(regexp_replace({t}, '[^\p{{L}}]+', '', 'g'), 200)"


@query(r"SELECT doc_id, CASE WHEN length(l) = 0 THEN 'unknown' WHEN length(regexp_replace(l, '[^Ѐ-ԯ]+', '', 'g')) > 0.4 * length(l) THEN 'ru' ELSE 'en' END AS code FROM (SELECT doc_id, " + LETTERS.format(t="text") + " AS l FROM documents)")
def detect_lang_docs(spark, d):
    return docs_(spark, d).select("doc_id", T.detect_lang(F.col("text")).alias("code"))


@query("SELECT w, CASE WHEN regexp_matches(w, '[Ѐ-ԯ]') THEN 'ru' ELSE 'en' END AS code FROM (VALUES ('server'), ('сервер'), ('x1'), ('миx')) v(w)")
def word_lang(spark, d):
    return spark.sql("SELECT * FROM VALUES ('server'), ('сервер'), ('x1'), ('миx') AS v(w)").select("w", T.detect_word_lang(F.col("w")).alias("code"))


NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("SELECT doc_id, md5(" + NORMAL.format(t="text") + ") AS digest, length(" + NORMAL.format(t="text") + ") AS n FROM documents")
def normalize_text(spark, d):
    t = docs_(spark, d).select("doc_id", T.normalize(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|section|article|aside|header|footer|nav|main|h[1-6]|ul|ol|li|blockquote|pre|table|tr|thead|tbody|figure|figcaption|details|summary|hr|br)\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')"
_DECODED = f"replace(replace(replace(replace(replace({_PLAIN}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;', '&'), '&amp', '&')"


@query("SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, " + NORMAL.format(t=_DECODED) + " AS t FROM pages)")
def html_to_text_pages(spark, d):
    t = C.read_table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("SELECT doc_id, " + "md5(array_to_string(" + TOKENS.format(t="text") + ", ' ')) AS lemmas FROM documents")
def lemmatize_docs(spark, d):
    return docs_(spark, d).select("doc_id", F.md5(T.lemmatize(F.col("text"))).alias("lemmas"))


_SQLQ = "('cats AND dogs'), ('\"quoted\" (NEAR) x*'), ('--dash -lead a-b'), ('a:b ^c|d'), ('NOT x OR y')"


@query(f"""SELECT q, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(q, '"''()*^{{}}[]:+~|', '              '), '(^|\\s)-+', '\\1', 'g'), '\\bAND\\b', 'and', 'g'), '\\bNEAR\\b', 'near', 'g'), '\\bNOT\\b', 'not', 'g'), '\\bOR\\b', 'or', 'g')) AS clean FROM (VALUES {_SQLQ}) v(q)""")
def query_sanitize(spark, d):
    return spark.sql(f"SELECT * FROM VALUES {_SQLQ} AS v(q)").select("q", T.sanitize(F.col("q")).alias("clean"))


@query("SELECT doc_id, list_aggregate(list_transform(list_value('the', 'ndon', 'of'), lambda w: CASE WHEN list_contains(regexp_split_to_array(lower(text), '\\s+'), w) THEN 1 ELSE 0 END), 'sum') / 3.0::DOUBLE AS overlap FROM documents")
def word_overlap_docs(spark, d):
    return docs_(spark, d).select("doc_id", T.word_overlap("the ndon of", F.col("text")).alias("overlap"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_sort(list_filter([{'at': instr(lower(text), 'the'), 'a': 'article'}, {'at': instr(lower(text), 'tion'), 'a': 'noun'}, {'at': instr(lower(text), 'ing'), 'a': 'verb'}], lambda x: x['at'] > 0)), lambda x: x['a']), ','), '') AS actions FROM conversations""")
def action_tags(spark, d):
    t = T.extract_actions(F.col("text"), {"the": "article", "tion": "noun", "ing": "verb"})
    return C.read_table(spark, d, "conversations").select("conv_id", "turn", F.array_join(t, ",").alias("actions"))


# ---- full text ---------------------------------------------------------------------------------------------


@query("WITH " + BASE + ", s AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM base) GROUP BY term) SELECT term, df, round(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END, 6) AS idf FROM f, s")
def postings_stats(spark, d):
    return rounded(fts.term_statistics(docs_(spark, d)), "idf")


@query("WITH " + BASE + ", t AS (SELECT doc_id, unnest(terms) AS term FROM base), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS dl, max(tf) AS most FROM p GROUP BY doc_id")
def postings_lengths(spark, d):
    p = fts.postings(docs_(spark, d))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("dl"), F.max("tf").alias("most"))


def _top(terms: list[str], limit: int = 10) -> str:
    return f"WITH {bm25(terms)} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY hits.score DESC, doc_id) AS rank FROM hits ORDER BY hits.score DESC, doc_id LIMIT {limit}"


@query(_top(["ndon"]))
def fts_bm25_top10(spark, d):
    return ranked(fts.search(docs_(spark, d), "ndon", 10))


@query(_top(["ndon", "ntea"]))
def fts_bm25_and(spark, d):
    return ranked(fts.search(docs_(spark, d), "ndon ntea", 10))


@query(_top(["ndon", "ndon"]))
def fts_repeat_term(spark, d):
    return ranked(fts.search(docs_(spark, d), "ndon ndon", 10))


@query(_top(["the"], 20))
def fts_common_term(spark, d):
    return ranked(fts.search(docs_(spark, d), "THE", 20), 20)


@query("SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE), (3::BIGINT, 2.0::DOUBLE)) v(doc_id, n)")
def fts_phrase(spark, d):
    rows = spark.sql("SELECT * FROM VALUES (1L, 'foo bar baz'), (2L, 'bar foo'), (3L, 'x foo_bar y foo bar'), (4L, 'other'), (5L, 'more'), (6L, 'words'), (7L, 'here') AS t(doc_id, text)")
    hits = fts.search(rows, "foo_bar")
    p = rows.select("doc_id", fts._occurrences(T.index_terms(F.col("text")), ["foo", "bar"]).cast("double").alias("n"))
    return hits.join(p, "doc_id").select("doc_id", "n")


@query(f"WITH {bm25(['ndon'])} SELECT doc_id, round(score, 6) AS score, md5(text) AS digest FROM hits JOIN documents USING (doc_id) ORDER BY hits.score DESC, doc_id LIMIT 10")
def fts_only_search(spark, d):
    found = hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon", None, 10)
    return rounded(found.select("doc_id", "score", F.md5("text").alias("digest")), "score")


@query(_top(["ndon"]))
def search_punctuation(spark, d):
    return ranked(hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon?!", None, 10).select("doc_id", "score"))


@query(_top(["ndon", "ntea"]))
def search_one_letter(spark, d):
    return ranked(hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "a (ndon), b: ntea", None, 10).select("doc_id", "score"))


def _without_on(word: str, lang: str) -> str:
    return word[:-2] if word.endswith("on") and len(word) > 3 else word


_LEMMAS = "list_transform(" + TOKENS.format(t="text") + ", lambda x: CASE WHEN x LIKE '%on' AND length(x) > 3 THEN x[:-3] ELSE x END)"


@query(_top(["nd"]).replace(TOKENS.format(t="text"), _LEMMAS))
def search_lemmas(spark, d):
    docs = docs_(spark, d).withColumn("lemmas", T.lemmatize(F.col("text"), _without_on))
    return ranked(hybrid.hybrid_search(docs, vecs_(spark, d), "Ndon.", None, 10, terms="lemmas", lemma=_without_on).select("doc_id", "score"))


_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, d: str, again: bool = False) -> str:
    """The stored index of the documents of a folder, built once a session."""
    key = (spark.sparkContext.applicationId, d)
    if again or key not in _BUILT:
        _BUILT[key] = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
        text_index.add(docs_(spark, d), _BUILT[key])
    return _BUILT[key]


@query(f"WITH {BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(terms) AS term FROM base) GROUP BY term")
def fts_index_build(spark, d):
    p = text_index.postings(spark, _index(spark, d, again=True))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(_top(["ndon"]))
def fts_index_top10(spark, d):
    return ranked(text_index.search(spark, _index(spark, d), "ndon", 10))


@query(_top(["ndon", "ntea"]))
def fts_index_and(spark, d):
    return ranked(text_index.search(spark, _index(spark, d), "ndon ntea", 10))


@query(_top(["the"], 20))
def fts_index_common_term(spark, d):
    return ranked(text_index.search(spark, _index(spark, d), "THE", 20), 20)


# ---- vectors -----------------------------------------------------------------------------------------------


@query(f"WITH {NEAR} SELECT doc_id, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, doc_id) AS rank FROM near ORDER BY dist, doc_id LIMIT 10")
def vec_knn_exact(spark, d):
    near = vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 10)
    return rounded(near.withColumn("rank", F.row_number().over(Window.orderBy("dist", "doc_id"))), "dist")


@query(f"WITH {NEAR} SELECT doc_id, round(1 / (1 + dist), 6) AS score FROM near ORDER BY dist, doc_id LIMIT 20")
def vec_relevance(spark, d):
    return rounded(vector.relevance(vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 20)), "score")


@query(f"WITH {Q0} SELECT vec_id AS doc_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) + 0.0::DOUBLE AS dist FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 10")
def vec_knn_cosine(spark, d):
    return rounded(vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 10, "cos"), "dist").withColumn("dist", F.col("dist") + 0.0)


@query(f"WITH {Q0} SELECT vec_id AS doc_id, round(1 - list_inner_product(embedding::DOUBLE[], q), 6) + 0.0::DOUBLE AS dist FROM embeddings, q ORDER BY 1 - list_inner_product(embedding::DOUBLE[], q), vec_id LIMIT 10")
def vec_knn_inner(spark, d):
    return rounded(vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 10, "ip"), "dist").withColumn("dist", F.col("dist") + 0.0)


@query(f"WITH {NEAR.replace('list_distance(embedding::DOUBLE[], q)', 'list_distance(embedding::DOUBLE[], q) ** 2')} SELECT doc_id, round(dist, 6) AS dist FROM near ORDER BY dist, doc_id LIMIT 10")
def vec_knn_l2sq(spark, d):
    return rounded(vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 10, "l2sq"), "dist")


_BITS = "array_to_string(list_transform(list_reverse(embedding), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"


@query(f"SELECT vec_id, {_BITS} AS code FROM embeddings")
def bq_codes(spark, d):
    code = V.sign_code(F.col("embedding"), 64)[0]
    return vecs_(spark, d).select("vec_id", F.lpad(F.bin(code), 64, "0").alias("code"))


_HAM = "list_aggregate(list_transform(list_zip(embedding, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END), 'sum')"
_Q32 = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_PRE = f"{_Q32}, pre AS (SELECT vec_id AS doc_id, {_HAM}::INTEGER AS hamming, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS dist FROM embeddings, q ORDER BY hamming, doc_id LIMIT {{m}})"


@query(f"WITH {_PRE.format(m=50)} SELECT doc_id, hamming FROM pre")
def bq_hamming_top(spark, d):
    return vector.bq_prescore(vecs_(spark, d), query_vector(spark, d), 50).select("doc_id", "hamming")


@query(f"WITH {_PRE.format(m=100)} SELECT doc_id, round(dist, 6) AS dist FROM pre ORDER BY dist, doc_id LIMIT 5")
def bq_knn_rerank(spark, d):
    return rounded(vector.knn_bq(vecs_(spark, d), query_vector(spark, d), 5, 20), "dist")


@query(f"WITH {_PRE.format(m=40)}, a AS (SELECT doc_id FROM pre ORDER BY dist, doc_id LIMIT 10), e AS (SELECT vec_id AS doc_id FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10) SELECT count(*) / 10.0::DOUBLE AS recall FROM (SELECT * FROM a INTERSECT SELECT * FROM e)")
def bq_recall(spark, d):
    q = query_vector(spark, d)
    near, exact = vector.knn_bq(vecs_(spark, d), q, 10, 4), vector.knn_exact(vecs_(spark, d), q, 10)
    return near.select("doc_id").intersect(exact.select("doc_id")).agg((F.count("*") / 10.0).alias("recall"))


@query()
def ann_ivf_knn(spark, d):
    index, centres = vector.ivf_index(vecs_(spark, d), 8)
    return rounded(vector.knn_ivf(index, centres, query_vector(spark, d), 10, 8), "dist")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid, round(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS mean_norm_sq FROM embeddings")
def vector_validity(spark, d):
    v = vecs_(spark, d)
    return v.agg(F.count("*").alias("n"), F.count_if(V.valid_vector(F.col("embedding"), 64)).alias("valid"), F.round(F.avg(V.norm_sq(F.col("embedding"))), 6).alias("mean_norm_sq"))


@query("WITH c AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0) SELECT vec_id, label FROM c UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM c)")
def vector_upsert(spark, d):
    v = vecs_(spark, d)
    old = v.where("vec_id % 3 = 0").select("vec_id", "embedding", F.lit(-1).alias("label"), F.lit(1).alias("at"))
    new = v.where("vec_id % 3 = 0").select("vec_id", "embedding", (F.col("label") + 100).alias("label"), F.lit(2).alias("at"))
    more = v.where("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "embedding", "label", F.lit(1).alias("at"))
    return vector.upsert(v, old.union(new).union(more), "at").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_remove(spark, d):
    gone = C.read_table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return vector.remove(vecs_(spark, d), gone).select("vec_id", "label")


@query("SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def embedding_mean(spark, d):
    x = vecs_(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


# ---- fusion and hybrid search ------------------------------------------------------------------------------


def lists(spark, d):
    return fts.search(docs_(spark, d), "ndon", 50), vector.relevance(vector.knn_exact(vecs_(spark, d), query_vector(spark, d), 50))


@query(f"WITH {LISTS}, {MINMAX} SELECT doc_id, round(s, 6) AS score FROM fm")
def minmax_norm(spark, d):
    return rounded(fusion.min_max(lists(spark, d)[0]), "score")


_RSF = "SELECT doc_id, 0.5::DOUBLE * coalesce(fm.s, 0) + 0.5::DOUBLE * coalesce(vm.s, 0) AS score FROM fm FULL JOIN vm USING (doc_id)"


@query(f"WITH {LISTS}, {MINMAX} SELECT doc_id, round(score, 6) AS score FROM ({_RSF})")
def score_fusion(spark, d):
    return rounded(fusion.relative_score_fusion(*lists(spark, d), 0.5), "score")


@query(f"WITH {LISTS} SELECT doc_id, round(sum(s), 9) AS score FROM (SELECT doc_id, 0.7::DOUBLE / (60 + r + 1) AS s FROM fl UNION ALL SELECT doc_id, 0.3::DOUBLE / (60 + r + 1) FROM vl) GROUP BY doc_id")
def rrf_fusion(spark, d):
    return rounded(fusion.reciprocal_rank_fusion(*lists(spark, d), 0.3), "score", digits=9)


_ALPHA = "SELECT greatest(0, least(1, CASE WHEN nf >= 3 AND nv >= 3 AND sf > 0 AND sv > 0 AND sf / sv > 2 THEN {b} - 0.10::DOUBLE WHEN nf >= 3 AND nv >= 3 AND sf > 0 AND sv > 0 AND sf / sv < 0.5 THEN {b} + 0.10::DOUBLE ELSE {b} END)) AS alpha FROM (SELECT count(*) AS nf, stddev_pop(score) AS sf FROM fl), (SELECT count(*) AS nv, stddev_pop(score) AS sv FROM vl)"


@query(f"WITH {LISTS} SELECT round(alpha, 6) AS alpha FROM ({_ALPHA.format(b='0.6::DOUBLE')})")
def adaptive_alpha(spark, d):
    stats = fusion.list_statistics(*lists(spark, d))
    return stats.select(F.round(fusion.adaptive_alpha("what is ndon"), 6).alias("alpha"))


@query(f"WITH {LISTS}, {MINMAX}, a AS ({_ALPHA.format(b='0.5::DOUBLE')}), f AS (SELECT doc_id, (1 - alpha) * coalesce(fm.s, 0) + alpha * coalesce(vm.s, 0) AS score FROM fm FULL JOIN vm USING (doc_id), a) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM f WHERE score >= 0 ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)")
def hybrid_search_rsf(spark, d):
    found = hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon", query_vector(spark, d), 10)
    return rounded(found.select("doc_id", "score"), "score")


@query(ORACLES["hybrid_search_rsf"])
def hybrid_search_indexed(spark, d):
    found = hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon", query_vector(spark, d), 10, index=_index(spark, d))
    return rounded(found.select("doc_id", "score"), "score")


_FEW = LISTS.replace("FROM hits ORDER BY score DESC, doc_id LIMIT 50", "FROM hits ORDER BY score DESC, doc_id LIMIT 2")


@query(f"WITH {_FEW} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(s) AS score FROM (SELECT doc_id, 0.5::DOUBLE / (60 + r + 1) AS s FROM fl UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + r + 1) FROM vl) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)")
def hybrid_search_rrf(spark, d):
    found = hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon", query_vector(spark, d), 10, 0.5, fts_limit=2)
    return rounded(found.select("doc_id", "score"), "score")


@query(f"WITH {LISTS}, {MINMAX}, f AS ({_RSF}) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM f WHERE score >= 0.3 ORDER BY score DESC, doc_id LIMIT 20) JOIN documents USING (doc_id)")
def hybrid_min_score(spark, d):
    found = hybrid.hybrid_search(docs_(spark, d), vecs_(spark, d), "ndon", query_vector(spark, d), 20, 0.5, min_score=0.3)
    return rounded(found.select("doc_id", "score"), "score")


@query(f"WITH {LISTS}, {MINMAX}, f AS ({_RSF}), p AS (SELECT doc_id, score AS fused, text FROM (SELECT * FROM f ORDER BY score DESC, doc_id LIMIT 50) JOIN documents USING (doc_id)), s AS (SELECT doc_id, fused, list_aggregate(list_transform(['ndon', 'the'], lambda w: CASE WHEN list_contains(regexp_split_to_array(lower(text), '\\s+'), w) THEN 1 ELSE 0 END), 'sum') / 2.0::DOUBLE AS score FROM p) SELECT doc_id, score FROM s ORDER BY score DESC, fused DESC, doc_id LIMIT 10")
def rerank_word_overlap(spark, d):
    f, v = lists(spark, d)
    fused = fusion.relative_score_fusion(f, v, 0.5).orderBy(F.desc("score"), "doc_id").limit(50)
    pool = hybrid.hydrate(fused, docs_(spark, d))
    scored = pool.select("doc_id", F.col("score").alias("fused"), T.word_overlap("ndon the", F.col("text")).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("fused"), "doc_id").limit(10).select("doc_id", "score")


@query("WITH " + BASE + ", tfs AS (SELECT doc_id, lang, len(terms) AS dl, len(list_filter(terms, lambda x: x = 'ndon')) AS tf FROM base), st AS (SELECT lang, count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM tfs GROUP BY lang), h AS (SELECT lang AS database, doc_id, (CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score FROM tfs JOIN st USING (lang) WHERE tf > 0) SELECT database, doc_id, round(score, 6) AS score FROM h ORDER BY h.score DESC, database, doc_id LIMIT 10")
def federated_search(spark, d):
    return rounded(hybrid.federated_search(docs_(spark, d), "ndon", "lang", 10), "score")


# ---- chunks and ingestion ----------------------------------------------------------------------------------


def _chunked(spark, d, chunker):
    c = docs_(spark, d).select("doc_id", F.posexplode(K.chunks(F.col("text"), chunker)).alias("pos", "chunk"))
    return c.select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query()
def sentence_chunks(spark, d):
    return _chunked(spark, d, K.sentence_chunker())


@query()
def paragraph_chunks(spark, d):
    return _chunked(spark, d, K.paragraph_chunker())


@query()
def recursive_chunks(spark, d):
    return _chunked(spark, d, K.recursive_chunker())


@query()
def markdown_chunks(spark, d):
    return _chunked(spark, d, K.markdown_chunker())


@query()
def chunk_tree_counts(spark, d):
    corpus = C.ingest(docs_(spark, d), chunker=K.paragraph_chunker(), strict=False)
    return C.chunk_tree(corpus).groupBy("parent").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("SELECT doc_id, count(*) AS chunks, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def parent_chunk_join(spark, d):
    corpus = C.ingest(docs_(spark, d), chunker=lambda t: t.split("\n"), strict=False)
    tree = C.chunk_tree(corpus).groupBy((F.col("parent") / C.CHUNK_SPAN).cast("long").alias("doc_id"))
    return tree.agg(F.count("*").alias("chunks"), F.max(F.length("content")).cast("long").alias("longest"))


@query("SELECT doc_id AS id, md5(array_to_string(" + TOKENS.format(t="text") + ", ' ')) AS lemmas, length(text) AS n FROM documents")
def ingest_leaves(spark, d):
    rows = C.leaves(C.ingest(docs_(spark, d), embed=lambda t: V.length_vector(t, 8), dimension=8, strict=False))
    return rows.select((F.col("id") / C.CHUNK_SPAN).cast("long").alias("id"), F.md5("content_lemmatized").alias("lemmas"), F.col("embedding")[0].cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_backfill(spark, d):
    todo = C.pending(docs_(spark, d), C.read_table(spark, d, "labels"), "doc_id")
    return todo.select("doc_id", V.length_vector(F.col("text"), 4)[0].cast("long").alias("n"))


@query("SELECT count(*) AS rows, count(*) FILTER (length(text) > 0) AS valid FROM documents")
def content_validity(spark, d):
    return docs_(spark, d).agg(F.count("*").alias("rows"), F.count_if(C.valid_content(F.col("text"))).alias("valid"))


# ---- telemetry and SQL -------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def metadata_json(spark, d):
    return events_(spark, d).select("event_id", C.metadata_map(F.col("props"))["k"].alias("k"))


@query("SELECT split_part(event_type, '_', 1) AS sensor, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 2) AS mean FROM events GROUP BY 1 ORDER BY 1 LIMIT 20")
def sensor_stats(spark, d):
    return telemetry.sensor_stats(events_(spark, d))


@query("SELECT event_id, event_type FROM events WHERE event_type ILIKE 'C%'")
def like_filter(spark, d):
    return events_(spark, d).where(F.col("event_type").ilike("C%")).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3, 5, 8) AND event_type <> 'view'")
def in_filter(spark, d):
    return events_(spark, d).where(F.col("user_id").isin(1, 2, 3, 5, 8) & (F.col("event_type") != "view")).select("event_id", "user_id")


@query("SELECT count(*) AS n, count(props) AS with_props, count(*) FILTER (value > 50) AS high FROM events")
def count_all(spark, d):
    return events_(spark, d).agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.count_if(F.col("value") > 50).alias("high"))


_LIMITS = "('click', NULL, 90.0), ('error', 10.0, 60.0), ('view', 5.0, NULL)"


@query(f"SELECT event_id, event_type, value FROM events JOIN (VALUES {_LIMITS}) t(event_type, lo, hi) USING (event_type) WHERE value < lo OR value > hi")
def threshold_alerts(spark, d):
    limits = spark.sql(f"SELECT event_type, CAST(lo AS DOUBLE) lo, CAST(hi AS DOUBLE) hi FROM VALUES {_LIMITS} AS t(event_type, lo, hi)")
    return telemetry.threshold_alerts(events_(spark, d), limits).select("event_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_seen(spark, d):
    return telemetry.first_seen(events_(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE value > 40),
 r AS (SELECT event_id, event_type, i, event_id AS last, true AS emit FROM a WHERE i = 1
  UNION ALL SELECT a.event_id, a.event_type, a.i, CASE WHEN a.event_id - r.last >= 25 THEN a.event_id ELSE r.last END, a.event_id - r.last >= 25 FROM r JOIN a ON a.event_type = r.event_type AND a.i = r.i + 1)
 SELECT event_id, event_type FROM r WHERE emit""")
def alert_cooldown(spark, d):
    alerts = events_(spark, d).where("value > 40").select("event_id", "event_type")
    return telemetry.alert_cooldown(alerts, "event_type", "event_id", "event_id", 25)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    out = S.windowed(events_(spark, d))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    return S.sessions(events_(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_PASS = "SELECT n_name, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3"


@query(_PASS)
def sql_join_group(spark, d):
    C.register(spark, d, ["orders", "customer", "nation"])
    return spark.sql(_PASS)


_WINDOW = "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS running FROM orders"


@query(_WINDOW.replace("sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)"))
def sql_window(spark, d):
    C.register(spark, d, ["orders"])
    return spark.sql(_WINDOW).withColumn("running", F.round("running", 2))


_SETS = "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90 UNION SELECT -1"


@query(f"SELECT user_id::BIGINT AS user_id FROM ({_SETS})")
def sql_set_operations(spark, d):
    C.register(spark, d, ["events"])
    return spark.sql(_SETS).select(F.col("user_id").cast("long").alias("user_id"))


_PAGE = "SELECT event_id, CASE WHEN value BETWEEN 20 AND 40 THEN 'mid' WHEN value > 40 THEN 'high' ELSE 'low' END AS band FROM events ORDER BY event_id LIMIT 50 OFFSET 100"


@query(_PAGE)
def sql_limit_offset(spark, d):
    C.register(spark, d, ["events"])
    return spark.sql(_PAGE)


_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(_ROLLUP)
def sql_rollup(spark, d):
    C.register(spark, d, ["lineitem"])
    return spark.sql(_ROLLUP)


@query("SELECT e.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts) AS last_view FROM events e WHERE e.event_type = 'purchase'")
def as_of_view(spark, d):
    e = events_(spark, d).where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_view", seen).where("event_type = 'purchase'").select("event_id", "last_view")


_CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


@query(_CUBE)
def sql_cube(spark, d):
    C.register(spark, d, ["lineitem"])
    return spark.sql(_CUBE)


_GROUPINGS = "SELECT l_returnflag, l_linenumber, grouping(l_linenumber) AS whole, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), ())"


@query(_GROUPINGS.replace("grouping(l_linenumber)", "grouping(l_linenumber)::TINYINT"))
def sql_grouping_sets(spark, d):
    C.register(spark, d, ["lineitem"])
    return spark.sql(_GROUPINGS)


_OUTER = "SELECT s.s_nationkey AS nation_s, c.c_nationkey AS nation_c, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) s FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1) c ON s.s_nationkey = c.c_nationkey"


@query(_OUTER)
def sql_outer_join(spark, d):
    C.register(spark, d, ["supplier", "customer"])
    return spark.sql(_OUTER)


_CROSS = "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_name < b.r_name"


@query(_CROSS)
def sql_cross_join(spark, d):
    C.register(spark, d, ["region"])
    return spark.sql(_CROSS)


@query("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region)")
def sql_natural_join(spark, d):
    C.register(spark, d, ["nation", "region"])
    return spark.sql("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region)")


@query("SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users, coalesce(sum(value) FILTER (value > 1e9), 0.0::DOUBLE) AS total FROM events WHERE user_id < 30 GROUP BY event_type")
def group_concat_total(spark, d):
    users = F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("users")
    total = F.coalesce(F.sum(F.when(F.col("value") > 1e9, F.col("value"))), F.lit(0.0)).alias("total")
    return events_(spark, d).where("user_id < 30").groupBy("event_type").agg(users, total)


@query("SELECT true AS distinct_is_near, true AS median_is_near")
def approximate_aggregates(spark, d):
    e = events_(spark, d)
    one = e.agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.percentile("value", 0.5).alias("x"), F.stddev_pop("value").alias("sd"))
    return one.select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("distinct_is_near"), (F.abs(F.col("m") - F.col("x")) <= 0.05 * F.col("sd")).alias("median_is_near"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def blob_length(spark, d):
    return docs_(spark, d).select("doc_id", F.octet_length(F.col("text").cast("binary")).cast("long").alias("bytes"))


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id IN (3, 5, 8, 13)")
def vector_fetch(spark, d):
    return rounded(vector.fetch(vecs_(spark, d), [3, 5, 8, 13]).select("vec_id", F.size("embedding").cast("long").alias("n"), F.col("embedding")[0].cast("double").alias("x")), "x")


@query("SELECT 10::BIGINT AS n, 10::BIGINT AS n_distinct, 10::BIGINT AS known")
def random_sample(spark, d):
    some = docs_(spark, d).orderBy(F.rand()).limit(10).select("doc_id")
    known = docs_(spark, d).select("doc_id", F.lit(1).alias("k"))
    return some.join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"), F.count("k").alias("known"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS days, strftime(o_orderdate::DATE, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def date_scalars(spark, d):
    o = C.read_table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.datediff(day, F.lit("1990-01-01").cast("date")).alias("days"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_EXISTS = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"


@query(_EXISTS)
def sql_exists(spark, d):
    C.register(spark, d, ["customer", "orders"])
    return spark.sql(_EXISTS)


@query("SELECT doc_id, [length(text)::FLOAT, (length(text) - length(replace(text, ' ', '')))::FLOAT]::VARCHAR AS v FROM documents")
def embed_in_batches(spark, d):
    embed = E.column_function(E.batch(lambda texts: [[len(t), t.count(" ")] for t in texts]))
    v = F.concat(F.lit("["), F.array_join(F.transform(embed(F.col("text")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return docs_(spark, d).select("doc_id", v.alias("v"))


# ---- graph -------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), g AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM e QUALIFY rank <= 8)"


@query(f"WITH {_EDGES} SELECT src, dst, rank FROM g")
def knn_graph_edges(spark, d):
    return graph.knn_edges(vecs_(spark, d), 8).select("src", "dst", "rank")


@query(f"WITH {_EDGES}, d AS (SELECT vec_id, count(dst) AS d FROM embeddings LEFT JOIN g ON dst = vec_id GROUP BY vec_id) SELECT count(*) AS nodes, sum(d)::BIGINT AS edges, avg(d) AS avg_degree, min(d) AS min_degree, max(d) AS max_degree, count(*) FILTER (d = 0) AS orphans FROM d")
def graph_stats(spark, d):
    return graph.graph_stats(graph.knn_edges(vecs_(spark, d), 8), vecs_(spark, d))


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS degree FROM g GROUP BY dst ORDER BY degree DESC, node LIMIT 10")
def top_hubs(spark, d):
    return graph.top_hubs(graph.knn_edges(vecs_(spark, d), 8))


@query(f"WITH {_EDGES} SELECT src AS node, array_to_string(list(dst ORDER BY rank), ',') AS neighbours FROM g WHERE src = 7 GROUP BY src")
def node_info(spark, d):
    info = graph.node_info(graph.knn_edges(vecs_(spark, d), 8, sources=[7]), 7)
    return info.select("node", F.array_join("neighbours", ",").alias("neighbours"))
