"""Token counts, SentencePiece, language ID, neighbours, substring dedup and the n-gram join."""

import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute import corpus, lower, similar, substring_dedup, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspike.llm import _exchange, language, neighbours, ngram_join, sentence_pieces, substrings, token_counts
from marlspike.llm._bytes import find_words, span_hashes, utf8, windows

TEXTS = ["", "  a  b\n\tc  ", "ﬁ Å é ① 😀", "<s> </s> <0x41> <unk>", "a", "   ", "the  the   the    x\x00\r\n", "don't  we'll  1234  5,000.50 \u00a0 x \u3000 y\u2003 z", "x\u00a0 y\u2003  z \x1c w", "word\n\nword\n \nx", "é" * 700, "ab " * 3000]
anything = st.lists(st.text(st.sampled_from("ab é.\n\t \u00a0\u3000'1😀▁X"), max_size=40), min_size=1, max_size=6)


@given(anything)
@settings(max_examples=60, deadline=None)
def test_words_of_bytes(texts):
    w = find_words(*utf8(pa.array(texts)))
    got = [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)] and w.count.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(got, w.hashes().tolist()))) == len(set(got)) == len(set(w.hashes().tolist()))


def test_hashes_depend_on_all_bytes():
    long = [("x" * n + c).encode() for n in (0, 7, 8, 255, 256, 257, 5000) for c in "ab"]
    raw = np.frombuffer(b"".join(long), np.uint8)
    end = np.cumsum([len(x) for x in long])
    assert len(set(span_hashes(raw, end - [len(x) for x in long], end).tolist())) == len(long)
    h = np.arange(50, dtype=np.uint64)
    assert len(set(windows(h, 20).tolist())) == 31 and windows(np.concatenate([h, h]), 20)[3] == windows(np.concatenate([h, h]), 20)[53]
    assert len(windows(h[:5], 20)) == 0 and len(windows(h, 1)) == 50


@given(anything)
@settings(max_examples=40, deadline=None)
def test_tokens_equal_whole_text_encoding(texts):
    path = token_counts.vocabulary_path()
    bpe, _ = token_counts.encoder(path)
    ids, _, _, of = token_counts.tokens(pa.array(texts), path)
    assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == [bpe.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    bpe, _ = token_counts.encoder(token_counts.vocabulary_path())
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, *TEXTS[:2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(df, rule=rule).collect()
    for i, t, _ in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        if t is None:
            assert not mine
            continue
        lines = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        assert [r.n_bytes for r in mine] == [len(x.encode()) for x in lines]
        assert sum(r.n_tokens for r in mine) == pytest.approx(len(bpe.encode_ordinary(t)))
        if rule == "start":
            at = np.cumsum([0] + [len(bpe.decode_single_token_bytes(x)) for x in bpe.encode_ordinary(t)])[:-1]
            ends = np.cumsum([r.n_bytes for r in mine])
            assert [r.n_tokens for r in mine] == [int(((at >= e - r.n_bytes) & (at < e)).sum()) for r, e in zip(mine, ends)]
    assert token_counts.token_counts(df.where("false")).count() == 0


def test_crossing_tokens_follow_the_rule():
    begin, end, low, high = np.array([0, 2, 7]), np.array([2, 7, 8]), np.array([0, 3, 3, 8]), np.array([3, 3, 8, 8])
    assert token_counts.attribute(begin, end, low, high, "start").tolist() == [2, 0, 1, 0]
    assert token_counts.attribute(begin, end, low, high, "most").tolist() == [1, 0, 2, 0]
    assert token_counts.attribute(begin, end, low, high, "share").tolist() == pytest.approx([1.2, 0, 1.8, 0])


def test_sentencepiece_parity(spark, sf):
    path = sentence_pieces.model_path()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, texts[1]])], "i int, text string, IDS string")
    out = sentence_pieces.encode(df).cache()
    assert out.columns == ["i", "text", "ids", "n_tokens", "round_trip"]
    for r in out.collect():
        if r.text is None:
            assert r.ids is None and r.n_tokens == 0 and r.round_trip is None
        else:
            assert r.ids == m.encode(r.text) and r.n_tokens == len(r.ids) and r.round_trip
    back = sentence_pieces.decode(out.drop("text")).collect()
    assert {r.i: r.decoded for r in back} == {i: t for i, t in enumerate([*texts, None, texts[1]])}
    assert sentence_pieces.encode(df.where("false")).count() == 0


@given(anything)
@settings(max_examples=40, deadline=None)
def test_sentencepiece_parity_of_odd_texts(texts):
    path = sentence_pieces.model_path()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, count = sentence_pieces.codec(path).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [m.encode(t) for t in texts]


def test_unigram_model(tmp_path):
    """A hand-written unigram model with byte fallback, read by both libraries."""

    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 | 2]) + _len(len(value)) + value
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + np.float32(value).tobytes()
        return _len(number << 3) + _len(value)

    def _len(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -2.5), ("b", -2.6), ("▁a", -2.0), ("ab", -3.1), ("▁ab", -4.4), ("c", -3.3))]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    (tmp_path / "u.model").write_bytes(data)
    m = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["ab a", "abc ab b a", "é ab", "", "ca  ba"]
    ids, count = sentence_pieces.Codec(str(tmp_path / "u.model")).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [m.encode(t) for t in texts]


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and length(text) > 100")
    got = language.identify(held, model).collect()
    assert np.mean([r.lang == r.found_lang for r in got]) >= 0.97 and all(r.accepted for r in got)


def test_language_evidence(spark, sf):
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, None, "de", "x.de"), (2, "", None, "x.de"), (3, "12345 67890 #### !!!! " * 20, "en", "x.org"), (4, "Привет мир как дела " * 20, "en", None), (5, "der die das und von zu mit auf " * 9, "en", "y.org")]
    rows += [(i, "the of and to in with that is on", None, "same.org") for i in range(6, 30)] + [(30, "zz", None, "same.org"), (30, "zz", None, "same.org")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, text string, declared string, host string, accepted string")
    out = language.identify(df, model, "text", F.col("declared"), F.col("host"), suffix=True)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and len(got) == len(rows) - 1
    assert got[1].found_lang == "de" and got[1].accepted and got[2].found_lang == "de"
    assert not got[3].accepted and not got[4].accepted and got[3].found_lang == language.NONE
    assert got[5].found_lang == "de" and got[30].found_lang == "en"
    assert language.identify(df.where("false"), model, "text", F.col("declared"), F.col("host")).count() == 0


def nearest(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1]):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        s = sorted((-float(np.dot(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(s)]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(90)]
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, None), (103, [0.0] * 6), (104, [float("nan")] * 6), (105, [1.0]), (106, [None] * 6), (None, [1.0] * 6), (5, [9.0] * 6), (107, [float("inf")] * 6), (108, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == nearest(rows)
    few = neighbours.nearest(df.where("vec_id < 8")).collect()
    assert len(few) == 7
    assert neighbours.nearest(df.where("false")).count() == 0 and neighbours.nearest(df.where("vec_id = 102")).count() == 0


def test_neighbours_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # hot buckets are split
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] + 0.01 * x[:500]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(q, i) for q, _, i in nearest(rows)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r.score - float(np.dot(x[r.query_id], x[r.vec_id]))) < 1e-12 for r in got[:200])


def test_neighbours_hash_alike_at_every_size(spark, monkeypatch):
    asked, hashed = [], neighbours.hashed
    monkeypatch.setattr(neighbours, "hashed", lambda df, tables, probes, *more: asked.append((tables, probes)) or hashed(df, tables, probes, *more))
    x = np.random.default_rng(6).normal(size=(1100, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (1000, 1100):
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(x[:n])]
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        want = {(q, i) for q, _, i in nearest(rows)}
        assert 0.9 * len(want) <= len({(r.query_id, r.vec_id) for r in got} & want) and len(got) == len(want)
    assert asked == [(neighbours.TABLES, 1), (neighbours.TABLES, neighbours.PROBES)] * 2


def test_neighbours_of_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 64))
    x *= (np.exp(rng.normal(size=2000)) / np.linalg.norm(x, axis=1))[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = [(q, i) for q, _, i in nearest(rows)]
    found = {q: sum(p in got for p in want if p[0] == q) for q in {q for q, _ in want}}
    assert sum(found.values()) >= 0.97 * len(want) and min(found.values()) >= 16


@pytest.fixture(params=[64, 1 << 20])
def small_groups(request, monkeypatch):
    monkeypatch.setattr(_exchange, "GROUP_BYTES", request.param)
    return request.param


def test_substring_dedup_equals_brute_force(spark, small_groups):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, lang string, source string, n_words int, id string")
    out = substrings.remove_repeats(docs)
    assert sorted(out.columns) == sorted(docs.columns + ["n_removed"])
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s"), "id", "lang").collect()
    assert sorted(map(tuple, (r[:4] for r in got))) == sorted(substring_dedup([r[:2] for r in rows]))
    assert {r.doc_id: r.lang for r in got} == {r[0]: r[2] for r in rows} and {r.id for r in got} == {"g"}
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_substring_dedup_of_random_repeats(spark, small_groups):
    rng = np.random.default_rng(small_groups)
    rows = []
    for i in range(60):
        w = [f"v{x}" for x in rng.integers(0, 2 if i % 3 == 0 else 6, rng.integers(0, 150))]
        if i > 10:
            other = rows[rng.integers(0, i)][1].split()
            a = rng.integers(0, max(1, len(other)))
            w[len(w) // 2 : len(w) // 2] = other[a : a + rng.integers(15, 60)]
        rows.append((int(1000 - i if i % 2 else i), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring_dedup(rows))


def test_substring_dedup_of_null_and_equal_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (4, text + " " + text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(False, 30, 0), (False, 30, 0), (False, 60, 30), (True, 30, 30)]


def linked_corpus():
    rng = np.random.default_rng(7)
    rows = [r[:2] for r in corpus()]
    for c in range(6):
        base = [f"c{c}v{x}" for x in rng.integers(0, 40, 60)]
        for j in range(12):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 3 + 2 * c)):
                w[k] = f"e{rng.integers(0, 30)}"
            rows.append((100 + 20 * c + j, " ".join(w)))
    return rows


@pytest.mark.parametrize("members, gather, hot", [(256, 4096, 200), (3, 2, 200), (256, 5, 0)])
def test_ngram_join_equals_brute_force(spark, small_groups, monkeypatch, members, gather, hot):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "GATHER", gather)
    monkeypatch.setattr(ngram_join, "GUESTS", 2)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    rows = linked_corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_similar int")
    got = ngram_join.similar_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted(similar(rows))


def test_ngram_join_edges(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "A B C"), (None, None), (9, ""), (None, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_documents(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, similar(rows)))
    assert ngram_join.similar_documents(docs.where("false")).count() == 0
    kept = ngram_join.one_of_each(docs).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, "A B C"), (None, None), (9, ""), (None, "q r s t")]))


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(f"n{i:03}".encode(), f"n{i + 1:03}".encode()) for i in range(120) if i % 40 != 39], "u binary, v binary")
    got = {bytes(r.v): bytes(r.root) for r in ngram_join.components(edges).collect()}
    for i in range(120):
        root = f"n{i // 40 * 40:03}".encode()
        assert got.get(f"n{i:03}".encode(), root) == root
    assert lower("ÀB") == "Àb"
