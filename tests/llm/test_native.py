"""URL filters, chat formatting, quality rules and mixing: only columns, no Python on executors."""

import random

import duckdb
import pytest
from brute import base_quality, corpus, words
from pyspark.sql import functions as F

from marlspike.llm import catalog, chat, mixing, quality, url_filter
from marlspike.llm._shared import running_sum

NATIVE = ["op2_url_filters", "op3_chat_formatting", "op5_quality_rules", "op8_mixing"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_hold_no_python(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cursor = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


def rule_of(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = []
    for r, a in rules:
        h, p = r.split("/", 1)[0], r[len(r.split("/", 1)[0]) :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((-len(r), -len(h), a != "block", r, a))
    return (host, path, *(min(fit)[3:] if fit else (None, "allow")))


URLS = [
    None, "", "nothing", "http://", "http://example.com", "http://EXAMPLE.com/en/", "https://www.example.com/en/x?q#f", "http://a.b.example.com/en/",
    "ftp://x.net/es/1", "http://net/es/", "http://xnet/es/", "http://x.net/ES/", "http://x.net?/es/", "http://x.com#/y", "http://x.com//", "a://b://c.com/",
    "http://x.net/fr/" + "y" * 5000, "http://" + "a." * 300 + "com/", "http://É.com/", "http://x.org/en/",
]


def test_url_filter_equals_brute_force(spark):
    rules = [*url_filter.RULES, ("b.example.com/en", "allow"), ("com", "block"), ("x.com/", "block"), ("EXAMPLE.org/q", "block")]
    rows = [(i, u, "mine", 1) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Verdict string, extra int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, url_filter.rule_table(spark, rules)).collect()}
    assert len(got) == len(rows) and got[0].extra == 1
    for i, u, _, _ in rows:
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == rule_of(u, rules), u
    assert url_filter.url_filter(pages.where("false"), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rule_table(spark).where("false")).collect()} == {"allow"}


def test_chat_keeps_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    convs = {1: [a, b], 2: [a, b, c], 3: [a, b, c], 4: [a, c], 5: [("user", None)], 6: [("user", "")], 7: [a], 8: [b, a], 9: [a, b, c] * 200, 10: [a, b, c] * 100}
    rows = [(i, t, r, x, "z") for i, turns in convs.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", "z"), (11, None, None, None, "z"), (12, 1, "user", "q", "z"), (12, 1, "user", "q", "z")]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    kept = chat.maximal_turns(turns, cell=4)
    assert {r.conv_id for r in kept.select("conv_id").distinct().collect()} == {4, 5, 6, 8, 9, 11, 12}
    out = chat.render(kept, 256).collect()
    whole = {i: "".join(r.rendered for r in sorted(out, key=lambda r: r.piece) if r.conv_id == i) for i in convs}
    assert whole[4] == "<|user|>\nhi<|end|>\n<|user|>\nmore<|end|>\n" and whole[9].count("<|end|>") == 600
    assert sum(r.n_turns for r in out if r.conv_id == 12) == 2
    assert chat.render(chat.maximal_turns(turns.where("false"))).count() == 0


def test_running_sum_is_the_same_with_any_cells(spark):
    rows = [(k, i, i % 7) for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v long").withColumn("cell", F.floor(F.col("i") / 9))
    for k, i, s in running_sum(df, ["k"], "cell", ["i"], "v", "s").select("k", "i", "s").collect():
        assert s == sum(x % 7 for x in range(i))


def test_quality_base_counts_equal_brute_force(spark):
    rows = corpus() + [(21, "a b c d e f g h " * 3 + "z " * 30, "en", "a"), (22, "l1 x\nl1 x\n\n\nl2\nl1 x", "en", "a"), (23, "#*$ %&| <> " * 10, "en", "a"), (21, "again", "en", "a")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = quality.quality_rules(docs).collect()
    want = sorted((i, *base_quality(t)) for i, t, _, _ in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_rules(docs.where("false")).count() == 0


def test_quality_keeps_prose_and_rejects_symbols(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 300")
    junk = docs.limit(5).select((-F.col("doc_id") - 1).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("$$$ %%% ")).alias("text"), "lang")
    got = {r.doc_id: r for r in quality.quality_rules(docs.union(junk)).collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert not any(r.kept for i, r in got.items() if i < 0)
    assert all(r.kept for i, r in got.items() if i in good and not r.base_failed)


def test_quality_rejects_texts_without_common_words(spark):
    rng = random.Random(5)
    own = {lang: [f"{lang}{''.join(rng.choices('abdelmnorstu', k=k))}" for k in range(2, 9) for _ in range(30)] for lang in quality.COMMON}

    def prose(lang, n, share):
        common = quality.COMMON[lang].split()
        weights = [1 / (k + 1) for k in range(len(common))]
        return " ".join(rng.choices(common, weights)[0] if rng.random() < share else rng.choice(own[lang]) for _ in range(n))

    rows = [(i, prose(lang, n, 0.25), lang, 1) for i, (lang, n) in enumerate((lang, n) for lang in own for n in (50, 60, 80, 150, 400, 2000) * 5)]
    rows += [(1000 + i, prose("en", n, share), "en", 0) for i, (n, share) in enumerate([(50, 0), (70, 0), (150, 0), (400, 0), (2000, 0), (600, 0.01), (2000, 0.02)])]
    rows += [(2000, prose("en", 49, 0), "en", 1)]  # shorter than the guard
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")).collect()}
    assert all(r.char_distance < quality.Limits().char_distance and not r.base_failed for r in got.values())
    assert [i for i, _, _, good in rows if got[i].kept != bool(good)] == []
    plain = spark.createDataFrame([(i, " ".join(rng.sample(own["en"], 80)), "en") for i in range(3)], "doc_id long, text string, lang string")
    assert all(r.kept and r.word_distance == 0 for r in quality.quality_rules(plain).collect())  # no reference knows a common word


def test_js_distance_equals_formula(spark):
    import math

    p, refs = [3, 0, 1, 4], [[0.25, 0.25, 0.5, 0.0], [0.4, 0.1, 0.1, 0.4]]

    def js(c, q):
        x = [v / sum(c) for v in c]
        m = [(a + b) / 2 for a, b in zip(x, q)]
        kl = lambda a: sum(u * math.log2(u / v) for u, v in zip(a, m) if u)
        return math.sqrt(kl(x) / 2 + kl(q) / 2)

    df = spark.createDataFrame([(p,), ([0, 0, 0, 0],)], "c array<bigint>")
    got = [r[0] for r in df.select(quality.nearest_distance(F.col("c"), refs)).collect()]
    assert got[0] == pytest.approx(min(js(p, q) for q in refs)) and got[1] == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, budget, left = {}, share * sum(sizes.values()), set(names)
    while left:
        level = (budget - sum(out.values())) / sum(w[s] for s in left)
        full = {s for s in left if level * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in left}
        out |= {s: most * sizes[s] for s in full}
        left -= full
    return out


def mixing_docs(spark):
    rows = [(i, " ".join(["w"] * (i % 40)), ("a", "b", "c", "d", None, "é", "Z")[i % 7]) for i in range(600)] + [(600, None, "a"), (None, "x y", "b"), (3, "same id", "a"), (3, "same id", "a"), (700, "v " * 3000, "d")]
    return rows, spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, source string, size int, lap string")


def test_mixing_meets_targets(spark, tmp_path):
    rows, docs = mixing_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, taken = targets(sizes), {s: 0 for s in sizes}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = next(k for k in sizes if sizes[k] == r.source_size and abs(want[k] - r.target) < 1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mixing.op8_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(spark):
    rows, docs = mixing_docs(spark)
    out = mixing.mix_sources(docs, block=500).cache()
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    for r in got:
        assert len(words(r.text)) == r.mix_words > 0
    assert sum(r.mix_words for r in got if r.doc_id == 3 and r.text == "same id") >= 4
    total = sum(targets({s: sum(len(words(t)) for _, t, q in rows if q == s) for s in {r[2] for r in rows}}).values())
    assert abs(sum(r.mix_words for r in got) - total) < 10
    slots = sorted((r.mix_slot, r.source or "") for r in got)
    assert len({s for _, s in slots[: len(slots) // 3]}) >= 5  # sources are mixed from the start
    assert mixing.mix_sources(docs.where("false")).count() == 0
