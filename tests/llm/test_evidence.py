"""Language ID against a plain computation of its posterior, and the schedule's part in the mix."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import words
from pyspark.sql import functions as F

from marlspike.llm import language, mixing

EN, DE, FR, ES = (
    "the quick brown fox jumps over the lazy dog and the cat sleeps in the house with all of its friends",
    "der schnelle braune fuchs springt über den faulen hund und die katze schläft in dem haus mit den freunden",
    "le renard brun saute par dessus le chien paresseux et le chat dort dans la maison avec tous ses amis",
    "el zorro marrón salta sobre el perro perezoso y el gato duerme en la casa con todos sus amigos",
)


def page(text, lang=None):
    return f"<html{f' lang="{lang}"' if lang else ''}><head><script>var the = 'and the';</script></head><body><p>{text}</p></body></html>"


PAGES = [
    (1, "http://a.shop.de/x", page(DE, "de")),
    (2, "http://a.shop.de/y", page(EN, "de")),  # text against declaration, suffix and host
    (3, "http://b.shop.de/z", page("", None)),  # suffix and domain alone
    (4, "http://www.site.fr/", page(FR)),
    (5, "http://www.site.fr/a", page(ES, "fr")),
    (6, "http://www.site.fr/b", page("zzzz qqqq", "xx")),  # an unknown declaration tells nothing
    (7, "http://plain.com/", page(EN, "es")),
    (8, "http://plain.com/2", page("ok", "es")),
    (9, None, None),
    (10, "no address", page(ES * 40, "ES")),
    (11, "http://plain.com/", page(EN, "es")),
    (12, "http://news.es", page("Привет мир, как дела? " * 20, "es")),
]


def plain_posteriors(model):
    k = len(model.classes)

    def vote(lang, right):
        if lang not in model.classes[:-1]:
            return np.zeros(k)
        return np.array([math.log(right) if c == lang else math.log((1 - right) / (k - 1)) for c in model.classes])

    ev, host = [], []
    for _, url, html in PAGES:
        m = re.search(r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", html or "")
        at = re.split("[/?#]", url.split("://", 1)[1])[0].lower() if url and "://" in url else ""
        log = model.log_likelihood(pa.array([html]), True)[0] + vote(m[1].lower() if m else None, 0.9) + vote(language.SUFFIX.get(at.rsplit(".", 1)[-1]), 0.8)
        e = np.exp(log - log.max())
        ev.append(e / e.sum())
        host.append(at)
    domain = [".".join(h.split(".")[-2:]) for h in host]
    world = sum(ev) + 1
    world = world / world.sum()
    out = []
    for e, h, d in zip(ev, host, domain):
        prior = world
        for key, keys in ((d, domain), (h, host)):
            prior = np.maximum(0, sum(x for x, other in zip(ev, keys) if other == key) - e) + 8 * prior
            prior = prior / prior.sum()
        out.append(e * prior / (e * prior).sum())
    return out


def test_language_query_equals_the_formula(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(90_000 + i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es")] * 5)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    model = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = {r.page_id: r for r in language.op6_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(PAGES)
    for (i, *_), want in zip(PAGES, plain_posteriors(model)):
        assert got[i].found_lang == model.classes[int(want.argmax())] and got[i].confidence == pytest.approx(want.max(), abs=2e-6), i
        assert got[i].accepted == (got[i].found_lang != language.NONE and got[i].confidence >= 0.5)
    assert [got[i].found_lang for i in (1, 4, 10)] == ["de", "fr", "es"] and got[2].found_lang == "en" and got[3].found_lang == "de"


def test_sample_is_bounded_and_alike_in_any_order(spark):
    rows = [(i, f"{EN} {i}" if i % 3 else f"{DE} {i}", "en" if i % 3 else "de") for i in range(400)] + [(500, None, "en"), (501, EN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = language.fit(docs, sample=50), language.fit(docs.orderBy(F.desc("doc_id")).repartition(7), sample=50)
    assert (a.table == b.table).all() and not (a.table == language.fit(docs).table).all()
    assert (language.fit(docs.where("false")).table[:-1] == language.fit(docs.where("lang = 'xx'")).table[:-1]).all()


def test_points_decide_the_mix(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 30)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: sum(len(words(t)) for _, t, q in rows if q == s) for s in "abc"}

    def mix():
        return {(r.doc_id, r.mix_lap): (r.mix_slot, r.mix_words, r.source) for r in mixing.mix_sources(docs).collect()}

    golden = mix()
    monkeypatch.setattr(mixing, "GOLDEN", 0.7548776662466927)
    other = mix()
    assert golden.keys() == other.keys() and {k: v[0] for k, v in golden.items()} != {k: v[0] for k, v in other.items()}
    for got in (golden, other):
        slots = sorted((slot, s) for slot, _, s in got.values())
        for share in (0.25, 0.5, 0.75):  # every stretch of the mix holds each source as the whole does
            part = [s for slot, s in slots if slot < share * mixing.SLOTS]
            for s in sizes:
                assert abs(part.count(s) / len(part) - sum(v[2] == s for v in got.values()) / len(got)) < 0.1
        assert all(w <= 30 for _, w, _ in got.values())


def test_slots_are_dealt_to_every_source_once(spark):
    t = spark.createDataFrame([(f"s{i:03}", 1e6 if i == 7 else 1.0) for i in range(300)] + [(None, 5.0), ("none", 0.0)], "source string, target double")
    got = mixing.slot_schedule(t, block=500).collect()
    assert len({r.slot for r in got}) == len(got) and {r.source for r in got} == {f"s{i:03}" for i in range(300)} | {None}
    by = {}
    for r in got:
        by.setdefault(r.source, []).append((r.nth, r.slot))
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) and [s for _, s in sorted(v)] == sorted(s for _, s in v) for v in by.values())
    assert abs(len(by["s007"]) - 10**6 / 500) < 5
