import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.functions import chunkers as K
from marlspike.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_tokenize_keeps_words_of_two_and_more(spark):
    assert column(spark, ["Hello, a WORLD x1 _b", "", None, "Привет мир"], T.tokenize) == [["hello", "world", "x1", "_b"], [], None, ["привет", "мир"]]


def test_detect_lang(spark):
    assert column(spark, ["hello", "привет мир", "12 !", "", None, "abc абв"], T.detect_lang) == ["en", "ru", "unknown", "unknown", "unknown", "ru"]
    assert column(spark, ["a" * 200 + "я" * 500], T.detect_lang) == ["en"]


def test_normalize(spark):
    assert column(spark, ["a\r\nb\rc", "a\n\n\n\nb", "  a \t b  ", " x y", None], T.normalize) == ["a\nb\nc", "a\n\nb", "a b", "x y", None]


PAGES = [
    ("<p>Hello</p><p>World</p>", "Hello\n\nWorld"),
    ("<script>var a='<p>';</script>x<style>p{}</style>y", "xy"),
    ("a<!-- hidden\n -->b", "ab"),
    ("x &amp; y &lt;z&gt; &#65;", "x & y <z> A"),
    ("<b>bold</b> and <i>it</i>", "bold and it"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "12"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_html_to_text(spark, page, text):
    assert column(spark, [page], T.html_to_text) == [text]


def test_unescape_matches_html(spark):
    texts = ["&amp &am &copy; &#x41; &nosuch;", "plain", None]
    assert column(spark, texts, T.unescape) == [None if t is None else html.unescape(t) for t in texts]


def test_lemmatize(spark):
    assert column(spark, ["Dogs and CATS", None], T.lemmatize) == ["dogs and cats", None]
    assert column(spark, ["Dogs run", "слова"], lambda t: T.lemmatize(t, lambda w, lang: f"{w}/{lang}")) == ["dogs/en run/en", "слова/ru"]


def test_query_operators():
    assert T.lemmatize_query("Cats AND Dogs NOT x") == "cats AND dogs NOT"
    assert T.sanitize_query('cats AND "dogs" -lead (NEAR)') == "cats and  dogs  lead  near"
    assert T.match_phrases("cats foo_bar Café") == [["cats"], ["foo", "bar"], ["cafe"]]
    assert T.match_phrases("a.b") == [] and T.match_phrases("") == []


def test_sanitize_column_matches_function(spark):
    queries = ["cats AND dogs", '"a" (b)', "--x -y a-b", "NEAR", ""]
    got = column(spark, queries, T.sanitize)
    assert [g.split() for g in got] == [T.sanitize_query(q).split() for q in queries]


def test_word_overlap_and_actions(spark):
    assert column(spark, ["the cat", "dog"], lambda t: T.word_overlap("the dog cat", t)) == [pytest.approx(2 / 3), pytest.approx(1 / 3)]
    assert column(spark, ["light on, heat on, light off"], lambda t: T.extract_actions(t, {"heat": "H", "light": "L", "warm": "H"})) == [["L", "H"]]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Hello world. This is it.", ["Hello world.", "This is it."]),
        ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
        ("Pi is 3.14 today. Yes!", ["Pi is 3.14 today.", "Yes!"]),
        ("Wait... What? No", ["Wait... What?", "No"]),
        ("В г. Москва тепло. Да.", ["В г. Москва тепло.", "Да."]),
        ("one. two three", ["one. two three"]),
        ("U. S. A. Go.", ["U. S. A. Go."]),
        ("", []),
        ("   ", []),
    ],
)
def test_sentences(text, parts):
    assert K.split_sentences(text) == parts


def test_chunkers():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(10))
    parts = K.recursive_chunker(500, 0)(text)
    assert all(len(p) <= 500 for p in parts) and "Paragraph 9" in parts[-1]
    over = K.recursive_chunker(700, 1)(text)
    assert over[0].split("\n\n")[-1].strip() == over[1].split("\n\n")[0].strip()
    assert K.recursive_chunker()("short") == ["short"] and K.recursive_chunker()("") == []
    assert K.recursive_chunker(10, 0, 0, ())("x" * 25) == ["x" * 10, "x" * 10, "x" * 5]
    sentences = " ".join(f"Sentence number {i} is here." for i in range(50))
    parts = K.sentence_chunker(200, 1)(sentences)
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(parts, parts[1:]))
    md = "# One\n" + "text " * 500 + "\n```\n# no header\n```\n## Two\nmore"
    parts = K.markdown_chunker(max_size=1000)(md)
    assert parts[0].startswith("# One") and parts[-1].startswith("## Two") and not any(p.startswith("# no header") for p in parts)


def test_chunks_column(spark):
    got = column(spark, ["a b", " ", None], lambda t: K.chunks(t, lambda x: [p for p in x.split(" ")]))
    assert got == [["a", "b"], [" "], None]


def test_lemmas_of_many_rows_hold_each_word_once(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 2)
    asked = []

    def lemma(word, lang):
        asked.append((word, lang))
        return None if word == "gone" else word + "/" + lang

    rows = pa.array([["a1", "b", "a1"], None, [], ["b", "слово"], ["a1"] * 50])
    got = T._lemmas(rows, pa.array(["en", None, "unknown", "ru", "unknown"]), lemma, {})
    assert got.to_pylist() == ["a1/en b/en a1/en", None, "", "b/ru слово/ru", " ".join(["a1/en"] * 50)]
    sliced = T._lemmas(rows.slice(3), pa.array(["ru", "unknown"]), lemma, known := {("x", "en"): "x", ("y", "en"): "y", ("z", "en"): "z"})
    assert sliced.to_pylist() == got.to_pylist()[3:] and ("x", "en") not in known
    assert T._lemmas(pa.array([], pa.list_(pa.string())), pa.array([], pa.string()), lemma, {}).to_pylist() == []


def test_chunks_go_to_arrow_in_stretches(monkeypatch):
    sizes, array = [], pa.array
    monkeypatch.setattr(K, "HELD", 100)
    monkeypatch.setattr(K.pa, "array", lambda values, *a: sizes.append(len(values)) or array(values, *a))
    texts = ["x" * 60, "a b", None, "", "y" * 60, "z" * 500]
    got = K.chunked(array(texts), lambda t: t.split(" "))
    assert got.to_pylist() == [["x" * 60], ["a", "b"], None, [""], ["y" * 60], ["z" * 500]] and max(sizes) < len(texts)
