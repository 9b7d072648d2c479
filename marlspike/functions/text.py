"""Text expressions: tokens, languages, normalisation, markup and full-text terms, all as columns."""

from __future__ import annotations

import html
import logging
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Lemma = Callable[[str, str], str]
log = logging.getLogger(__name__)
SLICE = 256  # rows of tokens that are lemmatised at a time
KNOWN = 1 << 16
CYRILLIC = r"Ѐ-ԯ"
#: Latin letters with a mark and what is left without it; the letters of unicode text that decompose to ASCII.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
assert len(MARKED) == len(PLAIN)

_BLANK = r"[\s\x1c-\x1f&&[^\n]]+"
_BLOCKS = "p|div|section|article|aside|header|footer|nav|main|h[1-6]|ul|ol|li|blockquote|pre|table|tr|thead|tbody|figure|figcaption|details|summary|hr|br"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of at least two characters."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.length(x) >= 2), F.lower)


def detect_lang(text: Column) -> Column:
    """ru if over 40 % of the first 200 letters are Cyrillic, else en; unknown without letters."""
    letters = F.substring(F.regexp_replace(text, r"\P{L}+", ""), 1, 200)
    cyrillic = F.length(F.regexp_replace(letters, f"[^{CYRILLIC}]+", ""))
    return F.when(F.coalesce(F.length(letters), F.lit(0)) == 0, "unknown").when(cyrillic > 0.4 * F.length(letters), "ru").otherwise("en")


def detect_word_lang(word: Column) -> Column:
    return F.when(word.rlike(f"[{CYRILLIC}]"), "ru").otherwise("en")


def normalize(text: Column) -> Column:
    """One kind of line end, at most one blank line in a row, single spaces, no white space at the ends."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, "(?U)" + _BLANK, " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@F.arrow_udf(StringType())
def unescape(column: pa.Array) -> pa.Array:
    """Decodes character references as HTML 5 does; only texts with an ampersand are touched."""
    return pa.array([html.unescape(t) if t and "&" in t else t for t in column.to_pylist()], pa.string())


def html_to_text(page: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags part paragraphs, other tags vanish."""
    t = F.regexp_replace(page, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n\n")
    return normalize(unescape(F.regexp_replace(t, "<[^>]+>", "")))


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the full-text index sees it."""
    return F.lower(F.translate(text, MARKED, PLAIN))


def index_terms(text: Column) -> Column:
    """Terms that the full-text index holds of a text, in order: tokens, split at underscores, folded."""
    return F.regexp_extract_all(fold(F.array_join(tokenize(text), " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _lemmas(tokens: pa.Array, langs: pa.Array, lemma: Lemma, known: dict[tuple[str, str], str]) -> pa.Array:
    """Joined lemmas of rows of tokens; words are Python objects once each, and `known` keeps at most KNOWN of them."""
    size = pc.fill_null(pc.list_value_length(tokens), 0)
    words = tokens.flatten().dictionary_encode()
    codes = pc.fill_null(langs, "en").dictionary_encode()
    of_row = np.repeat(np.asarray(codes.indices, np.int64), np.asarray(size))
    n = max(len(words.dictionary), 1)
    pairs, place = np.unique(of_row * n + np.asarray(words.indices, np.int64), return_inverse=True)
    names = ["en" if c == "unknown" else c for c in codes.dictionary.to_pylist()]
    if len(known) > KNOWN:
        known.clear()
    found = []
    for pair, w in zip(pairs, words.dictionary.take(pa.array(pairs % n)).to_pylist()):
        key = (w, names[pair // n])
        if key not in known:
            known[key] = lemma(*key)
        found.append(known[key])
    values = pa.array(found, pa.string()).take(pa.array(place.reshape(-1), pa.int64()))
    ends = pa.array(np.append(0, np.cumsum(np.asarray(size))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, values, mask=tokens.is_null()), " ")


def lemmatize(text: Column, lemma: Callable[[str, str], str] | None = None, lang: Column | None = None) -> Column:
    """Lemmas of the tokens, joined by spaces. Without a `lemma(word, lang)` function tokens are their own lemmas."""
    if lemma is None:
        return F.array_join(tokenize(text), " ")
    lang = detect_lang(text) if lang is None else lang

    @F.arrow_udf(StringType())
    def run(tokens: pa.Array, langs: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], str] = {}
        return pa.concat_arrays([pa.array([], pa.string()), *(_lemmas(tokens.slice(lo, SLICE), langs.slice(lo, SLICE), lemma, known) for lo in range(0, len(tokens), SLICE))])

    return run(tokenize(text), lang)


def lemmatizer_chain(*steps: Callable[[str, str], str | None]) -> Lemma:
    """A lemma function that asks each step in turn: the first that knows the word decides, else it stays.

    A step that raises is passed over for that word.
    """

    def run(word: str, lang: str) -> str:
        for step in steps:
            try:
                if found := step(word, lang):
                    return found
            except Exception:
                log.debug("a lemmatizer failed on %r", word, exc_info=True)
        return word

    return run


def installed_lemmatizers() -> list[Callable[[str, str], str | None]]:
    """Steps for the lemmatizers that can be imported here, those for one language first."""
    steps: list[Callable[[str, str], str | None]] = []
    try:
        import pymorphy3

        russian = pymorphy3.MorphAnalyzer()
        steps.append(lambda w, lang: russian.parse(w)[0].normal_form if lang == "ru" else None)
    except ImportError:
        pass
    try:
        import simplemma

        steps.append(lambda w, lang: simplemma.lemmatize(w, lang=lang))
    except ImportError:
        pass
    return steps


_OPERATORS = {"AND", "OR", "NOT", "NEAR"}
_PUNCTUATION = str.maketrans({c: " " for c in "\"'()*^{}[]:+~|"})


def lemmatize_query(query: str, lemma: Callable[[str, str], str] | None = None, lang: str | None = None) -> str:
    """Lemmas of a query; words that are written like operators stay as they are."""
    out = []
    for word in re.findall(r"\w+", query):
        if word in _OPERATORS:
            out.append(word)
        elif len(word) >= 2:
            w = word.lower()
            out.append(w if lemma is None else lemma(w, lang or ("ru" if re.search("[Ѐ-ԯ]", w) else "en")))
    return " ".join(out)


def sanitize_query(query: str) -> str:
    """A query without match syntax: quotes, brackets and leading hyphens go, operators lose their capitals."""
    words = re.sub(r"(^|\s)-+", r"\1", query.translate(_PUNCTUATION)).split(" ")
    return " ".join(w.lower() if w in _OPERATORS else w for w in words).strip()


def sanitize(query: Column) -> Column:
    """sanitize_query() for a column of queries."""
    q = F.regexp_replace(F.translate(query, "\"'()*^{}[]:+~|", " " * 14), r"(^|\s)-+", "$1")
    for word in sorted(_OPERATORS):
        q = F.regexp_replace(q, rf"\b{word}\b", word.lower())
    return F.trim(q)


def match_phrases(query: str) -> list[list[str]]:
    """The phrases that a sanitised query asks for; all must occur. None for what the index calls a syntax error.

    Terms apart from each other are phrases of one term. A term with an underscore is a phrase of its parts.
    """
    import unicodedata

    if re.search(r"[^\w\s]", query):
        return []
    plain = unicodedata.normalize("NFD", query.lower())
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    return [p for p in ([x for x in w.split("_") if x] for w in plain.split()) if p]


def word_overlap(query: str, text: Column) -> Column:
    """Share of the query's words that occur in a text; the score of the word-overlap reranker."""
    words = sorted(set(query.lower().split()))
    have = F.split(F.lower(text), r"\s+")
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains(have, w))) / F.lit(max(len(words), 1)) if words else F.lit(0.0)


def extract_actions(text: Column, keywords: dict[str, str]) -> Column:
    """Actions whose keyword occurs in a text, in the order in which keywords are first met, each once."""
    t = F.lower(text)
    found = F.array(*[F.struct(F.instr(t, k).alias("at"), F.lit(a).alias("action")) for k, a in keywords.items()])
    return F.array_distinct(F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["action"]))
