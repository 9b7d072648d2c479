"""Quality rules: base counts, then the divergence of character-class and common-word histograms from language references."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WS, words, written

WINDOW = 8
LANGUAGES = ("en", "de", "fr", "es")
COMMON = {
    "en": "the of and to in a is that for it was on with as by this are be from at",
    "de": "der die das und von zu mit auf für ist des ein eine nicht sich im den dem auch als",
    "fr": "le la les de et un une des que qui dans pour est en du sur pas au avec ce",
    "es": "el la los las de y que en un una por con para se del es su lo al como",
}
VOCABULARY = tuple(dict.fromkeys(" ".join(COMMON.values()).split()))
CLASSES = ("space", "lower", "upper", "letter", "digit", "mark", "symbol")


@dataclass(frozen=True)
class Limits:
    """A histogram is judged only from its least size on; a distance beyond its limit rejects.

    The limit of words follows from the nearest reference: `word_share` of the divergence that a text with no
    common word has from it, and what a text as long drawn from the reference shows by chance; but at most
    `word_most` of the distance of a text with no common word, so that such a text is always beyond it.
    """

    char_distance: float = 0.28
    word_share: float = 0.5
    word_most: float = 0.95
    least_chars: int = 200
    least_words: int = 50


def bind(value: Column, use) -> Column:
    """use(value), with value computed once although `use` reads it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def repeated_words(win: Column, size: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in `win`, the hashes by position from 1."""

    def covered(s: Column) -> Column:
        last = F.size(s)
        found = F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.when(i < last - 1, F.get(s, i + 1)["h"] == x["h"]), F.lit(False)))
        at = F.array_sort(F.transform(found, lambda x: x["p"]))
        start = F.struct(F.lit(-size).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(size), p - a["p"])).alias("n")), lambda a: a["n"])

    pairs = F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return bind(F.array_sort(pairs), covered)


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns, the base counts and both histograms of every row; a null text counts as empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*[f"`{k}`" for k in keep], t.alias("t"), words(t).alias("w"))
    n, every = F.size("w"), F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    win = F.when(n >= WINDOW, F.transform(every, lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    both = sorted(set(VOCABULARY) | {v[:1].upper() + v[1:] for v in VOCABULARY})
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WS.replace("[", "[^", 1)))
    d = d.select(
        *[f"`{k}`" for k in keep],
        n.cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_all"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        win.alias("win"),
        F.lower(F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: x.isin(both)), "  "), F.lit(" "))).alias("common"),
        F.regexp_replace("t", r"[a-z ]+", "").alias("rest"),  # what is left of nearly all texts is short
    )
    repeats = F.when(F.size(F.array_distinct("win")) == F.size("win"), F.lit(0)).otherwise(repeated_words(F.col("win"), WINDOW))
    space = F.col("n_all") - F.col("word_chars")
    count = lambda p: F.length(F.regexp_replace("rest", f"[^{p}]+", "")).cast("long")
    upper, letter, digit, mark = count(r"\p{Lu}"), count(r"\p{L}&&[^\p{Lu}]"), count(r"\p{N}"), count(r".,;:!?'\"()\-")
    apart = F.length(F.regexp_replace("rest", WS + "+", "")).cast("long")
    symbol = apart - upper - letter - digit - mark
    lower = F.col("word_chars") - apart
    hits = [((F.length("common") - F.length(F.replace("common", F.lit(f" {v} "), F.lit("")))) / (len(v) + 2)).cast("long") for v in VOCABULARY]
    d = d.select(*[f"`{k}`" for k in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"), F.array(space, lower, upper, letter, digit, mark, symbol).alias("classes"), F.array(*hits).alias("common"))
    other = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("common", F.concat("common", F.array(other))).withColumn("base_failed", failed)


def references(f: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """The histograms of each language over all its documents that pass the base rules: one row a language."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"v{i}") for i in range(len(VOCABULARY) + 1)]
    rows = f.where(F.col(lang).isin(list(LANGUAGES)) & ~F.col("base_failed")).groupBy(lang).agg(*sums).collect()
    share = lambda xs: [x / (sum(xs) or 1) for x in xs]
    return {r[lang]: (share([r[f"c{i}"] for i in range(len(CLASSES))]), share([r[f"v{i}"] for i in range(len(VOCABULARY) + 1)])) for r in rows}


def nearest_distance(counts: Column, refs: list[list[float]]) -> Column:
    """The smallest Jensen-Shannon distance, base 2, from a histogram to one of `refs`: 0 to 1, and 0 for no counts."""
    return nearest(counts, refs)["d"]


def nearest(counts: Column, refs: list[list[float]]) -> Column:
    """(d, i): the smallest distance as in nearest_distance and the place of its reference in `refs`.

    With m the mean of both, the divergence is sum(p log p)/2 + sum(q log q)/2 - sum(m log m). The first sum is
    taken once, the second here and now, so that only the last is left for each reference.
    """
    plus = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    xlogx = lambda x: x * F.log(F.greatest(x, F.lit(1e-300)))

    def to(p: Column, own: Column, q: list[float]) -> Column:
        fixed = sum(x * math.log(x) for x in q if x > 0) / 2
        both = plus(F.zip_with(p, F.array(*[F.lit(x / 2) for x in q]), lambda x, y: xlogx(x / 2 + y)))
        return F.sqrt(F.greatest(F.lit(0.0), own / 2 + fixed - both) / math.log(2))

    def least(p: Column) -> Column:
        return bind(plus(F.transform(p, xlogx)), lambda own: F.array_min(F.array(*[F.struct(to(p, own, q).alias("d"), F.lit(i).alias("i")) for i, q in enumerate(refs)])))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    shares = bind(total, lambda t: F.transform(counts, lambda x: F.try_divide(x.cast("double"), t)))
    return bind(shares, least)


def word_limit(near: Column, n_words: Column, refs: list[list[float]], limits: Limits) -> Column:
    """The limit of the word distance for texts of `n_words` words whose nearest of `refs` is the one at `near`.

    With s the share of common words, a text with none of them lies at a divergence of
    (s + (1 - s) log2(1 - s) - (2 - s) log2((2 - s) / 2)) / 2. A text of n words drawn from a reference shows about
    1 / (8 n ln 2) by chance for each common word of a language.
    """
    none = lambda s: (s + ((1 - s) * math.log2(1 - s) if s < 1 else 0) - (2 - s) * math.log2((2 - s) / 2)) / 2
    apart = F.get(F.array(*[F.lit(none(1 - q[-1])) for q in refs]), near)
    chance = F.try_divide(F.lit(max(len(v.split()) for v in COMMON.values()) / (8 * math.log(2))), n_words)
    return F.least(limits.word_most * F.sqrt(apart), F.sqrt(limits.word_share * apart + chance))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """The base counts of every row, its distances to the nearest language reference, and whether it is kept.

    References are the summed histograms of each of LANGUAGES over the whole table, without the documents that
    the base rules reject. A document is measured against its nearest language, so a wrong label does not
    reject it. A text shorter than the guards keeps the verdict of the base rules, as do all texts where no
    language has a reference; a reference without a single common word says nothing of words. A null text is empty: it has no words, so it fails the base rules. Repeated rows
    are kept; other columns are left out; an empty table gives an empty result.
    """
    names = tuple(dict.fromkeys([*keep, lang]))
    f = written(features(docs, text, names), "features")
    known = references(f, lang)
    by_class, by_word = [r[0] for r in known.values()], [r[1] for r in known.values() if sum(r[1][:-1]) > 0]
    f = f.withColumn("char_distance", nearest_distance(F.col("classes"), by_class) if by_class else F.lit(0.0))
    f = f.withColumn("near", nearest(F.col("common"), by_word) if by_word else F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i")))
    f = f.withColumn("word_distance", F.col("near")["d"])
    limit = word_limit(F.col("near")["i"], F.col("n_words"), by_word, limits) if by_word else F.lit(1.0)
    odd = (F.col("n_words") >= limits.least_words) & (F.col("word_distance") > limit)
    odd |= (F.col("word_chars") >= limits.least_chars) & (F.col("char_distance") > limits.char_distance)
    f = f.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return f.select(*[f"`{k}`" for k in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
