"""Language ID: text likelihoods fused with declared language, address suffix and host priors by Bayes' rule."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import list_array, lowered, slices, utf8
from ._shared import fresh, written
from .url_filter import host_of

LANGUAGES = ("en", "de", "fr", "es")
NONE = "und"  # the class of text in none of the languages: every trigram equally likely
SAMPLE = 3000  # labelled rows, at most, that the text model is fitted on
BINS = 1 << 16
SUFFIX = {"de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
MOST_TRIGRAMS = 200  # trigrams of a text count no more than so many independent ones
PSEUDO = 8.0  # pages that the prior one level up stands for
BROADCAST_ROWS = 100_000  # hosts up to which the prior table is broadcast

_DROP = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def strip_markup(page: str) -> str:
    """The text of a page, its white space as single spaces: what tags leave behind is no evidence."""
    return " ".join(html.unescape(_DROP.sub(" ", page)).split())


def trigrams(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each byte trigram of all texts, A-Z lower-cased, and where those of each text begin."""
    low = lowered(raw).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    bins = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    inside = np.ones(len(bins), bool)
    for back in (1, 2):
        cut = texts[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(bins))]] = False
    at = np.concatenate([[0], np.cumsum(inside)])
    return bins[inside].astype(np.int64), at[np.minimum(texts, len(bins))]


@dataclass(frozen=True)
class TextModel:
    """Log probability of each trigram bin in each class; the last class is NONE."""

    classes: tuple[str, ...]
    table: np.ndarray

    def log_likelihood(self, column: pa.Array, markup: bool) -> np.ndarray:
        """One row a text and one column a class; trigrams beyond MOST_TRIGRAMS only sharpen the mean."""
        out = np.zeros((len(column), len(self.classes)))
        for lo, hi in slices(column, 1 << 20):
            part = column.slice(lo, hi - lo)
            if markup:
                part = pa.array([None if p is None else strip_markup(p) for p in part.to_pylist()], pa.large_string())
            bins, of = trigrams(*utf8(part))
            n = np.diff(of)
            scale = np.minimum(n, MOST_TRIGRAMS) / np.maximum(n, 1)
            for k, log in enumerate(self.table):
                upto = np.concatenate([[0.0], np.cumsum(log[bins], dtype=np.float64)])
                out[lo:hi, k] = (upto[of[1:]] - upto[of[:-1]]) * scale
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> TextModel:
    """The trigram model of at most `sample` labelled rows, those with the smallest hash of their columns.

    Rows below a bound on the hash, half as many again as are wanted, are found where they lie, so few travel and
    none but the sample's texts meet. The sample is counted on the executors; one table of counts a language and
    task comes to the driver. A language without rows gives no text evidence; without any labelled row, as in an
    empty table, no language does.
    """
    rows = docs.where(F.col(f"`{lang}`").isin(list(languages)) & F.col(f"`{text}`").isNotNull())
    key = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.typeName().startswith("map")])
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), key.alias("key"))
    bound = math.ceil(min(1.0, 1.5 * sample / max(1, rows.count())) * 2**32)
    rows = rows.where(F.pmod("key", F.lit(2**32)) < bound).orderBy("key").limit(sample).repartition(4, "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(BINS, np.int64) for k in languages}
        for whole in batches:
            for lo, hi in slices(whole.column(1), 1 << 20):
                bins, of = trigrams(*utf8(whole.column(1).slice(lo, hi - lo)))
                row = np.repeat(np.arange(hi - lo), np.diff(of))
                names = np.asarray(whole.column(0).slice(lo, hi - lo))
                for k in languages:
                    sums[k] += np.bincount(bins[(names == k)[row]], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    total = {k: np.zeros(BINS, np.int64) for k in languages}
    for r in rows.mapInArrow(count, "lang string, counts binary").collect():
        total[r.lang] += np.frombuffer(bytes(r.counts), np.int64)
    logs = [np.log((c + 0.5) / (c.sum() + 0.5 * BINS)) if c.any() else np.full(BINS, -2 * np.log(BINS)) for c in total.values()]
    return TextModel((*languages, NONE), np.stack([*logs, np.full(BINS, -np.log(BINS))]).astype(np.float32))


def _votes(lang: Column, right: float, classes: tuple[str, ...]) -> Column:
    """Log likelihood of a declared language under each class; nothing is learnt from none or an unknown one."""
    known = [c for c in classes if c != NONE]
    wrong = np.log((1 - right) / (len(classes) - 1))
    hit = F.array(*[F.when(lang == c, float(np.log(right))).otherwise(float(wrong)) for c in classes])
    return F.when(lang.isin(known), hit).otherwise(F.array(*[F.lit(0.0)] * len(classes)))


def _normal(log: Column) -> Column:
    """Probabilities of an array of logs."""
    e = F.transform(F.array(log), lambda a: F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp(x - m)))[0])[0]
    return F.transform(F.array(e), lambda a: F.transform(F.array(F.aggregate(a, F.lit(0.0), lambda s, x: s + x)), lambda t: F.transform(a, lambda x: x / t))[0])[0]


def identify(docs: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: bool = False, markup: bool = False, least: float = 0.5) -> DataFrame:
    """Adds found_lang, confidence and accepted to every row.

    The posterior of a row is its text likelihood times those of the declared language and of the suffix of its
    host, times the prior of its host. Priors are sums of the posteriors without priors, grouped by host, by
    domain (the last two labels) and over all; each level is smoothed with PSEUDO rows of the one above, and a
    row's own share is taken out. The sums cover all rows and are combined before any shuffle, so a host may
    hold any share of them. The table of hosts is broadcast only below BROADCAST_ROWS hosts.

    A row is accepted if its class is a language and has at least `least` of the posterior. A null or empty text
    has no text evidence; a null declared language or host gives none either (null hosts share one prior). With
    no evidence at all the priors decide: the row is accepted if one language has `least` of its host's. Every
    text is read whole, a very long one as a range of its own. Of equal posteriors the first class wins. Repeated
    rows are kept; columns of the input with the three names are replaced, others may have any name. An empty
    table gives an empty result.
    """
    k = len(model.classes)
    keep = [c for c in docs.columns if c.lower() not in ("found_lang", "confidence", "accepted")]
    ev, h, dom, post = (fresh(docs, x) for x in ("evidence", "host_key", "domain_key", "posterior"))

    @F.arrow_udf("array<double>")
    def likelihood(column: pa.Array) -> pa.Array:
        out = model.log_likelihood(column, markup)
        return list_array(out.ravel(), np.full(len(out), out.shape[1]), pa.float64())

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    where = F.coalesce(host, F.lit("")) if host is not None else F.lit("")
    logs = likelihood(F.col(f"`{text}`"))
    if declared is not None:
        logs = add(logs, _votes(declared, DECLARED_RIGHT, model.classes))
    if suffix:
        named = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])[F.substring_index(where, ".", -1)]
        logs = add(logs, _votes(named, SUFFIX_RIGHT, model.classes))
    d = docs.select(*[f"`{c}`" for c in keep], where.alias(h), logs.alias(ev)).withColumn(ev, _normal(F.col(ev)))
    d = d.withColumn(dom, F.substring_index(h, ".", -2) if suffix else F.lit(""))

    sums = [F.sum(F.col(ev)[i]).alias(f"c{i}") for i in range(k)]
    total = lambda df, *by: df.groupBy(*by).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])
    hosts = written(d.groupBy(h, dom).agg(*sums), "hosts")
    all_of = total(hosts).head()
    world = [((all_of[i] or 0.0) + 1.0) for i in range(k)]
    world = F.array(*[F.lit(x / sum(world)) for x in world])
    domains = total(hosts, dom).select(F.col(dom).alias("dom_"), F.array(*[f"c{i}" for i in range(k)]).alias("dom_sum"))
    table = hosts.select(F.col(h).alias("host_"), F.col(dom).alias("dom_"), F.array(*[f"c{i}" for i in range(k)]).alias("host_sum")).join(domains, "dom_")
    table = written(table.select("host_", "host_sum", "dom_sum"), "priors")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    d = d.join(table, d[h] == table["host_"])
    level = lambda c, up: F.transform(F.zip_with(F.zip_with(F.col(c), F.col(ev), lambda s, x: F.greatest(F.lit(0.0), s - x)), up, lambda s, u: s + PSEUDO * u), lambda x: x)
    share = lambda a: F.transform(F.array(a), lambda v: F.transform(F.array(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)), lambda t: F.transform(v, lambda x: x / t))[0])[0]
    d = d.withColumn("dom_sum", share(level("dom_sum", world))).withColumn("host_sum", share(level("host_sum", F.col("dom_sum"))))
    d = d.withColumn(post, share(F.zip_with(ev, "host_sum", lambda x, p: x * p)))
    best = F.array_max(post)
    name = F.array(*map(F.lit, model.classes))[F.array_position(post, best).cast("int") - 1]
    d = d.withColumn("found_lang", name).withColumn("confidence", F.round(best, 6))
    return d.select(*[f"`{c}`" for c in keep], "found_lang", "confidence", ((F.col("found_lang") != NONE) & (F.col("confidence") >= least)).alias("accepted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", 1))
    found = identify(pages, model, "html", declared, host_of(F.col("url")), suffix=True, markup=True)
    return found.select("page_id", host_of(F.col("url")).alias("host"), declared.alias("declared"), "found_lang", "confidence", "accepted")
