"""Mixing sources to target weights: low-discrepancy slots are dealt to sources and joined to shuffled equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import fresh, running_sum, words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words the mix takes, as a share of all words
MOST = 2  # laps at most over one source
BLOCK = 8192  # words of a block, about
SLOTS = 1024  # of a mix, at least, so that a small mix is mixed finely too
GOLDEN = 0.6180339887498949
CELLS = 64  # of the unit interval in which points meet sources, at least


def count_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has, counted as the places where one begins; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so small beside the corpus.

    Sources by code point, null last, take the weights in turn. The sum of targets is `share` of all sizes; a
    target stops at `most` times its source's size and the excess is shared again by weight. That is water
    filling: sources sorted by size / weight are full up to one point, and the level beyond it follows from sums.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(every) - 1) % len(weights) + 1)
    s = sizes.select("source", F.col("source_size"), weight.alias("weight")).withColumn("full", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("filled", F.coalesce(F.sum("full").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * share - F.col("filled")) / F.col("open"))
    s = s.withColumn("stops", F.col("level") * F.col("weight") >= F.col("full"))
    s = s.withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("full") / F.col("weight"), F.col("level").alias("v")))).over(everything)["v"])
    return s.select("source", "source_size", "weight", F.least("full", F.coalesce(F.col("level") * F.col("weight"), "full")).alias("target"))


def slot_schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, nth, slot): the slots of the mix dealt by golden-ratio points through the cumulative targets.

    There is a slot for every `block` words of the mix, and SLOTS at least. Slot t has the point frac(t * golden);
    the source whose interval holds it gets the slot, as its nth. A source so small that no point falls into its
    interval gets one slot after all others. Points and intervals meet on cells of the unit interval, as many as
    there are sources, and ranks are taken over cells of slots, so a source may own any share.
    """
    spark, span = targets.sparkSession, 1 << 16
    total, count = targets.where("target > 0").agg(F.sum("target"), F.count("*")).head()
    slots, cells = max(SLOTS, math.ceil((total or 0.0) / block)), max(CELLS, count)
    up = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    before = F.coalesce(F.sum("target").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sources = targets.where("target > 0").select("source", (before / F.lit(total or 1.0)).alias("low"), F.row_number().over(up).alias("place"))
    sources = sources.withColumn("high", F.lead("low", 1, 2.0).over(up))
    at = F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.least("high", F.lit(1.0)) * cells))).alias("at")
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % 1.0).alias("u"))
    points = points.withColumn("at", F.floor(F.col("u") * cells))
    dealt = points.join(sources.select("source", "low", "high", at), "at").where("u >= low and u < high").select("source", "slot", F.floor(F.col("slot") / span).alias("cell"), F.lit(1).alias("one"))
    dealt = written(running_sum(dealt, ["source"], "cell", ["slot"], "one", "nth").select("source", "nth", "slot"), "slots")
    some = dealt.select(F.col("source").alias("source_")).distinct()
    none = sources.join(some, sources["source"].eqNullSafe(some["source_"]), "left_anti")
    return dealt.unionByName(none.select("source", F.lit(0).alias("nth"), (F.lit(slots - 1) + F.col("place")).alias("slot")))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """What of each row the mix takes, and where: one row for each lap over a row of (key, source, size, h, tie).

    Each source is a stream: its rows by (h, tie), read again from the start after the last, `most` laps at
    most. Its words up to the target are cut into as many equal blocks as the points deal slots to the source, and
    the nth block takes the nth slot. Low discrepancy keeps the blocks of all sources near `block` words. Adds
    source_size, target, lap, piece (words) and slot, that of the block in which the piece begins; a row of which
    nothing is taken has one row with piece 0 and a null slot.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(by, weights, share, most), "targets")
    s = slot_schedule(targets, block).select(F.col("source").alias("source_"), F.col("nth").alias("nth_"), "slot")
    dealt = s.groupBy("source_").agg(F.count("*").alias("dealt"))
    t = targets.join(dealt, targets["source"].eqNullSafe(dealt["source_"]), "left").select(F.col("source").alias("source_"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.floor("target") / F.coalesce("dealt", F.lit(1)))).cast("long").alias("each"))
    cell = F.shiftright(F.conv(F.substring("h", 1, 3), 16, 10).cast("long"), 2)  # 1024 cells of hash order
    d = running_sum(sizes.withColumn("cell", cell), ["source"], "cell", ["h", "tie"], "size", "before")
    d = d.join(t, d["source"].eqNullSafe(t["source_"]), "left").drop("source_", "cell")
    laps = F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int") - 1
    d = d.withColumn("lap", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), laps))))
    d = d.withColumn("begin", F.col("lap") * F.col("source_size") + F.col("before"))
    d = d.withColumn("piece", F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), F.floor("target")) - F.col("begin")))
    d = d.where("piece > 0 or lap = 0").withColumn("nth", F.when(F.col("piece") > 0, F.floor(F.col("begin") / F.col("each"))))
    out = d.join(s, d["source"].eqNullSafe(s["source_"]) & (d["nth"] == s["nth_"]), "left")
    return out.drop("source_", "nth", "nth_", "before", "begin", "each")


def order_hash(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """The documents of the mix: the columns of `docs`, a row for each lap that takes words of a document.

    Adds mix_lap, mix_slot (the slot that the document begins in: the order of the mix) and mix_words. A document
    of which only the first words are taken, one for each source, has its text cut to these, joined by one space;
    a document longer than a block keeps its place at the slot of its first word. A null text has size 0;
    documents of size 0, or that no lap reaches, are left out. A null source is a source. Repeated rows are
    documents of their own, in the order of all their columns. Columns of the three names are replaced, others
    may have any name. An empty table gives an empty result. Reruns agree: order comes from hashes, slots from
    points.
    """
    h, n = fresh(docs, "mix_h"), fresh(docs, "mix_copy")
    alike = Window.partitionBy(f"`{doc_id}`", h, f"`{source}`").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not docs.schema[c].dataType.typeName().startswith("map")]))
    keyed = docs.withColumn(h, F.xxhash64(F.col(f"`{text}`"))).withColumn(n, F.row_number().over(alike))
    sizes = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{source}`").alias("source"), count_words(F.col(f"`{text}`")).alias("size"))
    sizes = sizes.groupBy("id", "tie", "source", "size").agg(F.count("*").alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    sizes = written(sizes.select("id", "tie", "source", copies, "size", order_hash(F.col("id")).alias("h")), "sizes")
    plan = mix_plan(sizes, weights, share, most, block).where("piece > 0")
    plan = plan.withColumnRenamed("piece", "words")
    plan = plan.select(*[F.col(c).alias(f"mix_plan_{c}") for c in ("id", "tie", "source", "size", "copy", "lap", "words", "slot")])
    on = keyed[doc_id].eqNullSafe(plan["mix_plan_id"]) & (keyed[h] == plan["mix_plan_tie"]) & keyed[source].eqNullSafe(plan["mix_plan_source"]) & (keyed[n] == plan["mix_plan_copy"])
    cut = F.when(F.col("mix_plan_words") < F.col("mix_plan_size"), F.array_join(F.slice(words(F.col(f"`{text}`")), F.lit(1), F.col("mix_plan_words").cast("int")), " ")).otherwise(F.col(f"`{text}`"))
    mine = {"mix_lap": "lap", "mix_slot": "slot", "mix_words": "words"}
    kept = [c for c in docs.columns if c.lower() not in mine]
    return keyed.join(plan, on).select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in kept], *[F.col(f"mix_plan_{v}").alias(k) for k, v in mine.items()])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size"), order_hash(F.col("doc_id")).alias("h"), F.xxhash64("text").alias("tie"))
    sizes = written(sizes, "sizes")
    return mix_plan(sizes).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("piece").alias("taken"), F.min("slot").alias("slot")).drop("row")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS full_, coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM s WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT min_by((budget - filled) / open_, full_ / weight) AS level FROM f WHERE (budget - filled) / open_ * weight < full_
), t AS (
  SELECT source, source_size, least(full_, coalesce((SELECT level FROM l) * weight, full_)) AS target FROM f
), i AS (
  SELECT source, target, row_number() OVER w AS place, coalesce(sum(target) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS low
  FROM t WHERE target > 0 WINDOW w AS (ORDER BY source IS NULL, source)
), v AS (
  SELECT *, lead(low, 1, 2.0) OVER (ORDER BY place) AS high FROM i
), n AS (
  SELECT greatest(1024, ceil(sum(target) / 8192))::BIGINT AS slots FROM i
), p AS (
  SELECT slot, (slot * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range(slots)) AS slot FROM n)
), g AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM p JOIN v ON u >= low AND u < high
), a AS (
  SELECT source, slot, nth FROM g
  UNION ALL SELECT source, (SELECT slots FROM n) - 1 + place, 0 FROM v WHERE NOT EXISTS (FROM g WHERE g.source IS NOT DISTINCT FROM v.source)
), b AS (
  SELECT source, greatest(1, ceil(floor(any_value(target)) / count(*)))::BIGINT AS each_ FROM a JOIN v USING (source) GROUP BY source
  UNION ALL SELECT NULL, greatest(1, ceil(floor(any_value(target)) / count(*)))::BIGINT FROM a JOIN v ON a.source IS NULL AND v.source IS NULL HAVING count(*) > 0
), o AS (
  SELECT doc_id, size, d.source, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, (greatest(0, least(before + size, floor(target)) - before) + greatest(0, least(source_size + before + size, floor(target)) - source_size - before))::BIGINT AS taken,
         CASE WHEN size > 0 AND before < floor(target) THEN before END AS begin_
  FROM o
)
SELECT doc_id, size, source_size, target, taken, slot
FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source
LEFT JOIN a ON a.source IS NOT DISTINCT FROM x.source AND a.nth = begin_ // each_
"""
