"""Chat formatting: logged snapshots that only prefix a longer conversation collapse into it; the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import running_sum

CELL = 256  # turns that one window and one rendered piece hold


def maximal_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", cell: int = CELL) -> DataFrame:
    """The turns of the conversations that prefix no other: (conv_id, place, role, text), place from 0.

    A conversation is its turns ordered by (turn, role, text), nulls first. Each turn has a 128-bit hash of its
    place, role and text; the running xor of these identifies every prefix. A conversation goes if its whole
    hash and length equal those of a shorter part of another one, or of an equal conversation with a smaller
    id. Rows with a null conv_id belong to no conversation and go. A null role or text differs from an empty
    one. Repeated rows of a turn count as turns of their own.

    Places come from running sums over cells of turns, and no window or group holds a whole conversation, so one
    conversation may hold a third of all rows.
    """
    t = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    t = t.withColumn("cell", F.coalesce(F.floor(F.col("turn") / cell), F.lit(-(2**62)))).withColumn("one", F.lit(1))
    t = running_sum(t, ["conv_id"], "cell", ["turn", "role", "text"], "one", "place")
    said = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    t = t.select("conv_id", "place", "role", "text", F.floor(F.col("place") / cell).alias("cell"), F.xxhash64("place", said).alias("a"), F.xxhash64(said, F.lit("b"), "place").alias("b"))

    inside = Window.partitionBy("conv_id", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = t.groupBy("conv_id", "cell").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
    cells = cells.select("conv_id", "cell", F.coalesce(F.bit_xor("ca").over(earlier), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("cb").over(earlier), F.lit(0)).alias("cb"))
    prefixes = t.select("conv_id", "cell", "place", F.bit_xor("a").over(inside).alias("ia"), F.bit_xor("b").over(inside).alias("ib")).join(cells, ["conv_id", "cell"])
    prefixes = prefixes.select("conv_id", (F.col("place") + 1).alias("n"), F.expr("ia ^ ca").alias("ha"), F.expr("ib ^ cb").alias("hb"))
    # several conversations may share a prefix: its longest owner, and of these the one with the smallest id, decides
    whole = t.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor("a").alias("ha"), F.bit_xor("b").alias("hb"))
    length = whole.select("conv_id", F.col("n").alias("full"))
    owned = prefixes.join(length, "conv_id").groupBy("n", "ha", "hb").agg(F.min(F.struct((-F.col("full")).alias("full"), "conv_id")).alias("owner"))
    gone = whole.join(owned, ["n", "ha", "hb"]).where(F.col("owner.conv_id") != F.col("conv_id")).select("conv_id")
    return t.join(gone, "conv_id", "left_anti").select("conv_id", "place", "role", "text")


def render(turns: DataFrame, cell: int = CELL) -> DataFrame:
    """Chat markup of (conv_id, place, role, text): one row for each conversation and piece of up to `cell` turns.

    The pieces of a conversation, joined in order, are its text; nearly every conversation is one piece. A null
    role is written as user, a null text as empty.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    t = turns.select("conv_id", F.floor(F.col("place") / cell).alias("piece"), F.struct("place", line.alias("line")).alias("x"))
    t = t.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return t.select("conv_id", "piece", F.size("x").cast("long").alias("n_turns"), F.array_join("x.line", "").alias("rendered"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c d WHERE d.conv_id <> c.conv_id AND d.n >= c.n AND d.said[1:c.n] = c.said AND (d.n > c.n OR d.conv_id < c.conv_id))
), turns AS (
  SELECT conv_id, unnest(said) AS s, generate_subscripts(said, 1) - 1 AS place FROM kept
)
SELECT conv_id, place // 256 AS piece, count(*) AS n_turns,
       string_agg('<|' || coalesce(s.role, 'user') || '|>' || chr(10) || coalesce(s.text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM turns GROUP BY conv_id, piece
"""
