"""What several training-data operators need: intermediate tables, group counts, skew-proof running sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition used throughout: U+0009-U+000D and the space.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder of its own.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="marlspike-")
    atexit.register(shutil.rmtree, where, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written(), or rows chosen from one, that no later action reads."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet, whatever the letter case."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = "_" + name
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, unchanged; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, WS + "+"), ""), F.array().cast("array<string>"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, keys: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before this one.

    Rows are ordered by (cell, *order), where `cell` is a column that rises with the order wanted. A window
    runs inside each cell only; the cells of a key are joined by the running sum of their totals. So a key
    that holds a third of all rows is spread over as many tasks as it has cells.
    """
    total, before = fresh(df, "cell_total"), fresh(df, "cell_before")
    per_key = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, cell).agg(F.sum(value).alias(total))
    cells = cells.withColumn(before, F.coalesce(F.sum(total).over(per_key), F.lit(0))).drop(total)
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, cell]]
    joined = local.alias("l").join(cells.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{out}") + F.col(f"r.{before}")).alias(out))
