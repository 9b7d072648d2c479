"""Tables that queries write for others to read, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="marlspike-core-")
    atexit.register(shutil.rmtree, where, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"
