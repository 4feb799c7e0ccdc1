"""Where a job may put tables that all executors can see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows dealt out by keys into as many partitions as the session shuffles to, or ``least`` if that is more.

    The number is given, so that it is not reduced by the rows' size where each of them
    becomes many, or much work.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a session of one machine may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="deckjobs-")
    return f"{root.rstrip('/')}/deckjobs-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that several later steps read, written to shared storage once; cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def divided(tagged: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of a table with ``reason``: written once, parted at the write, and read as two tables."""
    path = shared_folder(tagged.sparkSession, name)
    tagged.withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(path)
    both = tagged.sparkSession.read.schema(f"{tagged.schema.toDDL()}, rejected boolean").parquet(path)
    return both.where("not rejected").drop("reason", "rejected"), both.where("rejected").drop("rejected")
