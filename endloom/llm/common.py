"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: blank, tab to carriage return.
WHITESPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster
    names one, else, with a local master alone (tests), a fresh temporary folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="endloom-checkpoint-"))
    return configured or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; runs a job. The files stay
    until the folder is cleared, unless the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, whatever else (and in
    whatever clashing names) the caller's frame holds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


#: Rows from which a key of a join may count as hot, and the most keys that do.
HOT_ROWS, HOT_KEYS = 500, 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, which has one row a key and in n_left the number
    of left's rows with it. Keys with over max(HOT_ROWS, total / HOT_KEYS) of left's total
    rows, at most HOT_KEYS of them, are broadcast, so their rows stay where they are; the
    others meet by a shuffle. Reads left twice."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(right.where(F.col("n_left") > least).drop("n_left"))
    cold = right.where(F.col("n_left") <= least).drop("n_left")
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, how))
