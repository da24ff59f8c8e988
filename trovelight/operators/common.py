"""Small helpers of the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, which all machines see; a local master without it gets a folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="trovelight-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        found = f"file://{_own_dir[0]}"
    return f"{found.rstrip('/')}/trovelight/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written to the scratch folder and read back: what is built on it reads it instead of making it again."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, **options)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.held_at = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more. Others are left alone."""
    for df in tables:
        if path := getattr(df, "held_at", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A broadcast hint if df has most_rows at most, counted no further than that; else df, for the planner to join as it can."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group of keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def cap_by(df: DataFrame, keys: list[str], most: int, *order: Column | str) -> DataFrame:
    """The first most rows of each group: a cap that is the feature."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
