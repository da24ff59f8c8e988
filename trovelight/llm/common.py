"""Helpers that the operators of this package share: shared storage, Arrow batches, heavy keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every operator here means it: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a folder of its own; a cluster is refused, since its
    machines don't see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="trovelight-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/trovelight/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.held_at = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more. Others are left alone."""
    for df in tables:
        if path := getattr(df, "held_at", None):
            discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Python workers get Arrow batches of at most `most` bytes: what a worker holds at once follows from it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(work: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that turns each batch into one with the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def unused(df: DataFrame, name: str) -> str:
    """name with as many underscores ahead of it as df's columns need, so that it is none of theirs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(column) -> F.Column:  # noqa: ANN001
    """A-Z to a-z and nothing else; F.lower would change other letters too."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_ascii(column) -> F.Column:  # noqa: ANN001
    return F.trim(column, F.lit(SPACE_BYTES.decode()))
