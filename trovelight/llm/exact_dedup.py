"""Exact dedup by heavy-hitter split.

Misra-Gries summaries find the digests that may hold more than a share of the rows. There are at most
2 / share of them, by construction, so their verified winners (smallest id, exact count) are broadcast
and their rows are settled map-side. All other digests, none of them larger than the share, take an
ordinary shuffle of (id, digest).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize


class MisraGries:
    """A mergeable summary of k counters: low(x) <= count(x) <= low(x) + n / (k + 1)."""

    def __init__(self, k: int):
        self.k, self.low = k, Counter()

    def add(self, counts: Counter) -> None:
        self.low.update(counts)
        if len(self.low) > self.k:
            cut = sorted(self.low.values(), reverse=True)[self.k]
            self.low = Counter({x: c - cut for x, c in self.low.items() if c > cut})


def frequent_digests(digests: DataFrame, n: int, share: float) -> list[bytes]:
    """Every digest with more than share * n rows, and at most 2 / share digests in all."""
    k = round(2 / share)
    schema = pa.schema([("digest", pa.binary()), ("low", pa.int64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(k)
        for batch in batches:
            summary.add(Counter(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(summary.low.keys(), pa.binary()), pa.array(summary.low.values(), pa.int64())], schema=schema)

    # Sums of lower bounds miss at most n / (k + 1) < share * n / 2 of a digest's rows.
    merged = digests.select("digest").mapInArrow(summarise, "digest binary, low bigint").groupBy("digest").agg(F.sum("low").alias("low"))
    return [bytes(r.digest) for r in merged.where(F.col("low") > share * n / 2).select("digest").collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 1 / 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of ASCII white space is one space (nothing is trimmed).
    Null text counts as empty. Rows that repeat an id stay or go together: kept is doc_id = keep_id.
    A null id loses against any other; a group of null ids alone keeps all its rows. An empty table
    gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS + "+", " ")
    base = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest")), "digests")
    found = frequent_digests(base, base.count(), share)
    frequent = F.broadcast(spark.createDataFrame([(bytearray(x),) for x in found], "digest binary"))
    winners = base.join(frequent, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = base.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    light = base.join(frequent, "digest", "left_anti").select("*", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
