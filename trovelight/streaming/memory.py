"""Query log and feedback as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..operators import memory

_MOVES = "query_norm string, node_id string, bucket long, shift double, low double, high double, pos_count long, neg_count long, last_us long"
_WEIGHTS = "query_norm string, node_id string, weight double, pos_count long, neg_count long, last_used timestamp, batch_id long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once(log: DataFrame, delay: str = "1 hour", key: str = "query_id", time: str = "timestamp") -> DataFrame:
    """The log without rows that repeat an id inside the watermark."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(log: DataFrame, size: str = "7 days", slide: str | None = None, delay: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """Queries per key and window; late rows count until the watermark passes their window."""
    spec = F.window(time, size, slide) if slide else F.window(time, size)
    return log.withWatermark(time, delay).groupBy(spec, "query_norm").agg(F.count("*").alias("queries")).select("window.start", "window.end", "query_norm", "queries")


class _Bucket(StatefulProcessor):
    """Events of a stretch of time and a share of the keys wait in a list until the watermark has passed the stretch, and leave as one move a key."""

    def __init__(self, width_ms: int, seq: str):
        self.width_ms, self.seq = width_ms, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"query_norm string, node_id string, us long, seq {self.seq}, delta double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.waiting.exists():
            self.handle.registerTimer(int(key[0]) + self.width_ms - 1)
        for frame in rows:
            self.waiting.appendList(list(zip(*[frame[c].tolist() for c in ("query_norm", "node_id", "us", "seq", "delta")], strict=True)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = sorted(tuple(x) for x in self.waiting.get())
        self.waiting.clear()
        moves = []
        for of, group in groupby(events, key=lambda x: x[:2]):
            shift, low, high, pos, neg, at = 0.0, float("-inf"), float("inf"), 0, 0, None
            for *_, us, seq, delta in group:
                if (us, seq) == at:
                    continue
                at = (us, seq)
                floor, cap = (K.WEIGHT_FLOOR, float("inf")) if delta < 0 else (float("-inf"), K.WEIGHT_CAP)
                shift, low, high = shift + delta, min(max(low + delta, floor), cap), min(max(high + delta, floor), cap)
                pos, neg = pos + (delta > 0), neg + (delta < 0)
            moves.append((*of, int(key[0]), shift, float(low), float(high), pos, neg, at[0]))
        yield pd.DataFrame(moves, columns=[c.split()[0] for c in _MOVES.split(", ")])

    def close(self) -> None:
        pass


def moves(deltas: DataFrame, delay: str = "1 hour", bucket_ms: int = 3_600_000, shares: int = 8) -> DataFrame:
    """deltas (query_norm, node_id, seq, delta, ts) to one move (shift, then clamp) per key and bucket, once the watermark has passed its end.

    So what waits is at most the delay and a bucket, a key's events lie in as many states as it has buckets, and a state
    ends with its bucket. Keys are dealt into shares by hash, and a state holds a bucket of one share: a call for
    each key and bucket costs far more than folding its few events. shares says in how many tasks a bucket can lie; a stream keeps it. Rows that
    repeat a key, time and seq in a bucket count once, with the least delta. Rows behind the watermark are late and dropped.
    Rows without key, time, seq or delta are left out. The sink puts moves in order of buckets.
    """
    seq = deltas.schema["seq"].dataType.simpleString()
    told = deltas.dropna(subset=["query_norm", "node_id", "seq", "delta", "ts"]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    bucket = (F.floor(F.unix_micros("ts") / (bucket_ms * 1000)) * bucket_ms).cast("long")
    share = F.pmod(F.xxhash64("query_norm", "node_id"), F.lit(shares)).cast("int")
    rows = told.select(bucket.alias("bucket"), share.alias("share"), "query_norm", "node_id", "ts", F.unix_micros("ts").alias("us"), "seq", F.col("delta").cast("double").alias("delta"))
    return rows.groupBy("bucket", "share").transformWithStateInPandas(_Bucket(bucket_ms, seq), _MOVES, "append", "EventTime")


def weights_sink(store, table: str = "weights") -> Callable[[DataFrame, int], None]:  # noqa: ANN001
    """A foreachBatch function that lays each batch's moves over a table of a SnapshotStore; a batch applied twice changes nothing.

    A bucket leaves with the first watermark behind its end, so a later batch has later buckets only. The table is written
    anew with each batch that has moves.
    """
    keys = ["query_norm", "node_id"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if rows.isEmpty():
                return
            move = F.struct("shift", "low", "high").alias("m")
            new = rows.select("*", move).groupBy(*keys).agg(memory.fold_moves(F.collect_list(F.struct("bucket", "m"))).alias("m"), F.sum("pos_count").alias("p"), F.sum("neg_count").alias("n"), F.timestamp_micros(F.max("last_us")).alias("t"))

            def merged(held: DataFrame | None) -> DataFrame:
                base = held if held is not None else batch.sparkSession.createDataFrame([], _WEIGHTS)
                both = base.join(new, keys, "full_outer")
                stays = F.col("m").isNull() | (F.coalesce("batch_id", F.lit(-1)) >= batch_id)
                pick = lambda old, other: F.when(stays, F.col(old)).otherwise(other).alias(old)
                zero = lambda c: F.coalesce(c, F.lit(0))
                return both.select(
                    *keys, pick("weight", memory.moved(F.coalesce("weight", F.lit(0.0)), F.col("m"))), pick("pos_count", zero("pos_count") + F.col("p")),
                    pick("neg_count", zero("neg_count") + F.col("n")), pick("last_used", F.col("t")), pick("batch_id", F.lit(batch_id).cast("long")),
                )

            store.update(table, merged)
        finally:
            rows.unpersist()

    return apply


def weights_of(store, table: str = "weights") -> DataFrame:  # noqa: ANN001
    """What weights_sink() has written so far; no rows where it has written nothing."""
    return store.read(table) if store.has(table) else store.spark.createDataFrame([], _WEIGHTS)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, as lists and timers need; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def fold_available(deltas: DataFrame, store, checkpoint: str, table: str = "weights", delay: str = "1 hour", bucket_ms: int = 3_600_000) -> None:  # noqa: ANN001
    """Fold what has arrived since the last call with this checkpoint into the store's table, then end.

    What the watermark (the latest time less the delay) hasn't passed waits in the checkpoint for a later call.
    """
    with state_in_rocksdb(deltas.sparkSession):
        run = moves(deltas, delay, bucket_ms).writeStream.foreachBatch(weights_sink(store, table)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def upsert_sink(store, table: str, key: list[str]):  # noqa: ANN001, ANN201
    """A foreachBatch function that merges each batch into a table of a SnapshotStore; a batch applied twice changes nothing."""
    from ..operators.graph import upsert

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = store.current() is None or not store.has(table)
        store.publish({table: batch if fresh else upsert(store.read(table), batch, key)}, keep_others=True)

    return apply


def arrivals(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Documents as their files arrive; with history.merge_history in foreachBatch they become versions."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
