"""Vector best-fit packing.

A sequence has three residual capacities: tokens, documents, attention cost (the sum of squared lengths).
Items go in decreasing length to the open sequence, among those with room in every dimension, that best
fits: the largest weighted dot product of item and residuals, or the smallest weighted norm of what would
be left. Items are dealt by hash into shards of about shard_items, each packed in one task; a shard
wastes about one sequence, so the loss is a fraction of a per mille, and memory doesn't grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused


#: Weights of op3 and the pipeline. Limits on documents and attention cost can't bind within a sequence's
#: tokens there, so these two only choose among sequences that a piece would fill alike.
PACKING_WEIGHTS = (1.0, 1e-9, 1e-9)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Every item must fit an empty sequence. Ties go to the earliest bin.

    Sequences are filled in the order that items come in when sorted by length, longest first.
    """
    capacity = np.array([tokens, documents, attention], dtype=float)
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((64, 3))  # residuals of open bins, as shares of capacity
    name = np.empty(64, np.int64)
    n_open = n_bins = 0
    scale = np.array(weights)
    smallest = lengths.min() if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / capacity
        if (need > 1 + 1e-12).any():
            raise ValueError(f"an item of {lengths[i]} tokens fits no sequence")
        best = -1
        if n_open:
            room = left[:n_open] - need
            fits = (room >= -1e-12).all(axis=1)
            if fits.any():
                value = -(left[:n_open] * need) @ scale if score == "dot" else (room * room) @ scale
                best = int(np.argmin(np.where(fits, value, np.inf)))
        if best < 0:
            if n_open == len(left):
                left, name = np.resize(left, (2 * n_open, 3)), np.resize(name, 2 * n_open)
            best, n_open = n_open, n_open + 1
            left[best], name[best] = 1.0, n_bins
            n_bins += 1
        where[i] = name[best]
        offset[i] = round((1 - left[best, 0]) * tokens)
        left[best] -= need
        if left[best, 0] * tokens < smallest - 0.5 or (left[best] < 1e-12).any():  # full: no item can follow
            n_open -= 1
            left[best], name[best] = left[n_open], name[n_open]
    return where, offset


def pack_sequences(pieces: DataFrame, n_items: int, tokens: int = 2048, documents: int | None = None, attention: float | None = None, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0), shard_items: int = 4096) -> DataFrame:
    """pieces with two more columns: sequence_id, offset (gapless from 0 in each sequence).

    pieces has doc_id, piece, length and any payload, which travels along. n_items is the number of its
    rows; it sets the number of shards. Without a limit for documents or attention that dimension never
    binds before tokens do. Equal rows are packed as separate items, and so are rows without an id; no
    items give no sequences. Sequences of different shards differ in id. Items as long as a sequence need
    no search and no shuffle. Payload columns called sequence_id or offset are replaced.
    """
    mark = unused(pieces, "shard")
    pieces = pieces.drop("sequence_id", "offset")
    documents = documents or tokens
    attention = attention or float(tokens) ** 2
    shards = max(1, math.ceil(n_items / shard_items))
    alone = (F.col("length") >= tokens) & F.lit(documents >= 1 and attention >= tokens**2)
    # A whole sequence takes an id of its own: odd numbers, while shards use even ones.
    whole = pieces.where(alone).select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = T.StructType([*pieces.schema.fields, T.StructField(mark, T.IntegerType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # The row's number spreads what has one id or none; the rows are a table's, so it is the same in a rerun of a task.
    rest = pieces.where(~alone).withColumn(mark, F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            # The order of rows from a shuffle varies; the result must not.
            order = np.lexsort([table["length"].to_numpy(), table["piece"].to_numpy(), pc.fill_null(table["doc_id"], -1).to_numpy()])
            table = table.take(pa.array(order))
            where, offset = best_fit(table["length"].to_numpy(), tokens, documents, attention, score, weights)
            shard = table[mark][0].as_py()
            table = table.append_column("sequence_id", pa.array(((shard << 32) + where) * 2, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from table.to_batches(max_chunksize=8192)

        for batch in batches:  # sorted by shard, so each shard is one run
            shard = batch.column(mark).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[-1].column(mark)[0].as_py() != shard[a]:
                    yield from settle(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from settle(pa.Table.from_batches(held))

    packed = rest.repartition(F.col(mark)).sortWithinPartitions(mark).mapInArrow(pack, schema).drop(mark)
    return packed.unionByName(whole.select(*packed.columns))
