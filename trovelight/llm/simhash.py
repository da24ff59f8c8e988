"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits are cut into segments. If two differ in d bits or fewer, then in some segment
they differ in at most a small radius, so one of them lies in the Hamming ball around the other's segment.
The tables hold each distinct fingerprint once per segment; every fingerprint enumerates the balls around
its own segments, fetches what the tables hold there, and complete distances are verified. Of two
segments that differ, only the one with a 0 at the lowest differing place enumerates, which halves the work.

With more fingerprints than keys, buckets fill up with strangers. Then more and more of them are refined: their rows go
by one more part of the fingerprint, of which linked ones share at least one. So work follows the number of fingerprints without a step.

Equal fingerprints are one entry, so copies cost nothing. A bucket yields the edges of a spanning forest
of its verified links, never all its pairs. Buckets with many table entries (few enough to name, by a
bounded sketch) are dealt out in blocks, so that none is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize
from .components import connected_components


def simhash(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bit k is set if more than half of the shingles' XXH64 have it. A-Z are lower-cased, no words give 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per row of docs."""
    fields = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x, shingle, seed) for x in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id bigint, fp bigint")


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: if a pair is within distance, some segment is within its radius."""
    radius = distance // count
    wide = distance - count * radius  # segments 0 .. wide keep the radius, the others may have one less
    edges = [64 * k // count for k in range(count + 1)]
    found = [(edges[k], edges[k + 1] - edges[k], radius if k <= wide else radius - 1) for k in range(count)]
    return [x for x in found if x[2] >= 0]


def segment_count(distance: int) -> int:
    return max(3, distance // 4)


def refined_share(n: int, width: int) -> float:
    """The share of a segment's buckets that are refined, for n fingerprints and keys of so many bits.

    None up to 32 table entries a bucket, all from 128 on, and in between as many more as there are more fingerprints.
    """
    return min(1.0, max(0.0, (n / (1 << width) / 32 - 1) / 3))


def _ball(value, width: int, radius: int) -> F.Column:  # noqa: ANN001
    """Keys within radius of value (itself left out) whose lowest changed bit is 0 in value."""
    masks = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
    if not masks:
        return F.array().cast("array<bigint>")
    literal = F.expr("array(" + ",".join(f"{m}L" for m in masks) + ")")
    return F.transform(F.filter(literal, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0), lambda m: value.bitwiseXOR(m))


def _entry(segment: int, value, probe: bool) -> F.Column:  # noqa: ANN001
    return F.struct(value.bitwiseOR(F.lit(segment << 40)).alias("key"), F.lit(probe).alias("probe"))


def _prober(segment: int):  # noqa: ANN202
    # One parameter and no more: a second one would be given the place in the array.
    return lambda x: _entry(segment, x, True)


def _refined(fp, shift: int, width: int, key, distance: int) -> F.Column:  # noqa: ANN001
    """Keys of a bucket's parts: of distance + 1 parts of the bits outside of the segment two linked fingerprints share one.

    Keys are hashes; those that meet by chance only put strangers together, which complete distances tell apart.
    """
    rest, edges = 64 - width, [k * (64 - width) // (distance + 1) for k in range(distance + 2)]
    turned = fp if not shift + width else F.shiftrightunsigned(fp, (shift + width) % 64).bitwiseOR(F.shiftleft(fp, (64 - shift - width) % 64))
    parts = [F.shiftrightunsigned(turned, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert edges[-1] == rest
    return F.array(*[F.xxhash64(key, F.lit(k), part) for k, part in enumerate(parts)])


def bucket_rows(distinct: DataFrame, n: int, distance: int, refined: float | None = None) -> DataFrame:
    """fp, key, probe: every fingerprint once in the tables and as often as its balls ask among the probes.

    refined is the share of buckets whose keys are refined, by default what n asks for.
    """
    rows = None
    for k, (shift, width, radius) in enumerate(segments(distance, segment_count(distance))):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        entries = F.concat(F.array(_entry(k, value, False)), F.transform(_ball(value, width, radius), _prober(k)))
        own = distinct.select("fp", F.explode(entries).alias("e")).select("fp", "e.key", "e.probe")
        share = refined_share(n, width) if refined is None else refined
        if share:
            chosen = F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 20)) < int(share * (1 << 20))
            own = own.select("fp", F.explode(F.when(chosen, _refined(F.col("fp"), shift, width, F.col("key"), distance)).otherwise(F.array("key"))).alias("key"), "probe")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def links(distinct: DataFrame, n: int, distance: int = 4, block: int = 2048, refined: float | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most distance bits connect. distinct: fp, each once; n rows."""
    rows = bucket_rows(distinct, n, distance, refined)
    spark = distinct.sparkSession
    # Table buckets of more than a block: the sketch names candidates (1000 at most), an exact count decides.
    tables = rows.where(~F.col("probe"))
    named = [r.key for r in tables.agg(F.expr("approx_top_k(key, 1000, 20000)").alias("t")).select(F.explode("t.item").alias("key")).collect()]
    candidates = F.broadcast(spark.createDataFrame([(k,) for k in named], "key bigint"))
    counted = tables.join(candidates, "key", "left_semi").groupBy("key").count().where(F.col("count") > block).collect()
    blocks = F.broadcast(spark.createDataFrame([(r.key, -(-r["count"] // block)) for r in counted], "key bigint, blocks bigint"))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = rows.join(blocks, "key", "left").select("key", "fp", "probe", "blocks", own.cast("long").alias("own"))
    # A table entry is at home in one block and a probe in the others.
    spread = dealt.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("probe").alias("probe")))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), (F.col("probe") | (b != F.col("own"))).alias("probe"))))).alias("x"))
    sorted_rows = spread.select("key", "x.block", "x.probe", "fp").repartition("key", "block").sortWithinPartitions("key", "block", "probe", "fp")
    return sorted_rows.mapInArrow(_matcher(distance), "a bigint, b bigint").distinct()


def _matcher(distance: int, small: int = 64, pairs_at_once: int = 1 << 20):  # noqa: ANN202
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b) <= distance

    def of_small(fp: np.ndarray, table: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links in runs of few table entries: each row against the table entries ahead of it in its run."""
        n = len(fp)
        ahead = np.concatenate([[0], np.cumsum(table)])
        counts = ahead[:n] - ahead[start]
        step = 0
        while step < n:
            stop = step + max(1, int(np.searchsorted(np.cumsum(counts[step:]), pairs_at_once)))
            c = counts[step:stop]
            row = np.repeat(np.arange(step, min(stop, n)), c)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            other = start[row] + nth  # table entries come first in a run
            hit = near(fp[row], fp[other])
            yield fp[row[hit]], fp[other[hit]]
            step = stop

    class Run:
        """A run of many table entries: their labels tell what is connected so far."""

        def __init__(self, key: tuple) -> None:
            self.key, self.fp, self.label = key, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def add(self, rows: np.ndarray, table: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                first = len(self.fp)
                if table:
                    self.fp = np.concatenate([self.fp, part])
                    self.label = np.concatenate([self.label, np.arange(first, len(self.fp))])
                hit = near(part[:, None], self.fp[None, :])
                out = []
                for i in np.nonzero(hit.any(axis=1))[0]:
                    limit = first + i if table else len(self.fp)
                    at_hit = np.nonzero(hit[i, :limit])[0]
                    if not len(at_hit):
                        continue
                    labels, where = np.unique(self.label[at_hit], return_index=True)
                    out += [(part[i], self.fp[at_hit[w]]) for w in where]
                    if table:
                        labels = np.append(labels, self.label[first + i])
                    if len(labels) > 1:
                        self.label[np.isin(self.label, labels)] = labels[0]
                if out:
                    a, b = zip(*out, strict=True)
                    yield np.array(a, np.uint64), np.array(b, np.uint64)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=fields)

        open_run: Run | None = None  # the last run of the batch before, which may go on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            table = ~batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy().view(np.uint64)
            cut = np.concatenate([[0], np.nonzero((np.diff(key) != 0) | (np.diff(block) != 0))[0] + 1, [n]])
            sizes = np.diff(cut)
            start = np.repeat(cut[:-1], sizes)
            tables = np.add.reduceat(table.astype(np.int64), cut[:-1])
            special = {0, len(sizes) - 1} | set(np.nonzero(tables > small)[0].tolist())
            plain = np.ones(n, bool)
            for r in sorted(special):
                a, b = cut[r], cut[r + 1]
                plain[a:b] = False
                name = (int(key[a]), int(block[a]))
                if open_run is None or open_run.key != name:
                    open_run = Run(name)
                t = a + int(tables[r])
                yield from edges(open_run.add(fp[a:t], True))
                if len(open_run.fp):
                    yield from edges(open_run.add(fp[t:b], False))
            keep = np.nonzero(plain & (np.repeat(sizes, sizes) > 1) & (np.repeat(tables, sizes) > 0))[0]
            if len(keep):
                moved = np.zeros(n, np.int64)
                moved[keep] = np.arange(len(keep))
                yield from edges(of_small(fp[keep], table[keep], moved[start[keep]]))

    return match


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Fingerprints link at distance bits or fewer, equal ones too. A text without words has fingerprint 0
    and links like any other, so null, empty and blank texts are one component. A null id never becomes
    a component's id unless all its ids are null. Rows that repeat an id keep it. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = connected_components(links(classes.select("fp"), classes.count(), distance))
    nodes = materialize(nodes.join(classes, nodes["node"] == classes["fp"]).select("fp", "rep", "component"), "nodes")
    smallest = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = nodes.join(smallest, "component").select(F.col("fp").alias("linked_fp"), "component_id")
    merged = classes.join(linked, classes["fp"] == linked["linked_fp"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(merged, fps["fp"] == merged["class_fp"]).select("doc_id", "fp", "component_id")
