"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed n-grams. Two histograms, one bounded array each, give every bucket
a gain; a document's weight is the sum of an array's entries, and noise keyed by its id turns weights into scores whose
highest are a draw without replacement. The draw is an external sort of what can be drawn: each partition writes its
documents as a run sorted by score; sampled splitters cut the head of the runs into ranges, whose exact counts say at
which rank each begins; a range's share of the k runs is merged by a tournament tree, which stops at the draw's last rank. Ranges
behind it, and documents below the head, are never merged or moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, release
from .words import word_parts

BUCKETS = 10_000
#: Rows of a range, about.
RANGE_ROWS = 250_000
#: Rows sampled for each range.
SAMPLES = 40


def bucket_parts(data: bytes, longest: int = 3, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of all runs of 1 to longest words that end there) of the parts of a text, some megabytes each."""
    tail: list[bytes] = []
    for words in word_parts(data):
        grams: list[int] = []
        told = [b" " + w for w in tail + words]
        sums = list(map(crc32, tail + words))
        for k in range(1, longest + 1):  # sums: of the runs of k words, by their first word
            grams += sums[max(len(tail) - k + 1, 0) :]
            sums = list(map(crc32, told[k:], sums))
        tail = (tail + words)[-(longest - 1) :] if longest > 1 else []
        yield len(words), np.array(grams, np.int64) % buckets


def histogram(texts: DataFrame, text_col: str = "text", longest: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                for _, found in bucket_parts(data, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the raw texts."""
    told = (target + 1.0) * (raw.sum() + float(len(raw))) / ((raw + 1.0) * (target.sum() + float(len(raw))))
    return np.array([floor(1000 * log(x)) for x in told], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousand times Gumbel noise, keyed by seed and id."""
    told = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{told}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: int, longest: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                n_words = n_features = weight = 0
                for n, found in bucket_parts(data, longest, len(gain)):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, n_words, n_features, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=fields)

    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return told.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


class TournamentTree:
    """Merge of k sorted runs: every inner node holds the winner of the match below it, the root the smallest head."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        heads = [next(r, None) for r in runs]
        self.node: list[tuple | None] = [None] * self.size + [None if h is None else (h, i) for i, h in enumerate(heads)] + [None] * (self.size - len(runs))
        for k in range(self.size - 1, 0, -1):
            self._play(k)

    def _play(self, k: int) -> None:
        a, b = self.node[2 * k], self.node[2 * k + 1]
        self.node[k] = a if b is None or a is not None and a < b else b

    def __iter__(self) -> Iterator[tuple]:
        while (won := self.node[1]) is not None:
            yield won[0]
            head = next(self.runs[won[1]], None)
            k = self.size + won[1]
            self.node[k] = None if head is None else (head, won[1])
            while k := k // 2:
                self._play(k)


_RANKED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])
_ORDER = ("fall", "doc_key", "place")


def _merge(rows: DataFrame, begins: list[int], draw: int) -> DataFrame:
    """rows with ranks. Each task's rows have ranges of their own; their ascending stretches are the runs of a range."""
    names = ["range", *_ORDER, *_RANKED.names[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        column = {name: table[name].to_numpy() for name in ("range", *_ORDER)}
        for wanted in np.unique(column["range"]):
            at = np.nonzero(column["range"] == wanted)[0]
            key = [column[name][at] for name in _ORDER]
            down = key[0][1:] < key[0][:-1]
            for major, minor in ((0, 1), (1, 2)):
                same = np.all([k[1:] == k[:-1] for k in key[: major + 1]], axis=0)
                down |= same & (key[minor][1:] < key[minor][:-1])
            edges = [0, *(np.nonzero(down)[0] + 1).tolist(), len(at)]
            tree = TournamentTree([zip(*(k[a:b].tolist() for k in key), at[a:b].tolist(), strict=True) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            begin = begins[wanted]
            drawn = np.fromiter((row[-1] for row, _ in zip(tree, range(draw - begin), strict=False)), np.int64)
            rest = np.setdiff1d(at, drawn, assume_unique=True)
            ranks = pa.array(np.arange(begin + 1, begin + 1 + len(drawn)), pa.int64())
            for part, rank in ((drawn, ranks), (rest, pa.nulls(len(rest), pa.int64()))):
                if len(part):
                    kept = table.select(_RANKED.names[:-1]).take(pa.array(part)).append_column("rank", rank).combine_chunks()
                    yield from kept.cast(_RANKED).to_batches()

    return rows.select(*names).mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint")


def _ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """rows with the number of their range: how many splitters are not behind them."""
    held = rows.sparkSession.sparkContext.broadcast(splitters)
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = held.value
        for batch in batches:
            key = np.zeros(batch.num_rows, edges.dtype)
            for name in _ORDER:
                key[name] = batch.column(name).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, key, "right"), pa.int64()), *batch.columns], names=["range", *batch.schema.names])

    return rows.mapInArrow(run, ", ".join(["range bigint", *(f"{name} {kind}" for name, kind in fields)]))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, min_words: int = 20, longest: int = 3, seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (1, 2, 3... by falling score, null if not drawn).

    Of the rows with min_words words or more, percent per cent, rounded down, are drawn: those with the highest
    scores, ties to the smaller doc_id, a null one last, and then to either row. Repeated rows, and rows that repeat an id, are rows of
    their own, but share the noise of their id; rows without an id share that of the empty id. A null or empty text has no
    features and a weight of 0, and is not drawn. No target texts make all shares equal there; no rows give none. Texts
    are read whole, some megabytes at a time.
    """
    spark = docs.sparkSession
    gain = gains(histogram(docs, text_col, longest), histogram(target, target_col, longest))
    scored = weighed(docs, gain, id_col, text_col, seed, longest)
    key = [(-F.col("score")).alias("fall"), F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("doc_key"), F.monotonically_increasing_id().alias("place")]
    eligible = F.col("n_words") >= min_words
    # A partition's rows are one sorted run: those that may be drawn first, by falling score.
    runs = materialize(scored.select("*", eligible.alias("eligible"), *key).sortWithinPartitions(F.col("eligible").desc(), *_ORDER), "runs")
    n = runs.where("eligible").count()
    draw = n * percent // 100
    last = _bound(runs, draw, n)
    head = runs.where(F.col("eligible") & (F.col("fall") <= last)) if draw else runs.where(F.lit(False))
    rest = runs.where(~F.col("eligible") | (F.col("fall") > last)) if draw else runs
    rest = rest.select(*_RANKED.names[:-1], F.lit(None).cast("long").alias("rank"))
    if not draw:
        return rest
    step = max(1, range_rows // SAMPLES)
    sample = head.where(F.pmod(F.xxhash64(*_ORDER), F.lit(step)) == 0).select(*_ORDER).collect()  # some SAMPLES rows a range
    sampled = np.sort(np.array([tuple(r) for r in sample], dtype=[(name, np.int64) for name in _ORDER]))
    dealt = _ranges(head, sampled[SAMPLES - 1 :: SAMPLES])
    sizes = {r.range: r["count"] for r in dealt.groupBy("range").count().collect()}
    begins = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes) + 1))]
    reached = max(k for k in sizes if begins[k] < draw)
    merged = _merge(dealt.where(F.col("range") <= reached).repartition(reached + 1, "range"), begins, draw)
    beyond = dealt.where(F.col("range") > reached).select(*_RANKED.names[:-1], F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(beyond).unionByName(rest)


def _bound(runs: DataFrame, draw: int, n: int) -> int:
    """A key that at least draw of the n eligible rows don't exceed, and few more: a quantile by sketch, checked by a count."""
    share, slack = draw / max(n, 1), 0.001
    while share + slack < 1:
        last = runs.where("eligible").agg(F.percentile_approx("fall", F.lit(share + slack), F.lit(10_000))).first()[0]
        if runs.where("eligible").where(F.col("fall") <= last).count() >= draw:
            return last
        slack *= 4
    return runs.where("eligible").agg(F.max("fall")).first()[0]
