"""Near copies by exact similarity of word shingles, with candidates from multi-index hashing.

Candidates come from two tables of fingerprints. SimHash fingerprints of the shingles meet by the ball search of
simhash.links(). A pair just at the threshold differs there in too many bits, so each text has a second, longer
fingerprint of BANDS segments, each of ROWS min-hashes: a pair of similarity s shares a segment with probability
1 - (1 - s^ROWS)^BANDS, 0.9993 at 0.8 and more above. Every link is verified by the exact similarity of the
shingle sets, so nothing below the threshold links. Texts of equal sets are one class.

Each class is first compared with its SimHash partners and with one other of each of its segments' buckets.
Buckets that still hold texts of several components are then settled whole: a matrix product counts the common
shingles of all texts of two blocks at once, and what it returns is the components of a block, never its pairs.
A bucket of more than a block is dealt out by pairs of blocks. A block is bounded by its texts' number and by the
bytes of their shingle sets, so long texts make more blocks and not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialize, release
from .components import connected_components
from .simhash import links as simhash_links

BANDS, ROWS = 24, 6


def shingle_hashes(data: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z are lower-cased. Fewer words are one shingle, no words none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)), np.uint64, last)


def majority(found: np.ndarray) -> int:
    """SimHash of shingle hashes: a bit is 1 if more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def segments_of(found: np.ndarray, odd: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """BANDS segments of the min-wise fingerprint of a set that is not empty."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        x = found[at : at + 512, None] * odd
        x += plus
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=0), out=least)
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.fromiter((xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)), np.uint64, BANDS)


def shingled(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, text_hash, h1, h2 (hashes of the shingle set), n (its size), fp, bands array<bigint>. docs: doc_id, text, text_hash."""
    longs = pa.list_(pa.int64())
    fields = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", longs)])
    draws = np.random.default_rng(seed)
    odd, plus = draws.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), draws.integers(0, 1 << 63, BANDS * ROWS, np.uint64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                each = shingle_hashes(data, shingle, seed)
                whole = np.unique(each)
                bands = segments_of(whole, odd, plus).view(np.int64) if len(whole) else np.zeros(0, np.int64)
                rows.append((xxhash.xxh64_intdigest(whole.tobytes(), 1), xxhash.xxh64_intdigest(whole.tobytes(), 2), len(whole), majority(each), bands))
            h1, h2, n, fp, bands = zip(*rows, strict=True) if rows else [()] * 5
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed(h1), signed(h2), pa.array(n, pa.int64()), signed(fp), pa.array(bands, longs)], schema=fields)

    return docs.mapInArrow(make, "doc_id bigint, text_hash bigint, h1 bigint, h2 bigint, n bigint, fp bigint, bands array<bigint>")


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """node and its shingle set (sorted 8-byte hashes) of texts (node, text)."""
    fields = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(x, shingle, seed)).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=fields)

    return texts.mapInArrow(make, "node bigint, shingles binary")


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _similar(tenths: int):  # noqa: ANN202
    """Pairs (a, b, a_set, b_set) to those whose sets are as similar as tenths / 10."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                hits.append((10 + tenths) * int((both[1:] == both[:-1]).sum()) >= tenths * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_LINK).filter(pa.array(hits, pa.bool_()))

    return check


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right: products of 0-1 matrices, some columns at a time."""
    every = np.concatenate([*left, *right])
    names, place = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    useful = np.bincount(place, minlength=len(names)) > 1  # a shingle of one set is common to none
    moved = np.cumsum(useful) - 1
    keep = useful[place]
    place, owner = moved[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24, and summed in whole numbers
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(useful.sum()), columns):
        a, b = np.searchsorted(place, [at, at + columns])
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[owner[a:b], place[a:b] - at] = 1
        np.matmul(block[: len(left)], block[len(left) :].T, out=out)
        total += out.astype(np.int64)
    return total


def block_links(nodes: tuple[list[int], list[int]], sets: tuple[list[np.ndarray], list[np.ndarray]], tenths: int) -> list[tuple[int, int]]:
    """Edges that connect what links between (or, if the right side is empty, within) two lists of texts connect."""
    within = not nodes[1]
    left, right = sets[0], sets[0] if within else sets[1]
    of_right = nodes[0] if within else nodes[1]
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    hit = (10 + tenths) * common_counts(left, right) >= tenths * (sizes[0][:, None] + sizes[1][None, :])
    label = [np.arange(len(left)), np.arange(len(right)) + (0 if within else len(left))]
    names = nodes[0] if within else [*nodes[0], *of_right]
    while True:  # the least label spreads over links
        a = np.minimum(label[0], np.where(hit, label[1][None, :], len(names)).min(axis=1))
        b = a if within else np.minimum(label[1], np.where(hit, a[:, None], len(names)).min(axis=0))
        if (a == label[0]).all() and (b == label[1]).all():
            break
        label = [a, b]
    found = label[0] if within else np.concatenate(label)
    return [(names[i], names[k]) for k, i in enumerate(found.tolist()) if i != k]


def _settle(tenths: int):  # noqa: ANN202
    """Rows (band, value, i, j, second, node, shingles), sorted by task (band, value, i, j), to links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, nodes, sets = None, ([], []), ([], [])

        def settled() -> Iterator[pa.RecordBatch]:
            if len(nodes[0]) + len(nodes[1]) > 1 and nodes[0] and (nodes[1] or name[2] == name[3]):
                edges = block_links(nodes, sets, tenths)
                if edges:
                    a, b = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)

        for batch in batches:
            for band, value, i, j, second, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != (band, value, i, j):
                    yield from settled()
                    name, nodes, sets = (band, value, i, j), ([], []), ([], [])
                nodes[second].append(node)
                sets[second].append(np.frombuffer(shingles, np.uint64))
        yield from settled()

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8, seed: int = 42, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id, text_hash (xxhash64 of the text), component_id (smallest doc_id reachable over links, itself included), first (struct of the doc_id and text_hash that stand for the component).

    Texts link at a similarity (Jaccard, of shingle sets) of tenths / 10 or more. Texts without words are one component.
    Null texts are empty. Null ids come last, so component_id is null where no row of a component has an id. Repeated
    rows come back as often; an empty table gives none; other columns are not looked at. A block of texts that are
    compared with each other holds about block texts and block_bytes bytes of shingle hashes (8 a distinct shingle); a
    text with more than that is a block by itself, give or take how the hash deals it.
    """
    bound_batches(docs.sparkSession, "2m")
    key = ["h1", "h2"]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = materialize(shingled(given, shingle, seed), "shingled")
    ids = rows.select("doc_id", "text_hash", *key)
    # h1 names a class of equal sets; one text of each goes on.
    least = F.min_by(F.struct("doc_id", "text_hash", "fp", "bands"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    classes = materialize(rows.groupBy(*key, "n").agg(least).select(*key, "n", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("rep_hash"), "one.fp", "one.bands"), "classes")

    # SimHash partners: classes of one fingerprint are linked to its first, fingerprints by multi-index hashing.
    of_fp = materialize(classes.where("n > 0").groupBy("fp").agg(F.min("h1").alias("node"), F.count("*").alias("n")), "fingerprints")
    equal = classes.where("n > 0").join(of_fp.where("n > 1").select("fp", "node"), "fp").where("h1 <> node").select(F.col("node").alias("a"), F.col("h1").alias("b"))
    near = simhash_links(of_fp.select("fp"), of_fp.count())
    named = lambda name: of_fp.select(F.col("fp").alias(f"{name}_fp"), F.col("node").alias(name))
    fp_pairs = near.select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(named("a"), "a_fp").join(named("b"), "b_fp").select("a", "b")

    banded = classes.select(F.col("h1").alias("node"), "n", F.posexplode("bands").alias("band", "value"))
    firsts = banded.groupBy("band", "value").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    buckets = materialize(banded.join(firsts, ["band", "value"]), "buckets")
    pairs = materialize(equal.unionByName(fp_pairs).unionByName(buckets.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    member = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select(F.col("h1").alias("node"), "rep", "rep_hash"), "node")
    found = given.join(member.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    # A row that is repeated is there several times; its set is the same.
    sets = materialize(_sets(found.select("node", "text"), shingle, seed).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    links = materialize(both.mapInArrow(_similar(tenths), "a bigint, b bigint"), "links")
    label = materialize(connected_components(links).select(F.col("node").alias("labelled"), "component").distinct(), "labels")

    # Buckets with several components: all their texts are compared, in blocks.
    parted = buckets.join(label, F.col("node") == F.col("labelled"), "left").select("band", "value", "n", F.coalesce("component", "node").alias("part"))
    mixed = parted.groupBy("band", "value").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("m"), F.sum("n").alias("shingles")).where("x < y").select("band", "value", F.ceil(F.greatest(F.col("m") / block, F.col("shingles") * 8 / block_bytes)).alias("blocks"))
    opened = buckets.join(mixed, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = opened.select("band", "value", "node", "own", other).select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("second"), "node")
    task = ["band", "value", "i", "j"]
    filled = dealt.join(sets, "node").select(*task, "second", "node", "shingles").repartition(*task).sortWithinPartitions(*task, "second", "node")
    more = materialize(filled.mapInArrow(_settle(tenths), "a bigint, b bigint"), "links")

    nodes = materialize(connected_components(links.unionByName(more)).distinct(), "nodes")
    merged = classes.join(nodes.select(F.col("node").alias("h1"), "component"), "h1", "left").select(*key, "rep", "rep_hash", F.coalesce("component", "h1").alias("component"))
    merged = materialize(merged, "merged")
    release(nodes, more, label, links, sets, pairs, buckets, of_fp, classes)
    first = F.min_by(F.struct(F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash")), F.struct(F.col("rep").isNull(), "rep", "rep_hash"))
    smallest = merged.groupBy("component").agg(first.alias("first"))
    told = merged.join(smallest, "component").select(*key, "first")
    return ids.join(told, key).select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), "first")


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs that stand for their component (see near_components()), one each, with all columns."""
    found = materialize(near_components(docs, id_col, text_col, **options), "components")
    stay = found.where(F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    kept = told.join(stay.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    # Of repeated rows one stays, whichever of their other columns comes first as JSON.
    single = kept.where("n = 1").select("row")
    repeated = kept.where("n > 1").groupBy("own_id", "own_hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
