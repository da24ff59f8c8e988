"""Removal of repeated byte strings by a sparse, range-partitioned suffix order.

A byte goes if a string of `length` bytes that covers it starts somewhere else too. A suffix for every
byte would take many times the corpus in shuffled rows, so suffixes start at anchors chosen by content:
in each window of `length` bytes the gram with the least hash. Equal windows have equal anchors at equal
places, so two windows can only be equal if their anchors' grams are. The window that begins o bytes ahead
of an anchor is told by the o bytes ahead of it, its gram, and the length - gram - o bytes behind the gram.

1. Anchors with their gram's hash and the hash of the context that all windows of the anchor span are
   brought together by gram. A context found twice settles all its windows. A gram in one context only
   settles them the other way.
2. What is left, one suffix per distinct context, is range-partitioned by sampled splitters: by leading
   bytes, then the gram, then the bytes behind it; equal suffixes may fall to either side. A bucket sorts
   its suffixes by multikey quicksort. Common prefixes of neighbours give the classes of each depth;
   the bytes ahead of the anchors are sorted and compared in the same way. A window whose two classes
   lie inside the bucket is settled.
3. Rows of the grams at a bucket's edges are compared across boundaries: a window whose class behind the
   gram reaches the edge is looked up in a second partitioning, by the bytes ahead. What reaches an edge
   there too is shared with both edges, so it falls into few classes; one of each class and bucket is
   counted, by the digest of its bytes.

Grams and contexts are told by 64-bit hashes of their bytes, all else by the bytes or 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialize, release

_ODD = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64
#: Bytes of a text that are hashed at a time, which bounds a worker's arrays.
PART = 1 << 20
#: Segments of at most so many rows are sorted by comparison, as multikey quicksort does with its small ones.
SMALL = 24


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, _WRAP))):
                out = np.ones(1, np.uint64)
                while len(out) < size:  # double: base**(k + len) = base**k * base**len
                    out = np.concatenate([out, out * np.uint64(pow(base, len(out), _WRAP))])
                setattr(self, name, out)


POWERS = Powers()
_RNG = np.random.default_rng(20240607)
BYTE_CODES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def prefix_sums(data: bytes) -> np.ndarray:
    """S with S[i] the sum of code(byte j) * base**j over j < i, modulo 2**64."""
    n = len(data)
    POWERS.grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[np.frombuffer(data, np.uint8)] * POWERS.up[:n], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the texts from starts to ends."""
    return mix((sums[ends] - sums[starts]) * POWERS.down[starts])


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each width neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    done, out = 1, x
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(sums: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of the grams that are the least-hashed of some window of bytes (the leftmost, where several are)."""
    n = len(sums) - 1
    if n < window:
        return np.zeros(0, np.int64)
    each = mix((sums[gram:] - sums[:-gram]) * POWERS.down[: n - gram + 1])
    width = window - gram + 1
    least = sliding(each, width, True)
    # A gram is chosen if the largest of the minima of the windows that hold it is its own hash.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.nonzero(sliding(padded, width, False) == each)[0]


def context_hashes(sums: np.ndarray, at: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of the context of anchors: the bytes of all windows that hold the anchor's gram."""
    low = np.maximum(at - (length - gram), 0)
    high = np.minimum(at + length, len(sums) - 1)
    shape = mix((at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - at).astype(np.uint64))
    return hashes(sums, low, high) ^ shape, low, high


def anchor_finder(length: int, gram: int):  # noqa: ANN201
    """A mapInArrow function from (doc_id, key, text) to anchor_rows()."""
    fields = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])

    reach = length - gram

    def of_text(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(h, ctx, pos, low, high) of a text's anchors, a part of it at a time; parts overlap by what their contexts span."""
        for first in range(0, len(data) - gram + 1 if len(data) >= length else 0, PART):
            begin = max(0, first - reach)
            sums = prefix_sums(data[begin : first + PART + length])
            at = anchors(sums, gram, length)
            at = at[(at >= first - begin) & (at < first - begin + PART)]
            ctx, low, high = context_hashes(sums, at, gram, length)
            yield hashes(sums, at, at + gram).view(np.int64), ctx.view(np.int64), at + begin, low + begin, high + begin

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(i, part) for i, data in enumerate(as_bytes(batch.column(2))) for part in of_text(data)]
            owner = pa.array(np.repeat([i for i, _ in parts], [len(part[0]) for _, part in parts]).astype(np.int64))
            h, ctx, at, low, high = (np.concatenate([part[k] for _, part in parts]) if parts else np.zeros(0, np.int64) for k in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ctx, pa.int64()), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], schema=fields)

    return find


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs has doc_id, key (of the row) and text: one row (h, ctx, doc_id, key, pos, low, high) per anchor."""
    return docs.select("doc_id", "key", "text").mapInArrow(anchor_finder(length, gram), "h bigint, ctx bigint, doc_id bigint, key bigint, pos int, low int, high int")


def _marks(rows: DataFrame, heavy_grams: int) -> DataFrame:
    """Anchors whose context occurs twice (twice), and one of each context of a gram with several (asks)."""
    spark = rows.sparkSession
    named = rows.agg(F.expr(f"approx_top_k(h, {heavy_grams}, {20 * heavy_grams})").alias("t")).select(F.explode("t").alias("t")).where("t.count > 200").collect()
    heavy = F.broadcast(spark.createDataFrame([(r.t.item,) for r in named], "h bigint"))  # heavy_grams rows at most
    columns = ["h", "doc_id", "key", "pos", "low", "high", "twice", "asks"]
    # Light grams: one shuffle, everything seen in a gram's rows in order.
    order = Window.partitionBy("h").orderBy("ctx", "doc_id", "key", "pos")
    whole = Window.partitionBy("h")
    light = rows.join(heavy, "h", "left_anti").select("*", F.lag("ctx").over(order).alias("before"), F.lead("ctx").over(order).alias("after"), F.min("ctx").over(whole).alias("ctx_low"), F.max("ctx").over(whole).alias("ctx_high"))
    opens = ~F.col("ctx").eqNullSafe(F.col("before"))
    light = light.select("h", "doc_id", "key", "pos", "low", "high", (~opens | F.col("ctx").eqNullSafe(F.col("after"))).alias("twice"), (opens & (F.col("ctx_low") != F.col("ctx_high"))).alias("asks"))
    # Frequent ones: classes by map-side counts, then a join that adaptive execution can split.
    frequent = rows.join(heavy, "h", "left_semi")
    place = F.struct("doc_id", "key", "pos")
    classes = frequent.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    several = F.broadcast(classes.groupBy("h").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a != b").select(F.col("h").alias("several_h")))
    classes = classes.join(several, F.col("h") == F.col("several_h"), "left").select(F.col("h").alias("class_h"), F.col("ctx").alias("class_ctx"), "n", "first", F.col("several_h").isNotNull().alias("several"))
    # One class may hold most of them, so each class meets its rows in several places.
    classes = classes.withColumn("class_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salt = F.pmod(F.xxhash64("doc_id", "key", "pos"), F.lit(16)).cast("int")
    joined = frequent.withColumn("salt", salt).join(classes, (F.col("h") == F.col("class_h")) & (F.col("ctx") == F.col("class_ctx")) & (F.col("salt") == F.col("class_salt")))
    split = joined.select("h", "doc_id", "key", "pos", "low", "high", (F.col("n") > 1).alias("twice"), (F.col("several") & place.eqNullSafe(F.col("first"))).alias("asks"))
    return light.select(*columns).unionByName(split.select(*columns)).where("twice or asks")


def _with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, key, text) joined to lists (doc_id, key, items); texts are moved compressed, and not sorted."""
    fields = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([writer.compress(x) for x in as_bytes(batch.column(2))], pa.binary())], schema=fields)

    packed = docs.select("doc_id", "key", "text").mapInArrow(pack, "doc_id bigint, key bigint, packed binary")
    right = lists.select(F.col("doc_id").alias("rid"), F.col("key").alias("rkey"), "items").hint("shuffle_hash")
    return packed.join(right, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")), how).select("doc_id", "key", "packed", "items")


def _unpack(column: pa.Array) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    for x in column.to_pylist():
        yield reader.decompress(x)


def _contexts(docs: DataFrame, asks: DataFrame, gram: int) -> DataFrame:
    """Each asking anchor with its leading bytes, the bytes ahead of it (backwards) and those behind its gram."""
    fields = pa.schema([("lead", pa.binary()), ("h", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])
    lead = min(8, gram)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, data, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpack(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for x in items:
                    at = x["pos"]
                    rows.append((data[at : at + lead], x["h"], data[x["low"] : at][::-1], data[at + gram : x["high"]], doc_id, key, at))
            for at in range(0, len(rows), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 10000], strict=True), fields, strict=True)], schema=fields)

    lists = asks.groupBy("doc_id", "key").agg(F.collect_list(F.struct("pos", "low", "high", "h")).alias("items"))
    return _with_texts(docs, lists, "inner").mapInArrow(take, "lead binary, h bigint, ahead binary, behind binary, doc_id bigint, key bigint, pos int")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (unsigned, the most telling first): three-way partitions by one word after the other."""
    order = np.arange(len(words))
    width = words.shape[1]
    open_ = [(0, len(words), 0)]
    while open_:
        first, end, depth = open_.pop()
        rows = order[first:end]
        if end - first < 2 or depth == width:
            continue
        if end - first <= SMALL:
            tails = words[rows, depth:].astype(">u8")  # bytes in the order of the numbers
            order[first:end] = rows[sorted(range(end - first), key=[x.tobytes() for x in tails].__getitem__)]
            continue
        word = words[rows, depth]
        pivot = np.sort(word[[0, (end - first) // 2, -1]])[1]
        less, more = word < pivot, word > pivot
        parts = rows[less], rows[~(less | more)], rows[more]
        order[first:end] = np.concatenate(parts)
        at = first
        for part, deeper in zip(parts, (0, 1, 0), strict=True):
            open_.append((at, at + len(part), depth + deeper))
            at += len(part)
    return order


class Side:
    """Strings on one side of the anchors, in the order of their grams, with the common prefixes of neighbours."""

    def __init__(self, gram: np.ndarray, texts: list[bytes], reach: int):
        """gram holds words that tell the grams; strings of different grams share nothing (-1)."""
        n = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, n)
        self.bytes = np.frombuffer(b"".join(x.ljust(reach, b"\0") for x in texts), np.uint8).reshape(n, reach)
        room = -(-reach // 8) * 8
        padded = np.zeros((n, room), np.uint8)
        padded[:, :reach] = self.bytes
        words = np.concatenate([gram, padded.view(">u8").astype(np.uint64), self.sizes[:, None].astype(np.uint64)], axis=1)
        self.order = multikey_quicksort(words)
        self.gram = gram
        self.lcp = np.full(n, -1, np.int64)  # of each place in the order with the one before it
        if n > 1:
            self.lcp[1:] = self.shared(self.order[1:], self.order[:-1])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that strings a and b begin with in common, -1 if their grams differ."""
        differ = self.bytes[a] != self.bytes[b]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        found = np.minimum(found, np.minimum(self.sizes[a], self.sizes[b]))
        return np.where((self.gram[a] == self.gram[b]).all(axis=1), found, -1)

    def most(self) -> np.ndarray:
        """The longest prefix that each string has in common with another one."""
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.maximum(self.lcp, np.append(self.lcp[1:], -1))
        return found

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string, equal for strings that share depth bytes."""
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.cumsum(self.lcp < depth)
        return found

    def to_edge(self) -> np.ndarray:
        """Bytes that each string shares with the first or last one, and so at most with what other buckets hold."""
        every = np.arange(len(self.order))
        return np.maximum(self.shared(every, np.full(len(every), self.order[0])), self.shared(every, np.full(len(every), self.order[-1])))


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Words that tell a row's gram, in the order of Spark's columns: lead as its bytes, h as a signed number."""
    found = []
    for name in names:
        if name == "lead":
            found.append(np.frombuffer(b"".join(x.ljust(8, b"\0") for x in table[name].to_pylist()), ">u8").astype(np.uint64))
        else:
            found.append(table[name].to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
    return np.stack(found, axis=1)


RUN_TYPE = "doc_id bigint, key bigint, start int, end int, lead binary, h bigint, ahead binary, behind binary, pos int, since int, told binary"
_RUN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("lead", pa.binary()), ("h", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary()), ("pos", pa.int32()), ("since", pa.int32()), ("told", pa.binary())])


def _emit(table: pa.Table, rows: np.ndarray, **columns: pa.Array | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of table by number with the given columns of _RUN; the others are null, but for those of table named in `also`."""
    also = columns.pop("also", ())
    for at in range(0, len(rows), 20000):
        some = pa.array(rows[at : at + 20000], pa.int64())
        out = []
        for f in _RUN:
            if f.name in columns:
                out.append(pa.array(columns[f.name][at : at + 20000], f.type))
            elif f.name in ("doc_id", "key", *also):
                out.append(table[f.name].take(some).combine_chunks().cast(f.type))
            else:
                out.append(pa.nulls(len(some), f.type))
        yield pa.RecordBatch.from_arrays(out, schema=_RUN)


def _compare(length: int, gram: int, across: bool):  # noqa: ANN202
    """A bucket's suffixes to settled runs (start, end) and to what reaches its edges.

    The first time these are rows for the second partitioning, with the first window that is open (since).
    Across boundaries (the second time) they are one window (start, told) of each class.
    """
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        ahead_texts, behind_texts = table["ahead"].to_pylist(), table["behind"].to_pylist()
        names = _numbers(table, ("h",) if across else ("lead", "h"))
        ahead, behind = Side(names, ahead_texts, reach), Side(names, behind_texts, reach)
        h, pos = table["h"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
        since = table["since"].to_numpy().astype(np.int64) if across else np.zeros(n, np.int64)
        edge = (ahead if across else behind).to_edge()
        most_ahead, most_behind = ahead.most(), behind.most()
        twins = np.zeros((n, reach + 3), np.int8)  # column o + 1: the window that begins o bytes ahead
        for o in range(reach + 1):
            mine = since <= o
            some = np.nonzero(mine & (most_ahead >= o) & (most_behind >= reach - o))[0]
            if not across and len(some) < 2:
                continue
            left, right = ahead.classes(o), behind.classes(reach - o)
            name = right * (n + 1) + left
            value = np.sort(name[some])
            twice = value[1:][value[1:] == value[:-1]]
            if len(twice):
                at = np.minimum(np.searchsorted(twice, name[some]), len(twice) - 1)
                twins[some, o + 1] = twice[at] == name[some]
            if across:
                open_ = np.nonzero(mine & (ahead.sizes >= o) & (behind.sizes >= reach - o) & (edge >= o))[0]
                one = open_[np.unique(name[open_], return_index=True)[1]]
                told = [blake2b(b"%d %d " % (o, h[i]) + ahead_texts[i][:o][::-1] + behind_texts[i][: reach - o], digest_size=16).digest() for i in one]
                yield from _emit(table, one, start=pos[one] - o, told=told)
        change = np.diff(twins, axis=1)
        opens, closes = np.nonzero(change == 1), np.nonzero(change == -1)
        yield from _emit(table, opens[0], start=pos[opens[0]] - (closes[1] - 1), end=pos[opens[0]] - opens[1] + length)
        if not across:
            since = np.maximum(reach - edge, reach - behind.sizes)
            open_ = np.nonzero((edge >= 0) & (since <= ahead.sizes))[0]
            yield from _emit(table, open_, since=since[open_], also=("lead", "h", "ahead", "behind", "pos"))

    return run


def repeated_runs(docs: DataFrame, length: int = 400, gram: int | None = None, bucket_rows: int = 8192, heavy_grams: int = 1000) -> DataFrame:
    """docs (doc_id, key, text) to runs (doc_id, key, start, end) of bytes that a repeated string covers; runs may overlap."""
    gram = gram or length // 2
    if not 0 < gram < length:
        raise ValueError("grams are shorter than the strings, and not empty")
    # Splitters are sampled from whole suffixes, so fewer of them for each bucket go to the driver than Spark's 100.
    docs.sparkSession.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 20)
    found = materialize(anchor_rows(docs, length, gram), "anchors")
    marks = materialize(_marks(found, heavy_grams), "marks")
    release(found)
    settled = marks.where(F.col("twice") & (F.col("high") - F.col("low") >= length)).select("doc_id", "key", F.col("low").alias("start"), F.col("high").alias("end"))
    asks = marks.where("asks")
    tie = F.xxhash64("doc_id", "key", "pos")

    def dealt(rows: DataFrame, n: int, *by: Column) -> DataFrame:
        return rows.repartitionByRange(max(1, -(-n // bucket_rows)), *by, tie)

    suffixes = dealt(_contexts(docs, asks, gram), asks.count(), F.col("lead"), F.col("h"), F.col("behind"))
    compared = materialize(suffixes.mapInArrow(_compare(length, gram, False), RUN_TYPE), "compared")
    edges = compared.where("since is not null")
    turned = dealt(edges, edges.count(), F.col("h"), F.col("ahead"))
    across = materialize(turned.mapInArrow(_compare(length, gram, True), RUN_TYPE), "across")
    windows = across.where("told is not null").select("doc_id", "key", "start", "told")
    again = windows.groupBy("told").agg(F.count("*").alias("n")).where("n > 1").select(F.col("told").alias("again"))
    shared = windows.join(again, F.col("told") == F.col("again")).select("doc_id", "key", "start", (F.col("start") + length).alias("end"))
    runs = [x.where("end is not null").select("doc_id", "key", "start", "end") for x in (compared, across)]
    return settled.unionByName(runs[0]).unionByName(runs[1]).unionByName(shared)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, **options: int) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, kept binary, spans array<struct<start, end>> (maximal removed runs of bytes).

    Matches stay inside a document; one document may repeat itself, and copies of a row repeat each other.
    Rows that share id and text are told apart only in that each counts as a place. Null text is empty; a null id
    stays null. An empty table gives no rows. Long texts are hashed a part at a time. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")
    runs = repeated_runs(own, length, gram, **options)
    lists = runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("items"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for data, items in zip(_unpack(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in items or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                done, parts = 0, []
                for a, b in merged:
                    parts.append(data[done:a])
                    done = b
                sizes.append(len(data))
                kept.append(b"".join([*parts, data[done:]]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], schema=fields)

    return _with_texts(own, lists, "left").mapInArrow(cut, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start: bigint, end: bigint>>")
