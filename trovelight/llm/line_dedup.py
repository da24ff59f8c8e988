"""Line dedup in DataFrame functions alone.

Line hashes are range-partitioned with a secondary sort by document and position, and a window streams
each key's occurrences in that order: first occurrence, number of documents. What comes back is not
text but one run-length compressed keep bitmap per document, which apply_bitmaps() lays over the texts.

A key with a large share of all lines would be one range. approx_top_k, a sketch of bounded size,
names at most heavy_keys such keys; their exact counts are pre-aggregated map-side and broadcast (a
bounded table), so their lines are settled where they stand. The sketch only chooses the route: a
key's verdict is exact on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, strip_ascii, unused

#: The key is 128 bits: two xxhash64 of different seeds.
_KEY = ["h1", "h2"]


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Lines with a key of min_chars code points at least: h1, h2, doc_id, row_hash, pos."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "row_hash", "pos", lower_ascii(strip_ascii(F.col("line"))).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row_hash", "pos")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, heavy_keys: int = 1000) -> DataFrame:
    """Documents that lose lines: doc_id, row_hash (of the text), runs array<int>.

    runs are the lengths of alternating kept and dropped runs of lines, kept first; what follows the
    last run is kept. A line is dropped if its key (ASCII white space stripped at both ends, A-Z
    lower-cased) is found in min_docs documents or more; with keep_first its first occurrence, by
    doc_id and position, stays. Every row of docs is a document, except that rows with equal id and
    text count once. Null text is one empty line. Null ids form documents by their text.
    """
    spark = docs.sparkSession
    keys = materialize(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    top = keys.agg(F.expr(f"approx_top_k(h1, {heavy_keys}, {20 * heavy_keys})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("h1"))
    heavy = spark.createDataFrame([(r.h1,) for r in top.collect()], "h1 bigint")  # heavy_keys rows at most
    place = F.struct("doc_id", "row_hash", "pos")
    of_heavy = keys.join(F.broadcast(heavy), "h1", "left_semi")
    # Occurrences of one document sit in one task, so distinct documents are counted after a map-side distinct.
    verdicts = of_heavy.groupBy(*_KEY, "doc_id", "row_hash").agg(F.min("pos").alias("pos")).groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.min(place).alias("first"))
    settled = of_heavy.join(F.broadcast(verdicts), _KEY)
    ordered = keys.join(F.broadcast(heavy), "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions(*_KEY, "doc_id", "row_hash", "pos")
    stream = Window.partitionBy(*_KEY).orderBy("doc_id", "row_hash", "pos")
    whole = Window.partitionBy(*_KEY)
    before = F.lag(F.struct("doc_id", "row_hash")).over(stream)
    streamed = ordered.withColumn("opens", F.when(before.eqNullSafe(F.struct("doc_id", "row_hash")), 0).otherwise(1))
    streamed = streamed.select("*", F.sum("opens").over(whole).alias("n_docs"), F.first(place).over(stream).alias("first"))
    columns = [*_KEY, "doc_id", "row_hash", "pos", "n_docs", "first"]
    dropped = settled.select(*columns).unionByName(streamed.select(*columns)).where(F.col("n_docs") >= min_docs)
    if keep_first:
        dropped = dropped.where(~place.eqNullSafe(F.col("first")))
    by_doc = dropped.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return by_doc.select("doc_id", "row_hash", _runs(F.col("at")).alias("runs"))


def _runs(at) -> F.Column:  # noqa: ANN001
    """Sorted positions to run lengths: islands [a, b] give the kept gap before a and the length of the island."""
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    islands = F.arrays_zip(starts.alias("a"), ends.alias("b"), F.array_prepend(F.slice(ends, 1, F.size(ends) - 1), F.lit(-1)).alias("before"))
    return F.flatten(F.transform(islands, lambda x: F.array(x["a"] - x["before"] - 1, x["b"] - x["a"] + 1)))


def line_columns(docs: DataFrame) -> tuple[str, str, str]:
    """What apply_bitmaps() names its columns: _n_lines, _n_dropped, _kept_text, each with as many more underscores ahead as docs' own names need."""
    return tuple(unused(docs, name) for name in ("_n_lines", "_n_dropped", "_kept_text"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns among it, with the three of line_columns(): lines, lines dropped, and the lines kept, joined by LF.

    Every row of docs comes back once. The bitmaps are the hashed side of the join, so texts are moved but not sorted.
    """
    names, own = docs.columns, line_columns(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))
    right = bitmaps.select(F.col("doc_id").alias("_rid"), F.col("row_hash").alias("_rhash"), "runs").hint("shuffle_hash")
    joined = left.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_hash") == F.col("_rhash")), "left")
    lines = F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n", -1)
    flags = F.flatten(F.transform(F.col("runs"), lambda n, i: F.array_repeat(i % 2 == 1, n)))
    parted = joined.select("row", "runs", lines.alias("lines"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("flags"))
    kept = F.when(F.col("runs").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.filter("lines", lambda x, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False))), "\n"))
    n_dropped = F.size(F.filter("flags", lambda f: f)).cast("long")
    return parted.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.size("lines").cast("long").alias(own[0]), n_dropped.alias(own[1]), kept.alias(own[2]))
