"""From documents to chunks, nodes and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import constants as K
from ..functions import text as T


def block_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reading_order, char_start, char_end): runs of lines that aren't blank, their line feeds included."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = r"(?<![^\n])\s*(?:\n|\z)"  # blank lines in a row, from the start of a line to the end of one
    lengths = lambda parts: F.transform(parts, lambda x: F.char_length(x))
    parts = F.arrays_zip(lengths(F.split(t, blank, -1)).alias("size"), lengths(F.regexp_extract_all(t, F.lit(blank), F.lit(0))).alias("gap"))
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("i", "p")).select("doc_id", "i", "p.size", (F.col("p.size") + F.coalesce("p.gap", F.lit(0))).alias("step"))
    order = Window.partitionBy("doc_id").orderBy("i")
    placed = rows.withColumn("char_start", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step")).where("size > 0")
    return placed.select("doc_id", (F.row_number().over(order) - 1).alias("reading_order"), F.col("char_start").cast("long"), (F.col("char_start") + F.col("size")).cast("long").alias("char_end"))


def chunk_rows(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = 0, separators: tuple[str, ...] = K.CHUNK_SEPARATORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, text), one row per chunk."""
    chunks = docs.select(F.col(key).alias("doc_id"), F.explode(A.chunk_document(size, overlap, separators)(F.col(text))).alias("c"))
    return chunks.select("doc_id", "c.*")


def heading_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level, title, char_start): Markdown headings outside fenced blocks."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(lines).alias("i", "line"))
    order = Window.partitionBy("doc_id").orderBy("i")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.char_length("line") + 1).over(ahead), F.lit(0)))
    rows = rows.withColumn("fences", F.coalesce(F.sum(F.when(F.col("line").startswith("```"), 1).otherwise(0)).over(ahead), F.lit(0)))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    return rows.where((mark != "") & (F.col("fences") % 2 == 0)).select("doc_id", F.char_length(mark).alias("level"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"), "char_start")


def heading_stacks(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """chunks with stack array<string>: the headings that a chunk's start stands under, outermost first.

    A heading closes all open ones of its level and deeper.
    """
    lists = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "level", "title"))).alias("heads"))
    return chunks.join(lists, "doc_id", "left").withColumn("stack", _stack()).drop("heads")


def _stack() -> Column:
    """The titles of heads (char_start, level, title, in order) that char_start stands under."""
    ahead = F.filter(F.coalesce("heads", F.array().cast("array<struct<char_start: bigint, level: int, title: string>>")), lambda h: h["char_start"] <= F.col("char_start"))
    start = F.array().cast("array<struct<level: int, title: string>>")
    return F.aggregate(ahead, start, lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title")))), lambda acc: F.transform(acc, lambda x: x["title"]))


def sibling_links(nodes: DataFrame) -> DataFrame:
    """nodes with prev_id and next_id: neighbours of the same document, parent and kind by (ordinal, node_id); links given stay."""
    order = Window.partitionBy("doc_id", "parent_id", "kind").orderBy("ordinal", "node_id")
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumns({"prev_id": F.coalesce(have("prev_id"), F.lag("node_id").over(order)), "next_id": F.coalesce(have("next_id"), F.lead("node_id").over(order))})


def build_nodes(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = 0) -> DataFrame:
    """One doc node and its chunk nodes per document (doc_id, title, text, source_file; a row each), as the node table.

    A document's chunks, the headings they stand under and their neighbours are told inside its row, so no text is shuffled.
    """
    version = T.source_version("title", "source_file")
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text", version.alias("source_version"))
    cut = base.where("doc_id is not null").select("doc_id", "source_version", A.chunk_document(size, overlap, K.CHUNK_SEPARATORS)("text").alias("chunks"), A.heading_list("text").alias("heads"))
    chunks = cut.select("doc_id", "source_version", "heads", F.size("chunks").alias("last"), F.explode("chunks").alias("c")).select("*", "c.*")
    id_of = lambda n: F.concat(F.col("doc_id"), F.lit(":chunk:"), F.lpad(n.cast("string"), 6, "0"))
    near = {"prev_id": F.when(F.col("ordinal") > 1, id_of(F.col("ordinal") - 1)), "next_id": F.when(F.col("ordinal") < F.col("last"), id_of(F.col("ordinal") + 1))}
    chunk_id = id_of(F.col("ordinal"))
    leaf = chunks.select("doc_id", chunk_id.alias("node_id"), "source_version", F.lit("chunk").alias("kind"), T.chunk_title(chunk_id, "text").alias("title"), F.array_join(_stack(), " > ").alias("heading_path"), F.concat(F.col("doc_id"), F.lit(":doc")).alias("parent_id"), "ordinal", F.lit(True).alias("is_leaf"), "char_start", "char_end", F.col("text").alias("body_md"), *[c.alias(k) for k, c in near.items()])
    roots = base.select("doc_id", F.concat(F.col("doc_id"), F.lit(":doc")).alias("node_id"), "source_version", F.lit("doc").alias("kind"), "title", F.lit("").alias("heading_path"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(False).alias("is_leaf"), F.lit(0).alias("char_start"), F.char_length(F.coalesce("text", F.lit(""))).alias("char_end"), F.lit("").alias("body_md"), *[F.lit(None).cast("string").alias(k) for k in near])
    nodes = leaf.unionByName(roots)
    return nodes.withColumns({
        "node_key": T.node_key("node_id", "source_version"), "is_active": F.lit(True), "label": F.col("title"), "body_plain": T.markdown_to_plain("body_md"),
        "node_hash": F.sha2("body_md", 256), "confidence": F.lit(1.0), "ref_path": F.concat_ws("/", F.lit("references"), F.col("doc_id"), F.concat(F.regexp_replace("node_id", "[^A-Za-z0-9_-]", "-"), F.lit(".md"))),
    })


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    n = F.char_length("text")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def chapter_toc(chunks: DataFrame) -> DataFrame:
    """(doc_id, chapter, first, last, chunks): chunks by outermost heading, or by the next level where there is only one outermost.

    Chunks under no heading are one chapter, (未分类).
    """
    levels = chunks.groupBy("doc_id").agg(F.countDistinct(F.get("stack", F.lit(0))).alias("tops"))
    level = F.when(F.col("tops") <= 1, F.lit(1)).otherwise(F.lit(0))
    named = chunks.join(levels, "doc_id").withColumn("chapter", F.coalesce(F.get("stack", level), F.get("stack", F.lit(0)), F.lit("(未分类)")))
    return named.groupBy("doc_id", "chapter").agg(F.min_by("chunk_id", "ordinal").alias("first"), F.max_by("chunk_id", "ordinal").alias("last"), F.count("*").alias("chunks"))


def canonical_documents(nodes: DataFrame) -> DataFrame:
    """(doc_id, source_version, text): leaves' bodies in order of (ordinal, node_id), blank line between them."""
    leaves = nodes.where("is_leaf and is_active").groupBy("doc_id", "source_version").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "body_md"))).alias("l"))
    return leaves.select("doc_id", "source_version", A.canonical(F.array_join("l.body_md", "\n\n")).alias("text"))


def unique_doc_ids(docs: DataFrame, title: str = "title") -> DataFrame:
    """docs with doc_id from the title's slug; later ones of equal slugs, by title and path, get a number."""
    order = Window.partitionBy("_slug").orderBy(title, "path")
    numbered = docs.withColumn("_slug", T.slug(title)).withColumn("_n", F.row_number().over(order))
    return numbered.withColumn("doc_id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", "_n"))).drop("_slug", "_n")


def align_texts(rows: DataFrame, texts: str = "texts", document: str = "document") -> DataFrame:
    """rows with spans array<struct<start, end>>: each text's first occurrence at or behind the end of the one before; -1 if none."""
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(acc, t):  # noqa: ANN001, ANN202
        at = F.call_function("locate", t, F.col(document), acc["done"] + 1)
        found = (at > 0) & (F.char_length(t) > 0)
        span = F.when(found, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(t)).alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))
        return F.struct(F.when(found, at - 1 + F.char_length(t)).otherwise(acc["done"]).alias("done"), F.concat(acc["out"], F.array(span)).alias("out"))

    return rows.withColumn("spans", F.aggregate(texts, start, step, lambda acc: acc["out"]))
