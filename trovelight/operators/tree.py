"""Pages of a document tree (contents, metadata, structure) and the text of a document from its nodes."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import arrow as A
from .common import first_by

KEY = ["doc_id", "source_version"]


def contents_page(toc: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, markdown): a table of chapters and their chunks. toc is corpus.chapter_toc(), titles (doc_id, title)."""
    row = F.concat(F.lit("| "), F.col("chapter"), F.lit(" | "), F.col("first"), F.lit(" ~ "), F.col("last"), F.lit(" |\n"))
    lists = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", row.alias("row")))).alias("rows"), F.sum("chunks").alias("chunks"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit(" 章节目录\n\n"))
    table = F.concat(F.lit("| 章节 | Chunk 范围 |\n|---|---|\n"), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("\n共 "), F.size("rows").cast("string"), F.lit(" 章，"), F.col("chunks").cast("string"), F.lit(" 个 chunks。\n"))
    return titles.join(lists, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce(table, F.lit("> 无章节信息。\n"))).alias("markdown"))


def metadata_page(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown): file, path, version, hash and, if there is one, parser of each document."""
    line = lambda label, c: F.concat(F.lit(f"- {label}：`"), F.coalesce(F.col(c), F.lit("")), F.lit("`\n"))
    fields = [line("源文件", "source_file"), line("源路径", "source_path"), line("版本", "source_version"), line("文档哈希", "doc_hash")]
    parser = F.when(F.trim("active_parser") != "", line("解析器", "active_parser")).otherwise("") if "active_parser" in docs.columns else F.lit("")
    return docs.select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), *fields, parser).alias("markdown"))


def structure_report(docs: DataFrame, statistics: DataFrame, parser: str = "chunks", chunk_size: int = 1800, overlap: int = 0) -> DataFrame:
    """(doc_id, json): what a document was cut into. statistics is corpus.chunk_statistics()."""
    stats = F.struct(F.coalesce("chunks", F.lit(0)).alias("chunk_count"), F.coalesce("avg_chars", F.lit(0.0)).alias("avg_chunk_chars"), F.coalesce("min_chars", F.lit(0)).alias("min_chunk_chars"), F.coalesce("max_chars", F.lit(0)).alias("max_chunk_chars"))
    report = F.struct(F.struct(F.lit(chunk_size).alias("chunk_size_chars"), F.lit(overlap).alias("overlap_chars")).alias("chunking"), stats.alias("stats"))
    body = F.struct("doc_id", F.col("title").alias("doc_title"), "source_file", "source_path", "source_version", F.lit(parser).alias("selected_parser"), F.array().cast("array<string>").alias("runner_ups"), report.alias("selected_report"))
    return docs.join(statistics, "doc_id", "left").select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _child_prefix(container: Column, child: Column) -> Column:
    """What a container's body says ahead of its first child's: up to the child's body, or else to its first line."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s+|\s+\z", "")
    body, part = trimmed(container), trimmed(child)
    line = F.trim(F.get(F.split(part, "\n"), F.lit(0)))
    at = F.when(F.instr(body, part) > 0, F.instr(body, part)).otherwise(F.instr(body, line))
    return F.when((part == "") | (body == "") | (at == 0), "").otherwise(trimmed(F.substring(body, F.lit(1), at - 1)))


def tree_texts(nodes: DataFrame, include_inactive: bool = False, depth: int = 32) -> DataFrame:
    """(doc_id, source_version, text): canonical text of documents, depth first.

    A node without children says its body; one with children says what its body has ahead of the first of them,
    and then they follow. Items, and what hangs on them, are left out; so is what hangs on no root. Levels are
    joined one by one, at most depth of them; siblings go by ordinal, path and id.
    """
    rows = nodes.where("kind <> 'item'") if include_inactive else nodes.where("kind <> 'item' and is_active")
    body = F.coalesce("body_md", F.lit(""))
    place = F.struct("ordinal", F.coalesce("ref_path", F.lit("")).alias("ref_path"), "node_id")
    own = rows.select(*KEY, "node_id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("parent_id"), body.alias("body"), place.alias("place"))
    first = first_by(own.where("parent_id is not null"), [*KEY, "parent_id"], "place").select(*KEY, F.col("parent_id").alias("of"), F.col("body").alias("child"))
    said = own.join(first.withColumnRenamed("of", "node_id"), [*KEY, "node_id"], "left")
    alone = F.regexp_replace(F.col("body"), r"\A\s+|\s+\z", "")
    said = said.withColumn("part", F.when(F.col("child").isNull(), alone).otherwise(_child_prefix(F.col("body"), F.col("child")))).select(*KEY, "node_id", "parent_id", "place", "part")
    level = said.where("parent_id is null").select(*KEY, "node_id", F.array("place").alias("path"), "part")
    reached = level
    for _ in range(depth - 1):
        below = said.where("parent_id is not null").select(*KEY, F.col("node_id").alias("child_id"), F.col("parent_id").alias("node_id"), "place", F.col("part").alias("child_part"))
        level = level.join(below, [*KEY, "node_id"]).select(*KEY, F.col("child_id").alias("node_id"), F.concat("path", F.array("place")).alias("path"), F.col("child_part").alias("part"))
        if not level.limit(1).count():
            break
        reached = reached.unionByName(level)
    lists = reached.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("path", "part"))).alias("l"))
    return lists.select(*KEY, A.canonical(F.array_join(F.filter(F.col("l.part"), lambda p: p != ""), "\n\n")).alias("text"))


def ids_by_content(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with doc_id from the digest of the text, so a file keeps its id wherever it lies; later copies, by path, get a number."""
    order = Window.partitionBy("_d").orderBy("path")
    told = docs.withColumn("_d", F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)).withColumn("_n", F.row_number().over(order))
    return told.withColumn("doc_id", F.when(F.col("_n") == 1, F.concat(F.lit("doc-"), F.col("_d"))).otherwise(F.concat_ws("-", F.lit("doc"), "_d", "_n"))).drop("_d", "_n")


def safe_name(name: str) -> str:
    """A name of lower-case letters, digits and single hyphens inside, 64 at most; any other is refused."""
    if not 0 < len(name) <= 64 or not re.fullmatch("[a-z0-9]+(-[a-z0-9]+)*", name):
        raise ConfigError(f"{name!r}: names have lower-case letters, digits and single hyphens between them, 64 characters at most")
    return name


def below(root: str, path: str, protected: tuple[str, ...] = ()) -> str:
    """root/path, refused if it leaves the root or is one of the protected paths in it."""
    inside = posixpath.normpath(path.replace("\\", "/"))
    if not path or inside.startswith(("/", "..")) or re.match("[A-Za-z]:", inside):
        raise ConfigError(f"{path}: outside of {root}")
    if inside in {posixpath.normpath(p) for p in protected}:
        raise ConfigError(f"{path}: must not be overwritten")
    return f"{root.rstrip('/')}/{inside}"
