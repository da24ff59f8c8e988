"""Reading documents, node trees and snapshots. Schemas are declared, never inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..operators.corpus import sibling_links

IR_SCHEMA = (
    "type string, doc_id string, node_id string, kind string, label string, title string, parent_id string, prev_id string, next_id string, "
    "ordinal string, body_md string, body string, source_version string, is_leaf string, is_active string, confidence string, aliases string, "
    "ref_path string, source_file string, source_path string, doc_hash string, _corrupt_record string"
)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, text, source_fingerprint of every .md, .txt, .docx and .pdf file below path; another suffix is an error when read.

    Plain text gets its headings inferred.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("source_fingerprint"), A.extract_binary("path", "content").alias("raw"))
    plain = F.lower("path").endswith(".txt")
    return rows.select("path", "source_fingerprint", A.canonical(F.when(plain, T.inferred_headings("raw")).otherwise(F.col("raw"))).alias("text"))


def extract_folder(spark: SparkSession, path: str, seconds: float = 60, most_bytes: int = 1 << 28, most_chars: int = 1 << 28) -> DataFrame:
    """read_folder() with limits: path, source_fingerprint, text, error, where text or error is null.

    A file that takes longer than seconds, whose text is longer than most_chars, or that can't be read, is a row with an error.
    Files of more than most_bytes are told by their length and never loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = A.extract_limited(seconds, most_chars)("path", "content")
    rows = files.where(F.col("length") <= most_bytes).select("path", F.sha2("content", 256).alias("source_fingerprint"), x.alias("x"))
    plain = F.lower("path").endswith(".txt")
    text = A.canonical(F.when(plain, T.inferred_headings("x.text")).otherwise(F.col("x.text")))
    read = rows.select("path", "source_fingerprint", F.when(F.col("x.error").isNull(), text).alias("text"), "x.error")
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("source_fingerprint"), F.lit(None).cast("string").alias("text"), F.format_string("file has %d bytes, more than %d", "length", F.lit(most_bytes)).alias("error"))
    return read.unionByName(large)


def documents_of(files: DataFrame) -> DataFrame:
    """files to doc_id, title, source_file, source_version, text and fingerprints. The title is the first heading, else the file's name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    first = F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    title = F.regexp_replace(F.when(first != "", first).otherwise(stem), r"\s+", " ")
    rows = files.withColumns({"source_file": name, "title": title}).withColumns({"source_version": T.source_version("title", "source_file"), "text_fingerprint": F.sha2("text", 256), "slug": T.slug(stem)})
    order = Window.partitionBy("slug").orderBy("path")
    return rows.withColumn("_n", F.row_number().over(order)).withColumn("doc_id", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "_n"))).drop("slug", "_n")


def read_node_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSONL node tree as (docs, nodes): defaults filled in, missing documents added, siblings linked.

    A line that isn't JSON, or a node without doc_id, node_id or a kind of doc or chunk, is an error when the rows are read.
    """
    rows = spark.read.schema(IR_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    kind = F.coalesce(given("type"), F.lit("node"))
    rows = rows.withColumn("type", F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("_corrupt_record")))).otherwise(kind))
    nodes = rows.where("type = 'node'")
    bad = given("doc_id").isNull() | given("node_id").isNull() | ~F.coalesce(F.col("kind"), F.lit("")).isin("doc", "chunk")
    nodes = nodes.withColumn("kind", F.when(bad, F.raise_error(F.lit("a node needs doc_id, node_id and a kind of doc or chunk"))).otherwise(F.col("kind")))
    docs = rows.where("type = 'doc'").select(given("doc_id").alias("doc_id"), F.coalesce(given("title"), given("doc_id")).alias("title"), given("source_file").alias("source_file"), given("source_path").alias("source_path"), given("source_version").alias("source_version"), given("doc_hash").alias("doc_hash"))
    body = F.coalesce("body_md", "body", F.lit(""))
    hashes = nodes.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("\n", "node_id", body), 256))), ""), 256).alias("computed"))
    docs = docs.join(hashes, "doc_id", "full_outer")
    file = F.coalesce("source_file", F.concat("doc_id", F.lit(".ir")))
    docs = docs.select("doc_id", F.coalesce("title", "doc_id").alias("title"), file.alias("source_file"), F.coalesce("source_path", file).alias("source_path"), F.coalesce("source_version", T.source_version(F.coalesce("title", "doc_id"), file)).alias("source_version"), F.coalesce("doc_hash", "computed").alias("doc_hash"), F.lit(True).alias("is_active"))
    versions = docs.select("doc_id", F.col("source_version").alias("doc_version"))
    nodes = nodes.join(versions, "doc_id").select(
        "doc_id", "node_id", "kind", F.coalesce(given("source_version"), F.col("doc_version")).alias("source_version"),
        F.coalesce(given("title"), given("label"), F.col("node_id")).alias("title"), F.coalesce(given("label"), given("title"), F.col("node_id")).alias("label"),
        given("parent_id").alias("parent_id"), given("prev_id").alias("prev_id"), given("next_id").alias("next_id"),
        F.coalesce(F.col("ordinal").try_cast("int"), F.lit(0)).alias("ordinal"), body.alias("body_md"), T.truthy("is_leaf").alias("is_leaf"), T.truthy("is_active").alias("is_active"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"), T.alias_list("aliases").alias("aliases"), F.coalesce("ref_path", F.lit("")).alias("ref_path"),
    )
    linked = sibling_links(nodes)
    return docs, linked.withColumns({"node_key": T.node_key("node_id", "source_version"), "body_plain": T.markdown_to_plain("body_md"), "heading_path": F.lit(""), "node_hash": F.sha2("body_md", 256)})


def read_node_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown node files with frontmatter below path, as nodes (whatever their kind)."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path).select(F.col("_metadata.file_path").alias("ref_path"), F.col("value").alias("md"))
    get = lambda name: F.try_element_at("fm", F.lit(name))
    rows = files.withColumn("fm", T.frontmatter("md")).where(F.coalesce(get("node_id"), F.lit("")) != "")
    return sibling_links(
        rows.select(
            get("doc_id").alias("doc_id"), get("node_id").alias("node_id"), F.coalesce(get("kind"), F.lit("chunk")).alias("kind"), F.coalesce(get("source_version"), F.lit("current")).alias("source_version"),
            F.coalesce(get("title"), get("node_id")).alias("title"), F.coalesce(get("label"), F.lit("")).alias("label"), F.when(get("parent_id") != "", get("parent_id")).alias("parent_id"),
            F.coalesce(get("ordinal").try_cast("int"), T.trailing_number(get("node_id"))).alias("ordinal"), T.truthy(get("is_leaf")).alias("is_leaf"), T.truthy(get("is_active")).alias("is_active"),
            T.alias_list(get("aliases")).alias("aliases"), "ref_path", T.strip_frontmatter("md").alias("body_md"),
        )
    )


def metadata_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with the fields of a metadata page: source file and path, version, hash, parser."""
    line = lambda label: F.regexp_extract(F.col(text), rf"(?m)^[-*\s]*{label}\s*[:：]\s*`?([^`\n]*?)`?\s*$", 1)
    return files.withColumns({"source_file": line("源文件"), "source_path": line("源路径"), "source_version": line("版本"), "doc_hash": line("文档哈希"), "active_parser": line("解析器")})


def read_json_or_empty(spark: SparkSession, path: str) -> dict:
    """A small JSON object; {} if it is missing or not one."""
    try:
        rows = spark.read.option("wholetext", "true").text(path).take(1)
        found = json.loads(rows[0].value) if rows else {}
    except Exception as e:  # noqa: BLE001  a missing path and broken JSON count alike
        if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return found if isinstance(found, dict) else {}


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Web pages as documents: path from the URL, text without tags."""
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_file"), T.html_to_text("html").alias("text"))
