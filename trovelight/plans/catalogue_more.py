"""More operators on the driver's tables: text forms, lookups, edges by title and reference, exports. SQL is in oracles_more.py."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import arrow as A
from ..functions import text as T
from ..operators import corpus, export, graph, history, memory, rank, render, search
from ..sources import writers
from . import api

Query = Callable[[SparkSession, str], DataFrame]
MORE: dict[str, Query] = {}


def _query(f: Query) -> Query:
    MORE[f.__name__] = f
    return f


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- text ------------------------------------------------------------------------


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """documents as Markdown: a heading, and every the in bold, code or a link by document."""
    docs = _read(spark, sf, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, "**the**").when(F.col("doc_id") % 3 == 1, "`the`").otherwise("[the](u/v)")
    return docs.select("doc_id", F.concat(F.lit("## Doc "), F.col("doc_id"), F.lit("\n\n"), F.replace("text", F.lit("the"), mark)).alias("md"))


@_query
def markdown_to_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", F.sha2(T.markdown_to_plain("md"), 256).alias("plain_sha256"))


@_query
def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Frontmatter written and read again, and what is left without it."""
    parts = _read(spark, sf, "part")
    md = render.node_markdown({"id": F.col("p_partkey"), "title": F.col("p_name"), "kind": F.lit("part")}, F.concat(F.lit("About "), F.col("p_name")))
    fm = T.frontmatter("md")
    return parts.select("p_partkey", md.alias("md")).select("p_partkey", F.try_element_at(fm, F.lit("title")).alias("title"), F.try_element_at(fm, F.lit("kind")).alias("kind"), F.trim(T.strip_frontmatter("md")).alias("body"))


@_query
def title_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with an article number: their core, their label's normal form, and a chunk's title."""
    parts = _read(spark, sf, "part")
    title = F.concat(F.lit("第十二條 "), F.col("p_name"))
    return parts.select("p_partkey", T.core_title(F.replace(title, F.lit("條"), F.lit("条"))).alias("core"), T.article_reference(F.concat(F.lit(" 第 "), F.col("p_size"), F.lit(" 條"))).alias("reference"), T.chunk_title(F.concat(F.lit("c"), F.col("p_partkey")), F.concat(F.lit("\n# "), F.col("p_name"), F.lit("\nmore"))).alias("chunk_title"))


@_query
def value_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Lists, flags and numbers as people write them; cache keys and escaped text."""
    parts = _read(spark, sf, "part")
    listed = F.concat(F.col("p_brand"), F.lit("， "), F.col("p_type"), F.lit(";"), F.col("p_brand"), F.lit(" ,"))
    flag = F.when(F.col("p_size") % 4 == 0, " YES").when(F.col("p_size") % 4 == 1, "0").when(F.col("p_size") % 4 == 2, "")
    return parts.select("p_partkey", F.array_join(T.alias_list(listed), "|").alias("aliases"), T.truthy(flag).alias("flag"), T.trailing_number("p_brand").alias("number"), T.cache_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  x "))).alias("cache_key"), T.escape_inline(F.concat(F.lit("*"), F.col("p_name"), F.lit("_[1]"))).alias("escaped"))


@_query
def normalized_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("a", "第十二条 是什么"), ("b", "  ABC （ x ） ，的 钢筋"), ("c", "什么"), ("d", "第二百零五條与第3条"), ("e", "")]
    found = export.normalized_terms(spark.createDataFrame(rows, "query_id string, text string"))
    return found.select("query_id", "normalized", *[F.array_join(c, "|").alias(c) for c in ("article_terms", "title_terms", "alias_terms")])


def _as_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as questions: an article by number, spaces and marks of both widths, question and linking words."""
    p = _read(spark, sf, "part")
    number = F.concat(F.lit("第"), F.translate(F.col("p_size").cast("string"), "123456789", "一二三四五六七八九"), F.lit("條"))
    text = F.concat(F.when(F.col("p_partkey") % 3 > 0, number).otherwise(F.lit("")), F.lit("的 "), F.upper("p_name"), F.lit(" ， （ "), F.col("p_partkey"), F.lit(" ） 是什么"))
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


@_query
def normalized_questions(spark: SparkSession, sf: str) -> DataFrame:
    found = export.normalized_terms(_as_questions(spark, sf))
    return found.select("query_id", "normalized", *[F.array_join(c, "|").alias(c) for c in ("article_terms", "title_terms", "alias_terms")])


@_query
def cjk_tokens_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts in Chinese characters, letter by letter: their tokens."""
    name = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余")
    return _read(spark, sf, "part").select("p_partkey", F.array_join(T.cjk_tokens(name), " ").alias("tokens"))


@_query
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as file names of shards: letters alone, marks, devices, and nothing."""
    p = _read(spark, sf, "part")
    shard = F.when(F.col("p_partkey") % 4 == 0, F.substring("p_name", 1, 5)).when(F.col("p_partkey") % 4 == 1, F.substring("p_brand", 1, 6)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("com"), F.col("p_partkey") % 12)).otherwise("")
    return p.select("p_partkey", writers.shard_file_name(shard).alias("file"))


@_query
def shard_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("con",), ("ab",), ("a b",), ("",), ("x/y",), ("LPT1",), ("é.",)]
    return spark.createDataFrame(rows, "shard string").select("shard", writers.shard_file_name(F.col("shard")).alias("file"))


@_query
def heading_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of a document under the headings that stand ahead of it (every fifth line is one, of level 1 to 3)."""
    docs = _read(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i / 5).cast("int") % 3 + 1), F.lit(" h"), i.cast("string"))).otherwise(F.lit("x")))
    made = docs.select("doc_id", F.array_join(lines, "\n").alias("text"))
    heads = corpus.heading_rows(made)
    chunks = heads.select("doc_id", "char_start", F.col("title").alias("at"))
    return corpus.heading_stacks(chunks, heads).select("doc_id", "at", F.array_join("stack", ">").alias("stack"))


@_query
def chapter_toc(spark: SparkSession, sf: str) -> DataFrame:
    """Turns by role as chapters of a conversation."""
    turns = _read(spark, sf, "conversations")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), F.col("turn").alias("ordinal"), F.array(F.lit("top"), F.col("role")).alias("stack"))
    return corpus.chapter_toc(chunks)


@_query
def aligned_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Where the words the, tion and the again are found, each behind the one before."""
    docs = _read(spark, sf, "documents").select("doc_id", F.col("text").alias("document"), F.array(F.lit("the"), F.lit("tion"), F.lit("the")).alias("texts"))
    return corpus.align_texts(docs).select("doc_id", *[F.get("spans", F.lit(k))["start"].cast("long").alias(f"at{k}") for k in range(3)])


@_query
def chunk_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 100 characters cut anywhere, of texts without white space."""
    docs = _read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[\s|`<]", "x").alias("text"))
    return corpus.chunk_rows(docs, 100, 0, ("",)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


# --- graph and search ----------------------------------------------------------------


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as articles of their brand; each cites the next size, and some name another by title."""
    p = _read(spark, sf, "part")
    label = F.concat(F.lit("第"), F.col("p_size"), F.lit("条"))
    body = F.concat(F.lit("参见 第"), (F.col("p_size") + 1), F.lit("条， about "), F.col("p_name"))
    return p.select(F.col("p_brand").alias("doc_id"), F.lit("v1").alias("source_version"), F.concat(F.lit("a"), F.col("p_partkey")).alias("node_id"), F.lit("article").alias("kind"), label.alias("label"), F.concat(label, F.lit(" "), F.split("p_name", " ")[0]).alias("title"), F.lit(True).alias("is_active"), F.lit(True).alias("is_leaf"), F.col("p_partkey").cast("int").alias("ordinal"), body.alias("body_plain"), F.lit("p").alias("parent_id"))


@_query
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reference_edges(_articles(spark, sf)).select("doc_id", "from_node_id", "to_node_id")


@_query
def title_mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _articles(spark, sf)
    chunks = nodes.select("doc_id", "source_version", F.concat(F.lit("c"), "node_id").alias("node_id"), "ordinal", "body_plain")
    return graph.title_mention_edges(chunks, nodes, per_doc=None).select("from_node_id", "to_node_id")


@_query
def alias_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as aliases that hold a word of a query."""
    aliases = _read(spark, sf, "part").select(F.col("p_name").alias("alias"), F.replace("p_name", F.lit(" "), F.lit("")).alias("normalized_alias"), F.lit(True).alias("is_active"))
    words = _read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    asked = words.select(F.col("text").alias("query_id"), "text")
    return search.expand_with_aliases(asked, aliases).select("query_id", "alias", F.col("n").cast("long").alias("n"))


@_query
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Orders over customers as edges, the urgent ones put in again with another confidence."""
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("from_node_id"), F.col("o_orderkey").alias("to_node_id"), F.lit(0.5).alias("confidence"), "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'").withColumn("confidence", F.lit(1.0))
    return graph.upsert(o.drop("o_orderpriority"), urgent.drop("o_orderpriority"), ["from_node_id", "to_node_id"]).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("to_node_id").alias("ids"))


@_query
def structural_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that a query names by number or title, merged by route."""
    nodes = _articles(spark, sf)
    sizes = _read(spark, sf, "part").select(F.concat(F.lit("第"), F.col("p_size"), F.lit("条")).alias("text")).distinct()
    asked = sizes.select(F.col("text").alias("query_id"), "text")
    return rank.merge_routes(export.structural_hits(asked, nodes)).select("query_id", "item", F.col("rank").cast("long").alias("rank"))


@_query
def double_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a language in order, those with the word license in front."""
    docs = _read(spark, sf, "documents")
    shown = docs.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("ref_path"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("pos"))
    found = docs.where(F.col("text").contains("license")).select(F.col("lang").alias("query_id"), F.col("doc_id").alias("file"))
    return rank.double_hits_first(shown, found).select("query_id", "ref_path", F.col("pos").cast("long").alias("pos"))


@_query
def candidate_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of hits that a line search has not covered."""
    docs = _read(spark, sf, "documents")
    nodes = docs.select(F.col("doc_id").cast("string").alias("node_id"), F.concat(F.lit(" "), F.col("source"), F.lit(".md ")).alias("ref_path"))
    hits = docs.where("n_chars > 2000").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("node_id"))
    covered = docs.where(F.col("text").contains("license")).select(F.col("lang").alias("query_id"), F.concat("source", F.lit(".md")).alias("file"))
    return export.uncovered(export.candidate_paths(hits, nodes), covered)


@_query
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("node_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_version"), (F.col("o_orderstatus") != "F").alias("is_active"))
    return history.point_lookup(o, [str(k) for k in (7, 4, 4, 1, 999_999_999)]).select("node_id", "source_version", F.col("asked").cast("long").alias("asked"))


@_query
def pruned_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").select("event_id", ((F.col("value") - 10) / 1000).alias("weight"), F.col("ts").alias("last_used"))
    return memory.prune_weights(e, F.lit("2024-02-01 00:00:00").cast("timestamp"), 10).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# --- exports and state -----------------------------------------------------------------


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations as documents of their region's version, suppliers as their nodes."""
    docs = _read(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("v"), F.col("n_regionkey")).alias("source_version"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("source_file"), F.lit("p").alias("source_path"), F.sha2("n_name", 256).alias("doc_hash"), (F.col("n_regionkey") != 2).alias("is_active"))
    s = _read(spark, sf, "supplier")
    nodes = s.join(docs.select(F.col("doc_id").alias("n"), "source_version"), F.col("s_nationkey") == F.col("n")).select(F.col("s_nationkey").alias("doc_id"), "source_version", F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"), F.when(F.col("s_suppkey") % 7 == 0, "clause").when(F.col("s_suppkey") % 5 == 0, "section").otherwise("block").alias("kind"), F.lit("l").alias("label"), F.col("s_name").alias("title"), F.concat(F.lit("p"), F.col("s_suppkey") % 10).alias("parent_id"), F.lit(None).cast("string").alias("prev_id"), F.lit(None).cast("string").alias("next_id"), (F.col("s_suppkey") % 4).cast("int").alias("ordinal"), F.concat("s_name", F.lit(".md")).alias("ref_path"), F.lit(True).alias("is_leaf"), (F.col("s_acctbal") > 0).alias("is_active"), F.concat(F.lit(" "), F.col("s_name"), F.lit("\n")).alias("body_md"), F.lit("").alias("body_plain"))
    return docs, nodes


@_query
def canonical_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = _tree(spark, sf)
    return export.manifest_rows(docs, export.leaf_texts(nodes)).select("doc_id", "title", "source_file", "active_version", "canonical_text_path", "canonical_text_sha256")


@_query
def export_locators(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = _tree(spark, sf)
    manifest = export.manifest_rows(docs, export.leaf_texts(nodes))
    none = spark.createDataFrame([], "doc_id bigint, source_version string, edge_type string, from_node_id string, to_node_id string, is_active boolean, confidence double")
    no_alias = spark.createDataFrame([], "doc_id bigint, source_version string, alias string, normalized_alias string, target_node_id string, alias_level string, confidence double, source string, is_active boolean")
    parts = export.sections(docs, nodes, none, no_alias, manifest)
    titles = parts["nodes"].select(F.col("node_id").alias("n"), "doc_title")
    return parts["locators"].join(titles, F.col("node_id") == F.col("n")).select("node_id", "doc_id", "ref_path", "canonical_text_path", "doc_title")


@_query
def export_children(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = _tree(spark, sf)
    return export.children(nodes, docs).select("parent_id", F.col("pos").cast("long").alias("pos"), "node_id")


@_query
def active_parsers(spark: SparkSession, sf: str) -> DataFrame:
    return export.active_parser(_tree(spark, sf)[1])


@_query
def corpus_view(spark: SparkSession, sf: str) -> DataFrame:
    docs, nodes = _tree(spark, sf)
    keyed = nodes.withColumn("node_key", T.node_key("node_id", "source_version"))
    texts = keyed.select("node_key", "body_md", "body_plain")
    return export.corpus_view(keyed.drop("body_md", "body_plain", "title"), docs, texts).select("node_id", "doc_title", export.haystack().alias("plain"))


@_query
def edge_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    n = _read(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit("v").alias("source_version"), F.lit("next").alias("edge_type"), F.col("n_name").alias("from_node_id"), F.col("n_regionkey").cast("string").alias("to_node_id"), F.lit(1).alias("confidence"))
    return export.edge_fingerprints(n).select("id", "fingerprint")


@_query
def documents_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    n = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("title"), F.concat(F.lower("n_name"), F.lit(".md")).alias("source_file"))
    return api.docs(n, "N_1")[1]


@_query
def files_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return api.files(_read(spark, sf, "nation").select(F.concat(F.lit("n/"), F.lower("n_name")).alias("path")), "^nation_2", 0)[1]


@_query
def bodies_from_files(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _tree(spark, sf)[1].withColumn("body_md", F.lit(""))
    files = _read(spark, sf, "supplier").select(F.concat("s_name", F.lit(".md")).alias("ref_path"), F.concat(F.lit("---\nid: x\n---\n\nBody of "), F.col("s_name"), F.lit("  \n\n")).alias("md"))
    return export.bodies_from_files(nodes, files).select("node_id", "body_md")


@F.pandas_udf(BinaryType())
def _docx(levels: pd.Series, titles: pd.Series, texts: pd.Series) -> pd.Series:
    """The least DOCX there is: a heading and a paragraph."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def packed(level: int, title: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>')
        return out.getvalue()

    return pd.Series([packed(*x) for x in zip(levels, titles, texts, strict=True)])


@_query
def extracted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: DOCX, text with a mark, a DOCX that is none, and a suffix that isn't read; errors are rows."""
    parts = _read(spark, sf, "part")
    kind = F.col("p_partkey") % 4
    plain = F.encode(F.concat_ws("\n", "p_name", "p_type"), "UTF-8")
    content = F.when(kind == 0, _docx(F.col("p_size") % 3 + 1, "p_name", "p_type")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).otherwise(plain)
    path = F.concat(F.lit("f"), F.col("p_partkey"), F.when(kind.isin(0, 2), ".docx").when(kind == 1, ".txt").otherwise(".bin"))
    x = A.extract_limited(seconds=60)("path", "content")
    # A small table has few splits, but each of its rows costs Python's time: rows are dealt out first.
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = dealt.select("p_partkey", path.alias("path"), content.alias("content")).select("p_partkey", x.alias("x"))
    return read.select("p_partkey", F.col("x.text").alias("text"), F.substring_index("x.error", ":", 1).alias("error"))
