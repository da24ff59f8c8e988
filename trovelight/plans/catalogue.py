"""The operators on the driver's tables, by name. The SQL for each is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..operators import corpus, graph, grep, history, index, memory, rank, rebuild, render, search, segments
from ..operators.common import materialize, scratch_path
from ..sources import readers, writers
from ..streaming import memory as stream
from . import api
from .catalogue_more import MORE
from .oracles import ORACLES
from .oracles_more import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- shapes that the tables take ---------------------------------------------


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """documents as leaf nodes, one each."""
    docs = _read(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return docs.select(name.alias("node_key"), name.alias("node_id"), "doc_id", F.lit(1).alias("ordinal"), F.col("source").alias("title"), F.col("lang").alias("heading_path"), F.col("text").alias("body_plain"))


def _queries(spark: SparkSession, sf: str, mode: str = "or", must: bool = False) -> DataFrame:
    items = _read(spark, sf, "benchmark")
    first = F.array(F.get(F.split("text", " "), F.lit(0))) if must else T.empty_strings()
    return items.select(F.col("item_id").alias("query_id"), "text", F.lit(mode).alias("mode"), first.alias("must"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as a tree: turns are linked chunks of a conversation."""
    rows = _read(spark, sf, "conversations")
    node = F.concat_ws(":", F.lit("c"), "conv_id", "turn")
    return rows.select(F.col("conv_id").alias("doc_id"), F.lit("current").alias("source_version"), node.alias("node_id"), F.lit("chunk").alias("kind"), F.concat(F.lit("c:"), F.col("conv_id")).alias("parent_id"), F.col("turn").cast("int").alias("ordinal"), F.lit(True).alias("is_active"), F.lit(True).alias("is_leaf"), F.col("role").alias("title"), F.col("text").alias("body_plain"))


def _turn_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.structure_edges(corpus.sibling_links(_turns(spark, sf)))


def _log(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """events as a query log: the user is the query, k of props the node returned."""
    e = events if events is not None else _read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").cast("string").alias("query_id"), F.concat(F.lit("User "), F.col("user_id"), F.lit(" "), F.col("event_type")).alias("query_text"), F.col("user_id").cast("string").alias("query_norm"), F.col("ts").alias("timestamp"), "event_type", F.array(F.concat(F.lit("n"), k)).alias("top_node_ids"), (k % 3).alias("neighbors"), F.concat(F.lit("n"), k).alias("node_id"))


def _deltas(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """purchase +2, error -3, view +1, signup and click nothing; by user and k."""
    delta = F.when(F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "error", -3.0).when(F.col("event_type") == "view", 1.0)
    return _log(spark, sf, events).select("query_norm", "node_id", delta.alias("delta"), F.col("timestamp").alias("ts"), F.col("query_id").cast("long").alias("seq")).where("delta is not null")


_NOW = "2024-02-01 00:00:00"


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


# --- tokens and index ----------------------------------------------------------


@_query
def fts_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.fts_tokens("text")
    return _read(spark, sf, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@_query
def fts_token_df(spark: SparkSession, sf: str) -> DataFrame:
    return index.token_stats(index.postings(_nodes(spark, sf)))


@_query
def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return index.doc_stats(_nodes(spark, sf))


@_query
def cjk_bigrams_literals(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "预应力混凝土"), (2, "梁"), (3, "钢筋"), (4, "预应力混凝土结构设计规范"), (5, "a钢筋b混凝土"), (6, "")]
    return spark.createDataFrame(rows, "id long, t string").select("id", F.array_join(T.cjk_tokens("t"), " ").alias("tokens"))


@_query
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", T.count_occurrences("text", F.lit("the")).alias("n_the"), T.count_occurrences("text", F.lit("onon")).alias("n_onon"))


@_query
def keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Words by language, stop words out: count and documents."""
    return index.word_counts(_read(spark, sf, "documents"))


@_query
def keywords_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", T.keywords("text").alias("keywords"))


# --- search --------------------------------------------------------------------


_STORED: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> segments.TokenIndex:
    """The stored index of documents: built by the first query of an application that asks for it, and anew if the table's files change."""
    state = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf}/documents.parquet").select("path", "length", "modificationTime")
    mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    key = (spark.sparkContext.applicationId, f"{sf}:{mark[0]}:{mark[1]}")
    if key not in _STORED:
        made = segments.TokenIndex(spark, scratch_path(spark, "index"))
        made.build(_nodes(spark, sf))
        _STORED[key] = made.root
    return segments.TokenIndex(spark, _STORED[key])


def _topk(spark: SparkSession, sf: str, mode: str, must: bool, limit: int = 20) -> DataFrame:
    nodes, asked = _nodes(spark, sf), _queries(spark, sf, mode, must)
    found = _index(spark, sf).hits(asked, limit)
    return search.ranked(found, nodes, asked, limit).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@_query
def bm25_topk_or(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "or", False)


@_query
def bm25_topk_and(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "and", False)


@_query
def bm25_must_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "or", True)


@_query
def search_cascade_level(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).cascade(_queries(spark, sf, "and", True), None).select("query_id", F.col("level").cast("long").alias("level"), "n_hits")


def _updated(spark: SparkSession, sf: str) -> tuple[segments.TokenIndex, DataFrame]:
    """An index of documents as they were, brought up to date by their change set, and the nodes as they are."""
    before, after = _versions(spark, sf)
    as_nodes = lambda d: d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("node_key"), "doc_id", F.col("text").alias("body_plain"))
    held = segments.TokenIndex(spark, scratch_path(spark, "index"))
    held.build(as_nodes(before))
    held.update(as_nodes(before), as_nodes(after), history.change_set(before, after))
    return held, as_nodes(after)


@_query
def index_update_df(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies of an index after an update: those of a fresh build."""
    return _updated(spark, sf)[0].token_stats()


@_query
def index_update_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best five documents of an index after an update and after it is compacted."""
    held, _ = _updated(spark, sf)
    asked = _queries(spark, sf)
    once = materialize(held.hits(asked, 5), "hits")
    held.compact()
    again = held.hits(asked, 5)
    told = lambda df, name: df.select(F.lit(name).alias("state"), "query_id", F.substring("node_key", 2, 8).cast("long").alias("doc_id"), F.round("score", 6).alias("score"))
    return told(once, "updated").unionByName(told(again, "compacted"))


@_query
def exclude_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.exclude_terms(_nodes(spark, sf), ["the ", "QUE", "src1"]).select("doc_id")


@_query
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.like_fallback(_queries(spark, sf), _nodes(spark, sf), 20).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


@_query
def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(F.lit("tion"), F.lit("ung"), F.lit("eaux"), F.lit("ción"))
    return _read(spark, sf, "documents").select("doc_id", T.extract_window("text", terms, 120).alias("snippet"))


# --- lines, files, catalogue -----------------------------------------------------


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("ref_path"), "text")


@_query
def grep_lines_regex(spark: SparkSession, sf: str) -> DataFrame:
    return grep.grep(_files(spark, sf), "[Tt]ion [a-z]{2}\\.")


@_query
def grep_lines_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return grep.grep(_files(spark, sf), "and the", fixed=True, per_file=3)


@_query
def grep_terms_or(spark: SparkSession, sf: str) -> DataFrame:
    return grep.grep_any(_files(spark, sf), ["password", "token", "license", "the onon"])


@_query
def grep_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten lines of each benchmark text's tokens."""
    asked = _queries(spark, sf).select("query_id", T.grep_tokens("text").alias("tokens"))
    return grep.grep_queries(_files(spark, sf), asked, 10).select("query_id", "file", "line_number", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("pos").cast("long").alias("pos"))


@_query
def grep_punct_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    return grep.grep_tolerant(_files(spark, sf), "the，")


@_query
def files_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return grep.locate(_read(spark, sf, "pages"), "^[0-9]{2,3}(\\?|$)", path="url")


@_query
def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.concat(F.lit("Docs/"), F.col("lang"), F.lit(".md")).alias("source_file"))
    return grep.catalogue(docs, "SRC1").select("doc_id", "title")


# --- corpus structure ------------------------------------------------------------


@_query
def block_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\. ?\n", ".\n\n").alias("text"))
    return corpus.block_spans(docs).select("doc_id", F.col("reading_order").cast("long").alias("reading_order"), "char_start", "char_end")


@_query
def chunk_document(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_rows(_read(spark, sf, "documents"))


@_query
def chunk_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_statistics(corpus.chunk_rows(_read(spark, sf, "documents")))


@_query
def heading_inference(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.regexp_replace("text", "\n", "\n\n")
    return corpus.heading_rows(_read(spark, sf, "documents").select("doc_id", T.inferred_headings(spaced).alias("text")))


@_query
def sibling_links(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sibling_links(_turns(spark, sf)).select("node_id", "prev_id", "next_id")


@_query
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return readers.pages_as_documents(_read(spark, sf, "pages")).select(F.col("doc_id").alias("page_id"), F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))


# --- graph -----------------------------------------------------------------------


@_query
def structure_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_edges(spark, sf).select("edge_type", "from_node_id", "to_node_id")


@_query
def neighbor_range_join(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    hits = turns.where("title = 'assistant'").select(F.col("doc_id").alias("query_id"), "node_id")
    return graph.neighbors(hits, turns, 1).select("query_id", "node_id", F.col("distance").cast("long").alias("distance"))


@_query
def graph_walk_depth2(spark: SparkSession, sf: str) -> DataFrame:
    seeds = _turns(spark, sf).where("ordinal = 0").select(F.col("doc_id").alias("query_id"), "node_id")
    return graph.walk(seeds, _turn_edges(spark, sf), 2, ("prev", "next")).select("query_id", "node_id", F.col("depth").cast("long").alias("depth"))


@_query
def passage_mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that name the first long word of another turn of their conversation."""
    turns = _turns(spark, sf)
    word = F.regexp_extract("body_plain", "[A-Za-z]{4,}", 0)
    names = turns.select("doc_id", "source_version", word.alias("name"), T.alias_form(word).alias("form"), F.col("node_id").alias("target_node_id"), F.lit(1.0).alias("confidence"))
    return graph.mention_edges(turns, names).select("from_node_id", "to_node_id")


@_query
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation that share tokens; the caps of a document are those of a conversation."""
    return graph.cooccurrence_edges(_turns(spark, sf), min_shared=2).select("doc_id", "from_node_id", "to_node_id", "confidence")


@_query
def alias_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of parts as aliases of one node per type: equal normal forms of a target meet once."""
    parts = _read(spark, sf, "part")
    nodes = parts.select(F.col("p_brand").alias("doc_id"), F.lit("current").alias("source_version"), F.lit(True).alias("is_active"), F.lit(True).alias("is_leaf"), F.lit("article").alias("kind"), F.col("p_type").alias("node_id"), F.initcap("p_name").alias("title"), F.lit("").alias("body_plain"))
    return graph.extract_aliases(nodes).select("normalized_alias", "target_node_id", "alias_level", "alias", "source", "confidence")


@_query
def dedupe_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = _turn_edges(spark, sf)
    weaker = edges.withColumn("confidence", F.lit(0.4))
    return graph.dedupe_edges(edges.where("edge_type = 'prev'"), weaker).groupBy("edge_type", "confidence").agg(F.count("*").alias("n"))


@_query
def expand_hits(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    hits = turns.where("ordinal = 1").select(F.col("doc_id").alias("query_id"), "node_id", F.lit(1).alias("pos"))
    return graph.expand_hits(hits, turns, _turn_edges(spark, sf), 1, 1, ("next",), 20).select("query_id", "node_id", F.col("pos").cast("long").alias("pos"))


# --- ranks -----------------------------------------------------------------------


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    rows = None
    for k, column in enumerate(("n_chars", "n_lines", "doc_id")):
        pos = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(column), "doc_id")) - 1
        part = docs.select(F.col("lang").alias("query_id"), F.lit(k).alias("list_id"), pos.alias("pos"), F.col("doc_id").alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@_query
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rrf(_lists(spark, sf)).select("query_id", "item", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@_query
def route_merge(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(r) for r in ("body", "title", "alias_soft")])
    return rank.merge_routes(_lists(spark, sf).withColumn("route", F.get(names, F.col("list_id")))).select("query_id", "item", F.col("rank").cast("long").alias("rank"))


@_query
def merge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    a = grep.grep(_files(spark, sf), "password", fixed=True)
    b = grep.grep_any(_files(spark, sf), ["password", "token"])
    placed = lambda df: df.select("file", "line_number", (F.row_number().over(Window.partitionBy("file").orderBy("line_number")) - 1).cast("long").alias("pos"))
    return rank.merge_dedupe(placed(a), placed(b), ["file", "line_number"]).select("file", "line_number", F.col("prio").cast("long").alias("prio"), "pos")


@_query
def proximity_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The bonus of two words in every document; first ten occurrences of each."""
    window = A.min_window("text", F.array(F.lit("tion"), F.lit("ment")))
    return _read(spark, sf, "documents").select("doc_id", rank.proximity_bucket(window).alias("bonus"))


@_query
def learned_boost_order(spark: SparkSession, sf: str) -> DataFrame:
    hits = _log(spark, sf).groupBy(F.col("query_norm").alias("query_id"), "node_id").agg(F.max("timestamp").alias("t"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("t"), "node_id")))
    learned = memory.learned_weights(memory.fold_weights(_deltas(spark, sf), ["query_norm", "node_id"], ["ts", "seq"]), _now()).withColumnRenamed("query_norm", "query_id")
    return rank.learned_boost(hits, learned).select("query_id", "node_id", F.col("boosted").cast("long").alias("boosted"))


# --- history ---------------------------------------------------------------------


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """documents as they were (one source was named otherwise, some were not there) and as they are."""
    docs = _read(spark, sf, "documents").select("doc_id", "source", "text")
    marked = lambda d: d.withColumns({"source_fingerprint": F.sha2(F.concat_ws("|", "source", "text"), 256), "text_fingerprint": F.sha2("text", 256)})
    before = docs.where("source <> 'src3'").withColumn("source", F.when(F.col("source") == "src5", "old5").otherwise(F.col("source"))).withColumn("text", F.when(F.col("source") == "src7", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return marked(before), marked(docs.where("source <> 'src9'"))


@_query
def merge_history(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _versions(spark, sf)
    rows = lambda d: d.select("doc_id", "source", F.lit(True).alias("is_active"))
    return history.merge_history(rows(before), rows(after), ["doc_id"])


@_query
def change_set(spark: SparkSession, sf: str) -> DataFrame:
    return history.change_set(*_versions(spark, sf))


@_query
def incremental_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and rows of a corpus built from documents as they were and rebuilt to what they are: those of a full build, and each document's change."""
    before, after = _versions(spark, sf)
    store = writers.SnapshotStore(spark, scratch_path(spark, "corpus"))
    rows = lambda d: d.select("doc_id", "source_fingerprint", "source", "text")
    extract = lambda d: d.select("doc_id", F.lit("Document").alias("title"), F.lit("d.md").alias("source_file"), "text")
    for state in (before, after):
        done = api.reindex(store, rows(state), extract, buckets=64, unheld=("text",))
    nodes = rebuild.stored(store, "nodes", corpus.build_nodes(extract(rows(after)))).where("kind = 'chunk'")
    chunks = nodes.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"), F.max(F.struct("ordinal", F.sha2("body_md", 256).alias("sha")))["sha"].alias("last_sha256"))
    docs = rebuild.stored(store, "docs", rows(after).drop("text").withColumn("doc_id", F.col("doc_id").cast("string"))).select("doc_id", "source")
    told = done.changes.join(docs, "doc_id", "left").join(chunks, "doc_id", "left")
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "change", "source", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"), "last_sha256")


@_query
def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _versions(spark, sf)
    return history.fingerprint_diff(before, after, "doc_id", "text_fingerprint")


@_query
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _versions(spark, sf)
    return history.apply_changes(before.select("doc_id", "source"), after.select("doc_id", "source"), history.change_set(before, after)).groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@_query
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").select("user_id", "event_type", (F.col("value") >= 5).alias("is_active"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("source_version"))
    return history.latest_versions(rows, ["user_id", "event_type"])


@_query
def single_active_invariant(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("node_id"), F.col("event_id").cast("string").alias("source_version"), (F.col("value") >= 40).alias("is_active"))
    none = spark.createDataFrame([], "from_node_id string, to_node_id string, is_active boolean")
    return history.violations(rows, none).where("check = 'single_active'")


@_query
def vacuum_purge(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 500).alias("is_active"))
    live = history.vacuum(docs)
    return history.drop_orphans(_read(spark, sf, "labels"), live, "doc_id").select("doc_id", "quality")


@_query
def export_digest(spark: SparkSession, sf: str) -> DataFrame:
    n = _read(spark, sf, "nation")
    return history.group_digests(n, ["n_regionkey"], F.concat(F.lit('{"key":'), F.col("n_nationkey"), F.lit(',"name":"'), F.col("n_name"), F.lit('"}')))


@_query
def footprint(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _versions(spark, sf)
    lines = F.transform(F.split("text", "\n"), lambda x: F.sha2(x, 256))
    state = after.select("doc_id", F.map_from_arrays(F.array_distinct(lines), F.array_distinct(lines)).alias("span_fingerprints"), F.create_map().cast("map<string,string>").alias("node_fingerprints"))
    return history.footprint(state, history.change_set(before, after))


@_query
def prefix_shards(spark: SparkSession, sf: str) -> DataFrame:
    return writers.prefix_shards(_read(spark, sf, "part"), "p_name", max_rows=60).groupBy("shard").agg(F.count("*").alias("n"))


@_query
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part")
    title = F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" V"), F.col("p_size"))).otherwise(""))
    return p.select("p_partkey", T.slug(title).alias("slug"), T.source_version(title, F.lit("part.md")).alias("version"), T.node_key(F.col("p_partkey").cast("string"), T.source_version(title, F.lit("x"))).alias("node_key"), F.array_join(T.title_keywords(title), "|").alias("words"), T.query_key(title).alias("query_key"))


@_query
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.countDistinct("k").alias("k_distinct"))


@_query
def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    return render.within_budget(docs, F.col("n"), 40000, ["source"], ["doc_id"]).select("doc_id", F.col("used").cast("long").alias("used"))


# --- memory ----------------------------------------------------------------------


@_query
def weights_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = memory.fold_weights(_deltas(spark, sf), ["query_norm"], ["ts", "seq"])
    return folded.select("query_norm", "weight", F.col("pos_count").cast("long").alias("pos_count"), F.col("neg_count").cast("long").alias("neg_count"))


@_query
def streamed_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights that a stream over events has folded by the time its watermark stands an hour behind the latest event."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")  # a pattern, since a stream's path is a folder or a pattern
    store = writers.SnapshotStore(spark, scratch_path(spark, "streamed"))
    stream.fold_available(_deltas(spark, sf, events), store, scratch_path(spark, "stream-state"))
    return stream.weights_of(store).select("query_norm", "node_id", "weight", "pos_count", "neg_count")


@_query
def decayed_weights(spark: SparkSession, sf: str) -> DataFrame:
    folded = memory.fold_weights(_deltas(spark, sf), ["query_norm", "node_id"], ["ts", "seq"])
    return memory.learned_weights(folded, _now()).select("query_norm", "node_id", F.round("weight", 6).alias("weight"))


@_query
def neighbor_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    feedback = log.select(F.col("query_id").alias("feedback_id"), "query_id", kind.alias("feedback_type"), "timestamp")
    asked = log.select(F.col("query_norm").alias("query_id"), F.col("query_norm").alias("text")).distinct()
    return memory.recommend_neighbors(asked, log, feedback).select("query_id", F.col("neighbors").cast("long").alias("neighbors"))


@_query
def query_stats_top5(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return memory.stats(log, log, log, _now())[1]


@_query
def queries_last_7d(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return memory.stats(log, _deltas(spark, sf), log, _now())[0]


@_query
def rewrite_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    weights = memory.fold_weights(_deltas(spark, sf), ["query_norm", "node_id"], ["ts", "seq"])
    hits = log.select(F.col("query_norm").alias("query_id"), "query_norm", "node_id")
    return memory.suggest_rewrites(hits, weights, log, nodes=None).select("query_id", "suggestion", F.col("rank").cast("long").alias("rank"))


@_query
def similar_queries(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    asked = log.select(F.col("query_norm").alias("query_id"), F.col("query_norm").alias("text")).distinct()
    return memory.similar_queries(asked, log, _now(), days=20).select("query_id", "log_id", F.col("rank").cast("long").alias("rank"))


@_query
def history_newest(spark: SparkSession, sf: str) -> DataFrame:
    return memory.history(_log(spark, sf), "PURCHASE", 50).select("query_id", "query_text")


@_query
def cache_ttl_lru(spark: SparkSession, sf: str) -> DataFrame:
    cache = _log(spark, sf).select("query_norm", F.col("timestamp").alias("cached_at"), "query_id")
    return memory.cache_live(cache, _now(), seconds=2 * 86400, most=50).select("query_norm", "query_id")


@_query
def label_feedback_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(_read(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


# --- verbs -----------------------------------------------------------------------


def _corpus(spark: SparkSession, sf: str) -> api.Corpus:
    turns = corpus.sibling_links(_turns(spark, sf))
    nodes = turns.withColumns({"node_key": F.col("node_id"), "heading_path": F.lit(""), "body_md": F.col("body_plain"), "ref_path": F.concat(F.lit("conversations/"), F.col("doc_id"), F.lit(".md"))})
    return api.Corpus(nodes, edges=graph.structure_edges(turns))


@_query
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    found = api.bundle(_corpus(spark, sf), _queries(spark, sf), api.preset("quick"), now=_now())
    return found.select("query_id", F.size("node_ids").alias("n_nodes"), "exhausted", "markdown")


@_query
def triage(spark: SparkSession, sf: str) -> DataFrame:
    paths = _read(spark, sf, "pages").select(F.col("url").alias("path"))
    return api.triage(_corpus(spark, sf), _queries(spark, sf).withColumn("file_pattern", F.lit("^[0-9]+$")), paths)


QUERIES |= MORE
ORACLES |= SQL
__all__ = ["ORACLES", "QUERIES"]
