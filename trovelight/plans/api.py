"""The verbs: bundle, answer, triage, search_lines, files, docs, get_node, history, feedback, vacuum, reindex. Each takes and gives DataFrames."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import BuildError, ConfigError, IntegrityError
from ..functions import constants as K
from ..functions import text as T
from ..operators import export, graph, grep, memory, rank, rebuild, render, search
from ..operators import history as versions
from ..operators.common import broadcast_if_small, materialize
from ..operators.index import doc_stats, postings
from ..sources.writers import SnapshotStore


@dataclass(frozen=True)
class BundleOptions:
    limit: int = 20
    neighbors: int = 1
    graph_depth: int = 1
    edge_types: tuple[str, ...] = K.DEFAULT_WALK
    max_chars: int = 40000
    per_node_max_chars: int = 6000
    body: str = "full"
    max_nodes: int | None = None
    exclude: tuple[str, ...] = ()
    keywords: int = 0


PRESETS = {
    "standard": BundleOptions(),
    "quick": BundleOptions(limit=5, neighbors=0, max_chars=12000, per_node_max_chars=200, body="snippet", max_nodes=10),
}


def preset(name: str, **changes: object) -> BundleOptions:
    """A preset with what the caller sets himself put over it."""
    return replace(PRESETS[name], **changes)


def parse_edge_types(text: str | None) -> tuple[str, ...]:
    """A list of edge types, at commas or spaces, each once; the default types if there is none."""
    names = tuple(dict.fromkeys((text or "").replace(",", " ").split()))
    unknown = [n for n in names if n not in K.EDGE_TYPES]
    if unknown:
        raise ConfigError(f"no such edge type: {', '.join(unknown)}")
    return names or K.DEFAULT_WALK


class Hooks:
    """Functions DataFrame -> DataFrame at named stages of a query; nothing runs that wasn't registered by the caller.

    With allowed, only functions of these names can be registered.
    """

    STAGES = ("pre_search", "post_search", "pre_expand", "pre_render")

    def __init__(self, allowed: tuple[str, ...] | None = None) -> None:
        self.allowed = allowed
        self.at: dict[str, list[Callable[[DataFrame], DataFrame]]] = {s: [] for s in self.STAGES}

    def add(self, stage: str, hook: Callable[[DataFrame], DataFrame]) -> None:
        name = getattr(hook, "__name__", "")
        if stage not in self.at or self.allowed is not None and name not in self.allowed:
            raise ConfigError(f"{name or hook} can't be a hook of {stage}")
        self.at[stage].append(hook)

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        for hook in self.at[stage]:
            df = hook(df)
        return df


@dataclass
class Corpus:
    """nodes, edges, aliases and the index made of them; log and feedback may be empty tables."""

    nodes: DataFrame
    edges: DataFrame | None = None
    aliases: DataFrame | None = None
    log: DataFrame | None = None
    feedback: DataFrame | None = None
    posts: DataFrame | None = None
    stats: DataFrame | None = None
    hooks: Hooks = field(default_factory=Hooks)

    def __post_init__(self) -> None:
        leaves = self.nodes.where("is_active and is_leaf and kind = 'chunk'")
        indexed = self.nodes.where("is_leaf")  # statistics include inactive leaves
        self.leaves = leaves
        self.posts = self.posts if self.posts is not None else postings(indexed)
        self.stats = self.stats if self.stats is not None else doc_stats(indexed)


def bundle(corpus: Corpus, queries: DataFrame, options: BundleOptions = PRESETS["standard"], now: F.Column | None = None) -> DataFrame:
    """queries (query_id, text, mode, must) to (query_id, markdown, node_ids, exhausted), all in one plan.

    Cascade, exclusion, learned order, substring fallback where nothing was found, proximity order,
    expansion, rendering inside the budget.
    """
    queries = corpus.hooks.run("pre_search", queries)
    asked = queries
    if corpus.aliases is not None:
        more = search.expand_with_aliases(queries, corpus.aliases).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "alias")))["alias"], " ").alias("extra"))
        asked = queries.join(more, "query_id", "left").withColumn("text", F.when(F.col("mode") == "and", F.col("text")).otherwise(F.concat_ws(" ", "text", "extra"))).drop("extra")
    found = search.cascade(asked, corpus.posts, corpus.stats)
    order = search.ranked(found, corpus.leaves, queries, 2 * options.limit).select("query_id", "node_id", "rank")
    body = corpus.leaves.select("node_id", "title", "body_plain")
    if options.exclude:
        order = search.exclude_terms(order.join(body, "node_id"), list(options.exclude)).select("query_id", "node_id", "rank")
    if corpus.log is not None and corpus.feedback is not None:
        weights = memory.learned_weights(memory.query_weights(corpus.log, corpus.feedback), now if now is not None else F.current_timestamp())
        keyed = queries.select("query_id", T.query_key("text").alias("query_norm")).join(weights, "query_norm")
        order = rank.learned_boost(order, keyed).select("query_id", "node_id", F.col("boosted").alias("rank"))
    # At most limit rows a query, read by three branches below.
    order = materialize(order.where(F.col("rank") <= options.limit), "order")
    missed = queries.join(order.select("query_id").distinct(), "query_id", "left_anti")
    fallback = search.like_fallback(missed, corpus.leaves, options.limit)
    if options.exclude:
        fallback = search.exclude_terms(fallback.join(body, "node_id"), list(options.exclude))
    order = corpus.hooks.run("post_search", order.unionByName(fallback.select("query_id", "node_id", "rank")))
    near = rank.proximity_rerank(order.join(body, "node_id").join(queries.select("query_id", "text"), "query_id"))
    hits = corpus.hooks.run("pre_expand", near.select("query_id", "node_id", F.col("rank").alias("pos")))
    edges = corpus.edges
    if edges is not None:
        hits = graph.expand_hits(hits, corpus.leaves, edges, options.graph_depth, options.neighbors, options.edge_types, options.limit, options.max_nodes)
    elif options.max_nodes:
        hits = hits.where(F.col("pos") <= options.max_nodes)
    shown = hits.join(corpus.nodes.where("is_active"), "node_id").join(queries.select("query_id", "text"), "query_id")
    shown = corpus.hooks.run("pre_render", shown if "doc_title" in shown.columns else shown.withColumn("doc_title", F.col("doc_id").cast("string")))
    blocks = render.blocks(shown, options.body, options.per_node_max_chars, options.keywords)
    facts = queries.select("query_id", render.header(query=F.concat(F.lit("`"), F.col("text"), F.lit("`")), query_mode=F.col("mode"), limit=F.lit(options.limit), neighbors=F.lit(options.neighbors), graph_depth=F.lit(options.graph_depth)).alias("header"))
    return render.bundle(blocks, facts, options.max_chars)


@dataclass
class Answer:
    """bundles (query_id, markdown, node_ids, exhausted, cached), the cache as it is now, and rows for the query log."""

    bundles: DataFrame
    cache: DataFrame
    log: DataFrame


LOG_SCHEMA = "query_id string, query_text string, cmd string, hits_count int, top_node_ids array<string>, duration_ms int, neighbors int, query_norm string, timestamp timestamp"
FEEDBACK_SCHEMA = "feedback_id string, query_id string, node_id string, feedback_type string, context string, timestamp timestamp"
CACHE_SCHEMA = "cache_key string, cached_at timestamp, markdown string, node_ids array<string>, exhausted boolean"


def answer(corpus: Corpus, queries: DataFrame, options: BundleOptions, cache: DataFrame, now: F.Column) -> Answer:
    """bundle() for what the result cache doesn't hold, with rewrite suggestions, and what is to be written afterwards.

    cache has the columns of CACHE_SCHEMA. Its key is the query's text, mode and must terms, and the options.
    """
    asked = F.to_json(F.struct("mode", "must", F.lit(repr(options)).alias("options")))
    keyed = materialize(queries.withColumn("cache_key", T.cache_key("text", asked)), "asked")
    live = materialize(memory.cache_live(cache, now, key="cache_key"), "cache")  # 50 rows at most
    columns = ["query_id", "cache_key", "markdown", "node_ids", "exhausted"]
    known = keyed.join(F.broadcast(live.drop("cached_at")), "cache_key").select(*columns, F.lit(True).alias("cached"))
    missing = keyed.join(F.broadcast(live.select("cache_key")), "cache_key", "left_anti")
    made = bundle(corpus, missing, options, now).join(keyed.select("query_id", "cache_key"), "query_id")
    if corpus.log is not None and corpus.feedback is not None:
        hits = made.select("query_id", F.posexplode("node_ids").alias("pos", "node_id")).join(missing.select("query_id", T.query_key("text").alias("query_norm")), "query_id").select("query_id", "query_norm", "node_id", (F.col("pos") + 1).alias("rank"))
        better = memory.suggest_rewrites(hits, memory.query_weights(corpus.log, corpus.feedback), corpus.log)
        lines = better.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("s"))
        said = F.concat(F.lit("\n## Related queries\n\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["suggestion"], F.lit("\n"))), ""))
        made = made.join(lines, "query_id", "left").withColumn("markdown", F.concat("markdown", F.coalesce(said, F.lit("")))).drop("s")
    made = materialize(made.select(*columns, F.lit(False).alias("cached")), "bundles")
    bundles = known.unionByName(made)
    fresh = made.select("cache_key", "markdown", "node_ids", "exhausted").dropDuplicates(["cache_key"])
    text = queries.select("query_id", F.col("text").alias("query_text"))
    log = bundles.join(text, "query_id").select(F.col("query_id").cast("string").alias("query_id"), "query_text", F.lit("bundle").alias("cmd"), F.size("node_ids").alias("hits_count"), F.col("node_ids").alias("top_node_ids"), F.lit(options.neighbors).alias("neighbors"), T.query_key("query_text").alias("query_norm"), now.cast("timestamp").alias("timestamp"))
    return Answer(bundles.drop("cache_key"), memory.cache_put(cache, fresh, now, key="cache_key"), log)


def answer_stored(corpus: Corpus, queries: DataFrame, options: BundleOptions, store: SnapshotStore, now: F.Column) -> DataFrame:
    """answer() with cache, log and feedback in store, and what it leaves behind written there. Several callers may do so at once.

    Log rows are added as a part of their own, the cache (50 rows) is put together again where another caller was first.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    log, feedback = stored_log(store), store.read_parts("node_feedback", StructType.fromDDL(FEEDBACK_SCHEMA))
    held = store.read("result_cache") if store.has("result_cache") else empty
    made = answer(replace(corpus, log=log, feedback=feedback), queries, options, held, now)
    store.append("query_log", made.log.withColumn("duration_ms", F.lit(None).cast("int")).select(*StructType.fromDDL(LOG_SCHEMA).names))
    fresh = materialize(made.cache, "cache")  # 50 rows at most
    store.update("result_cache", lambda now_held: memory.cache_live((now_held if now_held is not None else empty).unionByName(fresh), now, key="cache_key"))
    return made.bundles


def stored_log(store: SnapshotStore) -> DataFrame:
    """The query log in store."""
    return store.read_parts("query_log", StructType.fromDDL(LOG_SCHEMA))


def feedback_stored(store: SnapshotStore, query_id: str, node_id: str, feedback_type: str, context: str = "") -> None:
    """A row of feedback in store; weights follow from it when the next query is answered."""
    store.append("node_feedback", feedback_rows(store.spark, query_id, node_id, feedback_type, context))


def reindex(store: SnapshotStore, sources: DataFrame, extract: Callable[[DataFrame], DataFrame], attempts: int = 3, **options: object) -> rebuild.Rebuilt:
    """operators.rebuild.rebuild(), once more from the newest state where another writer was first."""
    for n in range(attempts):
        try:
            return rebuild.rebuild(store, sources, extract, **options)
        except BuildError:
            if n + 1 == attempts:
                raise
    raise ConfigError("no attempts")


def docs(listed: DataFrame, query: str = "", limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, source_file, as of a manifest) whose title or file holds the query: the rows, and one row of Markdown."""
    from pyspark.sql import Window

    found = grep.catalogue(listed, query, limit).select("doc_id", "title", "source_file")
    placed = found.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("title", "doc_id")))
    return found, export.docs_markdown(placed, query)


def files(paths: DataFrame, pattern: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Paths whose last part matches a regex: the rows, and one row of Markdown."""
    found = grep.locate(paths, pattern, limit)
    return found, export.files_markdown(found, pattern)


def history(log: DataFrame, substring: str = "", limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Newest logged queries: the rows, and one row of Markdown."""
    found = memory.history(log, substring, limit)
    return found, export.history_markdown(found)


def triage(corpus: Corpus, queries: DataFrame, paths: DataFrame, options: BundleOptions = PRESETS["quick"], grep_limit: int = 50, file_limit: int = 50, top: int = 30) -> DataFrame:
    """Three engines fused by file: (query_id, item, score, rank). queries may have file_pattern, a regex for paths."""
    found = search.ranked(search.cascade(queries, corpus.posts, corpus.stats), corpus.leaves, queries, options.limit)
    one = found.select("query_id", F.lit(0).alias("list_id"), (F.col("rank") - 1).alias("pos"), F.col("ref_path").alias("item"))
    tokens = queries.select("query_id", T.grep_tokens("text").alias("tokens"))
    lines = grep.grep_queries(corpus.leaves, tokens, grep_limit, text="body_plain")
    files = lines.groupBy("query_id", "file").agg(F.min("pos").alias("pos"))
    two = files.select("query_id", F.lit(1).alias("list_id"), (F.col("pos") - 1).alias("pos"), F.col("file").alias("item"))
    lists = one.unionByName(two)
    if "file_pattern" in queries.columns:
        name = F.regexp_extract("path", r"([^/]*)/*$", 1)
        named = paths.select("path").distinct().join(broadcast_if_small(queries.select("query_id", "file_pattern")), F.call_function("rlike", name, F.col("file_pattern")))
        from pyspark.sql import Window

        placed = named.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("path")) - 1).where(F.col("pos") < file_limit)
        lists = lists.unionByName(placed.select("query_id", F.lit(2).alias("list_id"), "pos", F.col("path").alias("item")))
    return rank.rrf(lists, top=top)


def get_node(nodes: DataFrame, ids: list[str], with_body: bool = True) -> DataFrame:
    found = versions.point_lookup(nodes, ids)
    return found if with_body else found.drop("body_md", "body_plain")


def search_lines(docs: DataFrame, pattern: str = "", query: str = "", fixed: bool = False, per_file: int = 0) -> DataFrame:
    """Exact line search: a pattern (regex, or fixed text with punctuation taken either way), or any word of a query."""
    if bool(pattern) == bool(query):
        raise ConfigError("give a pattern or a query")
    if query:
        return grep.grep_any(docs, query.split(), per_file)
    return grep.grep_tolerant(docs, pattern, per_file) if fixed else grep.grep(docs, pattern, per_file=per_file)


def vacuum(tables: dict[str, DataFrame], keep_days: int | None = None, now: F.Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """docs, nodes, edges and aliases without inactive rows, node_text without orphans; and counts before and after.

    Tables that break an invariant are refused.
    """
    broken = versions.violations(tables["nodes"], tables["edges"]).limit(5).collect()
    if broken:
        raise IntegrityError("not consistent: " + ", ".join(f"{r['check']} {r.id}" for r in broken))
    kept = {name: versions.vacuum(t, keep_days, now) if name != "node_text" else t for name, t in tables.items()}
    if "node_text" in kept:
        kept["node_text"] = versions.drop_orphans(kept["node_text"], kept["nodes"], "node_key")
    counts = None
    for name in tables:
        row = tables[name].agg(F.lit(name).alias("table"), F.count("*").alias("before")).withColumn("after", kept[name].agg(F.count("*").alias("n")).scalar())
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def log_rows(spark: SparkSession, query_text: str, cmd: str, node_ids: list[str], duration_ms: int = 0, neighbors: int = -1) -> DataFrame:
    """One row to append to the query log."""
    schema = "query_id string, query_text string, cmd string, hits_count int, top_node_ids array<string>, duration_ms int, neighbors int"
    row = (uuid.uuid4().hex[:16], query_text, cmd, len(node_ids), list(node_ids), duration_ms, neighbors)
    return spark.createDataFrame([row], schema).withColumns({"query_norm": T.query_key("query_text"), "timestamp": F.current_timestamp()})


def feedback_rows(spark: SparkSession, query_id: str, node_id: str, feedback_type: str, context: str = "") -> DataFrame:
    if feedback_type not in K.FEEDBACK_STEP:
        raise ConfigError(f"feedback is one of {', '.join(K.FEEDBACK_STEP)}")
    row = (uuid.uuid4().hex[:16], query_id, node_id, feedback_type, context)
    return spark.createDataFrame([row], "feedback_id string, query_id string, node_id string, feedback_type string, context string").withColumn("timestamp", F.current_timestamp())


def run_policy(state: dict, actions: dict[str, Callable[[dict], dict]], budget: int = 8) -> tuple[dict, list[str]]:
    """Let state['next'] pick allowed actions until none is named or the budget is used; (state, trace)."""
    trace: list[str] = []
    now = dict(state)
    while len(trace) < budget and (name := now.pop("next", None)):
        if name not in actions:
            raise ConfigError(f"no such action: {name}")
        now = {**now, **actions[name](dict(now))}
        trace.append(name)
    return now, trace


class Timeout:
    """Jobs started inside are cancelled once seconds have passed."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.sc, self.seconds, self.group = spark.sparkContext, seconds, uuid.uuid4().hex

    def __enter__(self) -> Timeout:
        import threading

        self.began = time.monotonic()
        self.sc.setJobGroup(self.group, "query with a time limit", interruptOnCancel=True)
        self.timer = threading.Timer(self.seconds, self.sc.cancelJobGroup, [self.group])
        self.timer.daemon = True
        self.timer.start()
        return self

    def __exit__(self, *exc: object) -> None:
        self.timer.cancel()
        self.sc.setLocalProperty("spark.jobGroup.id", None)
