"""The export contract: five sections, manifests, canonical texts, build state, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import constants as K
from ..functions import text as T
from .common import broadcast_if_small, first_by

# Names of the export's sections and columns.
KEY = ["doc_id", "source_version"]
#: Sections in order, and what each is sorted by.
SECTIONS = {
    "documents": ["doc_id", "source_version"],
    "nodes": ["doc_id", "source_version", "ordinal", "node_id"],
    "edges": ["doc_id", "source_version", "edge_type", "from_node_id", "to_node_id"],
    "aliases": ["doc_id", "source_version", "normalized_alias", "target_node_id", "alias_level"],
    "locators": ["doc_id", "source_version", "ordinal", "node_id"],
}


def canonical_path(doc: Column | str = "doc_id", version: Column | str = "source_version") -> Column:
    """Where a document's canonical text lies, below the export's root."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(version), F.lit("current")), r"[^0-9A-Za-z._-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit("canonical_text/"), col(doc), F.lit("--"), F.when(bare == "", "current").otherwise(bare), F.lit(".txt"))


def leaf_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, source_version, text): canonical text of active leaves (of all active nodes where a document has no leaf), blank line between them."""
    active = nodes.where("is_active").withColumn("_leafy", F.max(F.col("is_leaf").cast("int")).over(Window.partitionBy(*KEY)))
    part = F.regexp_replace(F.coalesce(F.when(F.col("body_md") != "", F.col("body_md")), "body_plain", F.lit("")), r"\A\s+|\s+\z", "")
    rows = active.where((F.col("_leafy") == 0) | F.col("is_leaf")).select(*KEY, F.struct("ordinal", F.coalesce("ref_path", F.lit("")).alias("ref_path"), "node_id", part.alias("part")).alias("x"))
    lists = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("l"))
    return lists.select(*KEY, A.canonical(F.array_join(F.filter(F.col("l.part"), lambda p: p != ""), "\n\n")).alias("text"))


def manifest_rows(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per document and version as manifests list them, with path and digest of its canonical text (an empty one if it has none)."""
    text = F.coalesce("text", F.lit("\n"))
    joined = docs.join(texts.select(*KEY, "text"), KEY, "left")
    return joined.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.coalesce("source_file", F.lit("(unknown)")).alias("source_file"), F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("doc_hash", F.lit("")).alias("doc_hash"), "source_version", F.col("is_active").alias("active_version"), canonical_path().alias("canonical_text_path"), F.sha2(text, 256).alias("canonical_text_sha256"))


def sections(docs: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """The five sections. Nodes take title, file and path of their document; locators where its canonical text lies."""
    listed = manifest.select(*KEY, "canonical_text_path", "canonical_text_sha256")
    documents = docs.join(listed, KEY, "left").select(*KEY, "title", "source_file", "source_path", "doc_hash", "is_active", F.coalesce("canonical_text_path", F.lit("")).alias("canonical_text_path"), F.coalesce("canonical_text_sha256", F.lit("")).alias("canonical_text_sha256"))
    of_doc = documents.select(*KEY, F.col("title").alias("doc_title"), "source_file", "source_path", "canonical_text_path", "canonical_text_sha256")
    wide = nodes.join(of_doc, KEY, "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    spans = [F.col(c) if c in nodes.columns else F.lit(None).cast("int").alias(c) for c in ("raw_span_start", "raw_span_end")]
    columns = ["node_id", *KEY, "kind", "label", "title", "parent_id", "prev_id", "next_id", "ordinal", "ref_path", "is_leaf", "is_active"]
    return {
        "documents": documents,
        "nodes": wide.select(*columns, *spans, empty("doc_title"), empty("source_file"), empty("source_path")),
        "edges": edges.select("doc_id", "source_version", "edge_type", "from_node_id", "to_node_id", "is_active", "confidence"),
        "aliases": aliases.select("doc_id", "source_version", "alias", "normalized_alias", "target_node_id", "alias_level", "confidence", "source", "is_active"),
        "locators": wide.select("node_id", *KEY, "ordinal", "ref_path", *spans, empty("canonical_text_path"), empty("canonical_text_sha256")),
    }


# --- reading an export back ---------------------------------------------------


def latest_documents(documents: DataFrame) -> DataFrame:
    """One row per document: active ones only, the greatest version."""
    return first_by(documents.where("is_active"), ["doc_id"], F.desc("source_version"))


def latest_nodes(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per node of an active document: active, the greatest version."""
    there = documents.where("is_active").select(*KEY).distinct()
    return first_by(nodes.where("is_active").join(there, KEY, "left_semi"), ["node_id"], F.desc("source_version"))


def children(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(parent_id, pos, node_id): active children of each node, by ordinal and id."""
    rows = latest_nodes(nodes, documents).where("parent_id is not null and parent_id <> ''")
    order = Window.partitionBy("parent_id").orderBy("ordinal", "node_id")
    return rows.select("parent_id", F.row_number().over(order).alias("pos"), "node_id")


def corpus_view(nodes: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes with their document's title and file, and their bodies from a table by node key."""
    of_doc = docs.select(*KEY, F.col("title").alias("doc_title"), "source_file")
    return nodes.join(of_doc, KEY).join(texts.select("node_key", "body_md", "body_plain"), "node_key")


def candidate_paths(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, ref_path): files of the nodes that a query hit, each once."""
    found = hits.select("query_id", "node_id").join(nodes.select("node_id", F.trim("ref_path").alias("ref_path")), "node_id")
    return found.where("ref_path <> ''").select("query_id", "ref_path").distinct()


def uncovered(candidates: DataFrame, covered: DataFrame) -> DataFrame:
    """Candidates (query_id, ref_path) that the line search (query_id, file) has not found by itself."""
    return candidates.join(covered.select("query_id", F.col("file").alias("ref_path")).distinct(), ["query_id", "ref_path"], "left_anti")


def bodies_from_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Leaves with body_md from their file (ref_path, md) where the table has none: frontmatter off, one line feed at the end.

    A path that is absolute or climbs out of the root, a leaf without a path and a missing file are errors when the rows are read.
    """
    escapes = F.col("ref_path").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    read = files.select(F.col("ref_path").alias("_path"), "md")
    rows = nodes.where("is_leaf").join(read, F.col("ref_path") == F.col("_path"), "left")
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("node_id"))).cast("string")
    body = F.concat(F.regexp_replace(T.strip_frontmatter("md"), r"\s+\z", ""), F.lit("\n"))
    kept = F.when(F.col("body_md") != "", F.col("body_md"))
    found = F.when(kept.isNotNull(), kept).when(F.coalesce("ref_path", F.lit("")) == "", said("a leaf without a path")).when(escapes, said("a path outside of the root")).when(F.col("md").isNull(), said("a missing file")).otherwise(body)
    return rows.withColumn("body_md", found).drop("_path", "md")


def haystack(plain: Column | str = "body_plain", md: Column | str = "body_md") -> Column:
    """A node's plain text: as stored, else from its Markdown."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(col(plain) != "", col(plain)), F.when(col(md) != "", T.markdown_to_plain(col(md))), F.lit(""))


# --- build state ----------------------------------------------------------------


def alias_fingerprints(aliases: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in ("normalized_alias", "target_node_id", "alias_level", "confidence", "source")}
    return aliases.select(*KEY, F.concat_ws("|", "normalized_alias", "target_node_id", "alias_level").alias("id"), T.fingerprint(**fields).alias("fingerprint"))


def edge_fingerprints(edges: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in ("edge_type", "from_node_id", "to_node_id", "confidence")}
    return edges.select(*KEY, F.concat_ws("|", "edge_type", "from_node_id", "to_node_id").alias("id"), T.fingerprint(**fields).alias("fingerprint"))


def source_fingerprint(content: Column | str, fallback: Column | str) -> Column:
    """Digest of a file's bytes, or of a text that stands for it where it can't be read."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.sha2(F.coalesce(col(content), F.encode(col(fallback), "utf-8")), 256)


def active_parser(nodes: DataFrame) -> DataFrame:
    """(doc_id, source_version, active_parser): which parser the kinds of a document's active nodes tell of."""
    place = F.coalesce(*[F.when(F.col("kind").isin(*kinds), k) for k, (_, kinds) in enumerate(K.PARSER_KINDS)], F.lit(len(K.PARSER_KINDS)))
    names = F.array(*[F.lit(name) for name, _ in K.PARSER_KINDS], F.lit(""))
    return nodes.where("is_active").groupBy(*KEY).agg(F.get(names, F.min(place)).alias("active_parser"))


def binding_digest(rows: DataFrame, line: Column, order: list[str], blocks: int = 4096) -> DataFrame:
    """One row: a digest that all rows' lines in order have in common. Blocks of rows are digested first, so no task holds all lines."""
    placed = rows.select(F.pmod(F.xxhash64(*order), F.lit(blocks)).alias("block"), F.struct(*order, line.alias("_line")).alias("x"))
    digest = lambda items: F.sha2(F.array_join(items, "\n"), 256)
    per = placed.groupBy("block").agg(digest(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_line"])).alias("d"))
    return per.agg(digest(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"])).alias("sha256"))


def audit_markdown(facts: DataFrame, title: str) -> DataFrame:
    """One row: a heading and a line per fact (name, value), by name."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": `"), F.col("value").cast("string"), F.lit("`\n"))
    lines = facts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "").alias("l"))
    return lines.select(F.concat(F.lit(f"# {title}\n\n"), "l").alias("markdown"))


def docs_markdown(docs: DataFrame, query: str) -> DataFrame:
    """One row: documents (doc_id, title, source_file, pos) as a Markdown table, in order of pos."""
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    toc = F.concat(F.lit("`references/"), F.col("doc_id"), F.lit("/toc.md`"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", tick("doc_id"), "title", tick("source_file"), toc), F.lit(" |\n"))
    rows = docs.agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))).alias("r"))
    head = f"# Docs\n\n- query: `{query or '(none)'}`\n- hits: "
    return rows.select(F.concat(F.lit(head), F.size("r").cast("string"), F.lit("\n\n| doc_id | 标题 | 源文件 | 目录 |\n|---|---|---|---|\n"), F.array_join(F.transform("r", lambda x: x["row"]), "")).alias("markdown"))


def files_markdown(paths: DataFrame, pattern: str) -> DataFrame:
    """One row: paths (path) as a list, sorted."""
    lines = paths.agg(F.array_sort(F.collect_list("path")).alias("p"))
    return lines.select(F.concat(F.lit(f"# Files\n\n- pattern: `{pattern}`\n- hits: "), F.size("p").cast("string"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))), "")).alias("markdown"))


def history_markdown(rows: DataFrame) -> DataFrame:
    """One row: log rows (timestamp, query_id, query_text, hits_count), newest first."""
    line = F.concat(F.lit("- "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" `"), F.col("query_id"), F.lit("` "), F.col("query_text"), F.lit(" ("), F.col("hits_count").cast("string"), F.lit(")\n"))
    lists = rows.agg(F.sort_array(F.collect_list(F.struct("timestamp", "query_id", line.alias("line"))), asc=False).alias("l"))
    return lists.select(F.concat(F.lit("# History\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("markdown"))


def normalized_terms(queries: DataFrame) -> DataFrame:
    """queries (query_id, text in NFKC) with normalized, article_terms, title_terms and alias_terms."""
    rows = queries.withColumn("normalized", T.normalized_query("text")).withColumns({"article_terms": T.article_terms("normalized"), "title_terms": T.title_terms("normalized")})
    return rows.withColumn("alias_terms", F.array_distinct(F.filter(F.array_prepend("title_terms", F.col("normalized")), lambda t: t != "")))


def structural_hits(queries: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, route, pos, item): nodes that a normalised query names by article label, title or alias, for rank.merge_routes()."""
    asked = normalized_terms(queries)
    active = nodes.where("is_active and is_leaf")
    order = lambda route: Window.partitionBy("query_id").orderBy("doc_id", "ordinal", "node_id")
    found = []
    for route, terms, key in (("structural", "article_terms", T.article_reference("label")), ("title", "title_terms", T.core_title("title"))):
        wanted = broadcast_if_small(asked.select("query_id", F.explode(terms).alias("term")))
        hits = active.withColumn("term", key).join(wanted, "term").select("query_id", "doc_id", "ordinal", "node_id").distinct()
        found.append(hits.select("query_id", F.lit(route).alias("route"), (F.row_number().over(order(route)) - 1).alias("pos"), F.col("node_id").alias("item")))
    if aliases is not None:
        wanted = broadcast_if_small(asked.select("query_id", F.explode(F.transform("alias_terms", T.alias_form)).alias("normalized_alias")).where("normalized_alias <> ''").distinct())
        hits = aliases.where("is_active").join(wanted, "normalized_alias").groupBy("query_id", "target_node_id").agg(F.max("confidence").alias("c"), F.min("alias_level").alias("level"))
        place = Window.partitionBy("query_id", "level").orderBy(F.desc("c"), "target_node_id")
        route = F.when(F.col("level") == "exact", "alias").otherwise("alias_abbreviation")
        found.append(hits.select("query_id", route.alias("route"), (F.row_number().over(place) - 1).alias("pos"), F.col("target_node_id").alias("item")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
