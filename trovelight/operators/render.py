"""Evidence bundles: blocks of Markdown inside a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BODY_MODES = ("full", "snippet", "none")


def body(mode: str, per_node: int, terms: Column) -> Column:
    """A node's body as shown: whole, cut at per_node characters, or a snippet around the query's terms; marked if cut."""
    if mode not in BODY_MODES:
        raise ValueError(f"body is one of {', '.join(BODY_MODES)}")
    md = F.coalesce("body_md", F.lit(""))
    if mode == "none":
        return F.lit("")
    if mode == "snippet":
        bare = F.trim(T.extract_window("body_plain", terms, min(per_node or 800, 1200)))
        return F.when(bare == "", "").otherwise(F.concat(F.lit("*(SNIPPET)*\n\n"), bare, F.lit("\n\n")))
    whole = F.when(md == "", "").otherwise(F.concat(md, F.lit("\n")))
    if per_node <= 0:
        return whole
    cut = F.concat(F.lit("*(TRUNCATED)*\n\n"), F.regexp_replace(F.substring(md, 1, per_node), r"\s+$", ""), F.lit("\n\n"))
    return F.when(F.char_length(md) > per_node, cut).otherwise(whole)


def blocks(nodes: DataFrame, mode: str = "full", per_node: int = 6000, keywords: int = 0) -> DataFrame:
    """nodes (query_id, text, pos, node_id, title, doc_id, doc_title, ref_path, body_md, body_plain) with block."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    words = F.lit("")
    if keywords:
        some = F.slice(F.filter(F.split(F.coalesce("keywords", F.lit("")), " "), lambda k: k != ""), 1, keywords)
        words = F.when(F.size(some) > 0, F.concat(F.lit("- keywords: "), F.array_join(F.transform(some, tick), ", "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### "), tick(F.col("node_id")), F.lit(" "), F.col("title"), F.lit("\n\n- doc: "), F.col("doc_title"), F.lit(" ("), tick(F.col("doc_id").cast("string")), F.lit(")\n- ref: "), tick(F.col("ref_path")), F.lit("\n"), words, F.lit("\n"))
    return nodes.withColumn("block", F.concat(head, body(mode, per_node, T.query_terms("text"))))


def within_budget(rows: DataFrame, size: Column, budget: int, partition: list[str], order: list[str], used: Column | int = 0) -> DataFrame:
    """The first rows of each group that fit the budget together; the first that doesn't fit ends the group."""
    spec = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(spec) + (F.lit(used) if isinstance(used, int) else used)
    kept = rows.withColumn("used", total)
    return kept.where(F.col("used") <= budget) if budget > 0 else kept


def bundle(rows: DataFrame, facts: DataFrame, max_chars: int) -> DataFrame:
    """(query_id, markdown, node_ids, exhausted): header, evidence in order of pos, references to what is shown.

    rows: query_id, pos, node_id, ref_path, block. facts: query_id, header; every one gets a bundle.
    """
    joined = rows.join(facts.select("query_id", F.char_length("header").alias("head")), "query_id")
    shown = within_budget(joined, F.char_length("block"), max_chars, ["query_id"], ["pos"], F.col("head"))
    of = lambda c: F.transform(F.col("shown"), lambda x: x[c])
    lists = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "ref_path", "block"))).alias("shown"))
    counts = rows.groupBy("query_id").agg(F.count("*").alias("asked"))
    all_of = facts.join(lists, "query_id", "left").join(counts, "query_id", "left")
    none = F.array().cast("array<string>")
    ids, refs, parts = F.coalesce(of("node_id"), none), F.coalesce(of("ref_path"), none), F.coalesce(of("block"), none)
    exhausted = F.coalesce("asked", F.lit(0)) > F.size(ids)
    note = F.when(exhausted, F.lit("\n> *(BUDGET EXHAUSTED)* more evidence was found than max_chars allows\n")).otherwise("")
    references = F.array_join(F.transform(refs, lambda r: F.concat(F.lit("- `"), r, F.lit("`\n"))), "")
    return all_of.select("query_id", F.concat("header", F.array_join(parts, ""), F.lit("## References\n\n"), references, note).alias("markdown"), ids.alias("node_ids"), exhausted.alias("exhausted"))


def header(**facts: Column) -> Column:
    """The bundle's opening: one line per fact."""
    rows = [F.concat(F.lit(f"- {name}: "), value.cast("string"), F.lit("\n")) for name, value in facts.items()]
    return F.concat(F.lit("# Bundle\n\n"), *rows, F.lit("\n## Evidence\n\n"))


def node_markdown(frontmatter: dict[str, Column], text: Column) -> Column:
    """A node file: frontmatter with JSON-quoted values, then its body."""
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v.cast("string"))), r"^\[|\]$", "")
    rows = [F.concat(F.lit(f"{name}: "), quoted(F.coalesce(value.cast("string"), F.lit(""))), F.lit("\n")) for name, value in frontmatter.items()]
    return F.concat(F.lit("---\n"), *rows, F.lit("---\n\n"), text)
