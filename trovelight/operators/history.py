"""Versioned rows: merging with history, change sets, fingerprints, invariants, vacuum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import first_by

#: What makes a row the same row from build to build.
KEYS = {
    "docs": ["doc_id", "source_version"],
    "nodes": ["node_id", "source_version"],
    "edges": ["edge_type", "from_node_id", "to_node_id", "source_version"],
    "aliases": ["normalized_alias", "target_node_id", "alias_level", "source_version"],
}


def merge_history(current: DataFrame, rebuilt: DataFrame, key: list[str]) -> DataFrame:
    """Rebuilt rows, active, and those of current that they don't replace, inactive."""
    old = current.join(rebuilt.select(*key).distinct(), key, "left_anti").withColumn("is_active", F.lit(False))
    return rebuilt.withColumn("is_active", F.lit(True)).unionByName(old, allowMissingColumns=True)


def change_set(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change): unchanged, metadata_only (other bytes, same canonical text), rebuild, added or removed.

    Both have source_fingerprint and text_fingerprint.
    """
    a = before.select(F.col(key).alias("old"), F.col("source_fingerprint").alias("s0"), F.col("text_fingerprint").alias("t0"))
    b = after.select(F.col(key).alias("new"), F.col("source_fingerprint").alias("s1"), F.col("text_fingerprint").alias("t1"))
    joined = a.join(b, F.col("old") == F.col("new"), "full_outer")
    change = (
        F.when(F.col("new").isNull(), "removed")
        .when(F.col("old").isNull(), "added")
        .when(F.col("s0") == F.col("s1"), "unchanged")
        .when(F.col("t0") == F.col("t1"), "metadata_only")
        .otherwise("rebuild")
    )
    return joined.select(F.coalesce("new", "old").alias(key), change.alias("change"))


def fingerprint_diff(before: DataFrame, after: DataFrame, key: str = "id", value: str = "fingerprint") -> DataFrame:
    """Keys that only one side has, or with another value."""
    a, b = before.select(F.col(key).alias("k0"), F.col(value).alias("v0")), after.select(F.col(key).alias("k1"), F.col(value).alias("v1"))
    return a.join(b, F.col("k0") == F.col("k1"), "full_outer").where(~F.col("v0").eqNullSafe(F.col("v1"))).select(F.coalesce("k0", "k1").alias(key))


def map_diff(before: Column, after: Column) -> Column:
    """Keys of two string maps whose values differ or that only one has, sorted."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def apply_changes(current: DataFrame, rebuilt: DataFrame, changes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """current with the documents of changes that are rebuilt, added or removed replaced by their rows in rebuilt."""
    dirty = changes.where(F.col("change").isin("rebuild", "added", "removed")).select(doc).distinct()
    return current.join(dirty, doc, "left_anti").unionByName(rebuilt.join(dirty, doc, "left_semi"), allowMissingColumns=True)


def footprint(state: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: row work of a rebuild of the dirty documents against that of all (1 + spans + nodes each)."""
    work = F.lit(1) + F.coalesce(F.size("span_fingerprints"), F.lit(0)) + F.coalesce(F.size("node_fingerprints"), F.lit(0))
    joined = state.join(changes, "doc_id", "left")
    return joined.agg(F.sum(F.when(F.col("change") == "unchanged", 0).when(F.col("change").isNull(), 0).otherwise(work)).alias("rewritten"), F.sum(work).alias("full"))


def latest_versions(rows: DataFrame, key: list[str], version: str = "source_version", active: str = "is_active") -> DataFrame:
    """One row per key: active ahead of inactive, then the greatest version."""
    return first_by(rows, key, F.desc(active), F.desc(version))


def point_lookup(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Latest active rows of ids, in the order asked for, each once."""
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "node_id string, asked int")
    found = latest_versions(nodes.where(F.col("is_active") & F.col("node_id").isin(ids)), ["node_id"])
    return found.join(F.broadcast(asked), "node_id").orderBy("asked")


def vacuum(rows: DataFrame, keep_days: int | None = None, now: Column | None = None, time: str = "updated_at") -> DataFrame:
    """Active rows; with keep_days also inactive ones that are no older."""
    if keep_days is None:
        return rows.where("is_active")
    return rows.where(F.col("is_active") | (F.col(time) >= now - F.make_dt_interval(F.lit(keep_days))))


def drop_orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, id): repeated node keys, several active versions of a node, edges to nodes that aren't there."""
    twice = nodes.groupBy("node_id", "source_version").count().where("count > 1").select(F.lit("unique_node").alias("check"), F.col("node_id").alias("id"))
    several = nodes.groupBy("node_id").agg(F.count_if("is_active").alias("n")).where("n > 1").select(F.lit("single_active").alias("check"), F.col("node_id").alias("id"))
    ends = edges.where("is_active").select(F.explode(F.array("from_node_id", "to_node_id")).alias("node_id"))
    lost = ends.join(nodes.where("is_active").select("node_id").distinct(), "node_id", "left_anti").distinct().select(F.lit("edge_end").alias("check"), F.col("node_id").alias("id"))
    return twice.unionByName(several).unionByName(lost)


def node_fingerprints(nodes: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in ("node_id", "kind", "label", "title", "parent_id", "prev_id", "next_id", "ordinal", "node_hash", "is_leaf", "confidence")}
    return nodes.select("doc_id", "source_version", F.col("node_id").alias("id"), T.fingerprint(**fields).alias("fingerprint"))


def build_state(docs: DataFrame, nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document and version with its fingerprints as maps, to be written as JSON."""
    per_node = node_fingerprints(nodes).groupBy("doc_id", "source_version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "fingerprint")))).alias("node_fingerprints"))
    span = spans.select("doc_id", T.short_id(F.col("doc_id").cast("string"), F.col("char_start"), F.col("char_end")).alias("id"), F.sha2(F.concat_ws(":", "char_start", "char_end"), 256).alias("v"))
    per_span = span.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "v")))).alias("span_fingerprints"))
    return docs.join(per_node, ["doc_id", "source_version"], "left").join(per_span, "doc_id", "left")


def group_digests(rows: DataFrame, key: list[str], line: Column) -> DataFrame:
    """key, sha256: a digest of each group's lines, sorted."""
    return rows.select(*key, line.alias("_line")).groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256).alias("sha256"))
