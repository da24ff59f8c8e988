"""Rebuild of what a change reaches: which documents a new state of the sources makes dirty, and only their parts written.

A corpus in a SnapshotStore has tables in parts by document (bucket, a hash of doc_id): docs (the sources' rows with both
fingerprints), nodes and edges. A rebuild compares fingerprints, extracts and cuts changed documents alone, follows what
depends on them to a fixed point, and writes the parts of documents reached; all other parts stay as they lie.
A corpus of another toolchain, or in other buckets, is built anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..sources.writers import SnapshotStore
from . import corpus, graph
from .common import broadcast_if_small, materialize, release
from .history import change_set, violations

TABLES = ("docs", "nodes", "edges")
#: What a document's new text leads to.
DIRTY = ("rebuild", "added", "removed", "dependent")

Extract = Callable[[DataFrame], DataFrame]
#: Ids of changed documents that are broadcast at most, so that texts and nodes stay where they are read; more are joined by shuffles.
MOST_IDS = 1_000_000


def toolchain_checksum(config: dict) -> str:
    """Digest of what makes a build's result besides its sources: the parameters, but for when they were written, and this package's code."""
    given = {k: v for k, v in config.items() if k != "generated_at"}
    seen = hashlib.sha256(json.dumps(given, ensure_ascii=False, sort_keys=True).encode())
    root = Path(__file__).parents[1]
    for part in ("functions", "operators"):
        for file in sorted((root / part).glob("*.py")):
            seen.update(f"\n{part}/{file.name}\n".encode() + hashlib.sha256(file.read_bytes()).digest())
    return seen.hexdigest()


def bucket_of(doc_id: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int").alias("bucket")


def text_fingerprint() -> Column:
    """Digest of all of a document (title, source_file, text) that its nodes are made of."""
    return F.sha2(F.to_json(F.struct("title", "source_file", "text"), {"ignoreNullFields": "false"}), 256)


def reached(dirty: DataFrame, depends: DataFrame) -> DataFrame:
    """(doc_id): dirty and all documents that depend on one of them, directly or through others. depends: doc_id, on_doc_id.

    Rounds of joins of what the last one found, as many as the longest chain; cycles end, since nobody is found twice.
    """
    found = front = materialize(dirty.select("doc_id").distinct(), "reached")
    while True:
        more = depends.join(front.withColumnRenamed("doc_id", "on_doc_id"), "on_doc_id", "left_semi").select("doc_id").distinct()
        new = materialize(more.join(found, "doc_id", "left_anti"), "reached")
        if not new.limit(1).count():
            release(new)
            return found
        whole = materialize(found.unionByName(new), "reached")
        release(found, front)
        found, front = whole, new


@dataclass
class Rebuilt:
    """kind (full or part), the version written (None: nothing has changed), (doc_id, change) of all documents, and the parts written of each table."""

    kind: str
    version: str | None
    changes: DataFrame
    parts: dict[str, list[int]]


def document_edges(nodes: DataFrame) -> DataFrame:
    """Edges that follow from a document's own nodes."""
    return graph.structure_edges(nodes).unionByName(graph.reference_edges(nodes))


def _whole(tables: dict[str, DataFrame]) -> None:
    broken = violations(tables["nodes"], tables["edges"]).limit(5).collect()
    if broken:
        raise IntegrityError("not consistent: " + ", ".join(f"{r['check']} {r.id}" for r in broken))


def rebuild(store: SnapshotStore, sources: DataFrame, extract: Extract, config: dict | None = None, depends: DataFrame | None = None, buckets: int = 256, cut: Extract = corpus.build_nodes, unheld: tuple[str, ...] = ()) -> Rebuilt:
    """Bring the corpus in store up to sources (doc_id, source_fingerprint, whatever else), one row per document.

    Columns of sources in unheld (a text, say) are for extract alone; docs hasn't got them.
    extract makes (doc_id, title, source_file, text) of rows of sources, and is asked for changed documents only; cut makes nodes of
    these. A document whose text stays is metadata_only: its row in docs is new, its nodes are not. Documents that
    depend on dirty ones (depends: doc_id, on_doc_id) are built again though their sources have not changed. Nodes or edges that break an
    invariant are refused before anything is switched, and so is a rebuild whose base another writer has replaced meanwhile (BuildError): call it again.
    """
    spark = store.spark
    base = store.current()
    mark = toolchain_checksum((config or {}) | {"buckets": buckets})
    sources = sources.withColumn("doc_id", F.col("doc_id").cast("string"))
    held = {r.key: r.value for r in store.read("build").collect()} if base and store.has("build") else {}
    part = held.get("toolchain") == mark
    with_text = sources.drop(*unheld).withColumn("text_fingerprint", F.lit(""))
    old = store.read_parts("docs", with_text.schema) if part else with_text.limit(0)
    was = old.select("doc_id", F.col("source_fingerprint").alias("s0"), F.col("text_fingerprint").alias("t0"))
    told = materialize(sources.select("doc_id", F.col("source_fingerprint").alias("s1")).join(was, "doc_id", "full_outer"), "compared")
    other = told.where(~F.col("s0").eqNullSafe(F.col("s1")))
    few = lambda ids: broadcast_if_small(ids.select("doc_id"), MOST_IDS)
    # A full build asks for all documents that have a fingerprint.
    asked = sources.join(few(other.where("s1 is not null")), "doc_id", "left_semi") if part else sources.where("doc_id is not null and source_fingerprint is not null")
    read = materialize(extract(asked).select(F.col("doc_id").cast("string").alias("doc_id"), "title", "source_file", "text"), "extracted", compression="zstd")
    t1 = read.select("doc_id", text_fingerprint().alias("t1"))
    sides = other.join(t1, "doc_id", "left")
    before = sides.where("s0 is not null").select("doc_id", F.col("s0").alias("source_fingerprint"), F.col("t0").alias("text_fingerprint"))
    after = sides.where("s1 is not null").select("doc_id", F.col("s1").alias("source_fingerprint"), F.col("t1").alias("text_fingerprint"))
    changed = materialize(change_set(before, after), "changed")
    dirty = changed.where(F.col("change").isin(*DIRTY))
    also = read.limit(0)
    if depends is not None and part:
        on = depends.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("on_doc_id").cast("string").alias("on_doc_id"))
        more = reached(dirty, on).join(dirty.select("doc_id"), "doc_id", "left_anti").join(sources.select("doc_id"), "doc_id", "left_semi")
        kinds = changed.join(more.withColumn("more", F.lit(True)), "doc_id", "full_outer")
        changed = materialize(kinds.select("doc_id", F.when(F.col("more"), "dependent").otherwise(F.col("change")).alias("change")), "changed")
        dirty = changed.where(F.col("change").isin(*DIRTY))
        unread = dirty.where("change = 'dependent'").select("doc_id").join(read.select("doc_id"), "doc_id", "left_anti")
        also = extract(sources.join(unread, "doc_id", "left_semi")).select(F.col("doc_id").cast("string").alias("doc_id"), "title", "source_file", "text")
    changes = told.select("doc_id").join(changed, "doc_id", "left").select("doc_id", F.coalesce("change", F.lit("unchanged")).alias("change"))

    # At most `buckets` numbers each come to the driver.
    numbers = lambda df: sorted(r.bucket for r in df.select(bucket_of("doc_id", buckets)).distinct().collect())
    parts = {"docs": numbers(changed), "nodes": numbers(dirty)}
    parts["edges"] = parts["nodes"]
    if part and not parts["docs"]:
        return Rebuilt("part", None, changes, parts)

    gone = {"docs": few(sides), "nodes": few(dirty)} if part else {}
    gone["edges"] = gone.get("nodes")
    texts = read.join(gone["nodes"], "doc_id", "left_semi").unionByName(also) if part else read
    docs = sources.drop(*unheld).join(sides.where("s1 is not null").select("doc_id", F.col("t1").alias("text_fingerprint")), "doc_id").select(*with_text.columns)

    def edges(written: Callable[[str], DataFrame]) -> DataFrame:
        made = written("nodes")
        return placed("edges", document_edges(made.join(gone["nodes"], "doc_id", "left_semi") if part else made))

    # Documents of the parts to be written that stay as they are: nodes and edges of those that aren't dirty, rows of those whose sources haven't changed.
    # They lie in their buckets already; only if these have got many small files are they dealt out again.
    lying: dict[str, DataFrame] = {}

    def placed(name: str, fresh: DataFrame) -> DataFrame:
        fresh = fresh.withColumn("bucket", bucket_of("doc_id", buckets))
        if not part:
            return fresh
        stay = store.read_parts(name, fresh.drop("bucket").schema, parts[name]).join(gone[name], "doc_id", "left_anti").withColumn("bucket", bucket_of("doc_id", buckets))
        if store.scattered(name, parts[name]):
            return fresh.unionByName(stay)
        lying[name] = stay
        return fresh

    tables = {"docs": placed("docs", docs), "nodes": placed("nodes", cut(texts)), "edges": edges}
    build = spark.createDataFrame([("toolchain", mark), ("buckets", str(buckets))], "key string, value string")
    version = store.publish_parts(tables, parts if part else None, whole={"build": build}, base=base, check=lambda read_new: _whole({name: read_new(name) for name in ("nodes", "edges")}), lying=lying)
    release(read)
    return Rebuilt("part" if part else "full", version, changes, parts)


def stored(store: SnapshotStore, name: str, like: DataFrame) -> DataFrame:
    """A table of the corpus (docs, nodes or edges), with the columns of like."""
    return store.read_parts(name, like.schema)
