"""The token index: a row per term and node with its frequency and positions, lengths, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .common import broadcast_if_small, materialize


def _terms(nodes: DataFrame, key: str, body: str) -> DataFrame:
    """(node_key, terms). Bodies are dealt out by node ahead of the cutting, so large row groups are no single task's."""
    dealt = nodes.select(F.col(key).alias("node_key"), F.col(body).alias("body")).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node_key")
    return dealt.select("node_key", T.index_terms(T.fts_tokens("body")).alias("terms"))


def _folded(terms: DataFrame) -> DataFrame:
    placed = terms.select("node_key", F.size("terms").cast("long").alias("dl"), F.posexplode("terms").alias("pos", "term"))
    return placed.groupBy("node_key", "dl", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("at")).select("node_key", "term", "tf", "at", "dl")


def postings(nodes: DataFrame, key: str = "node_key", body: str = "body_plain") -> DataFrame:
    """(node_key, term, tf, at, dl): occurrences of a term in a node, their positions, and the node's terms in all.

    A node's rows are one task's, so they are folded there without another shuffle.
    """
    return _folded(_terms(nodes, key, body))


def doc_stats(nodes: DataFrame, key: str = "node_key", body: str = "body_plain") -> DataFrame:
    """(node_key, dl): terms of each node, nodes without any among them."""
    return _terms(nodes, key, body).select("node_key", F.size("terms").cast("long").alias("dl"))


def token_stats(posts: DataFrame) -> DataFrame:
    """(term, df, cf): nodes with a term, and its occurrences."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def batch_index(nodes: DataFrame, key: str = "node_key", body: str = "body_plain") -> tuple[DataFrame, DataFrame]:
    """(postings, doc_stats) for one batch of queries, folded once and not sorted: such a batch reads most of it anyway."""
    terms = materialize(_terms(nodes, key, body), "terms")
    return materialize(_folded(terms), "postings"), terms.select("node_key", F.size("terms").cast("long").alias("dl"))


def build_index(nodes: DataFrame, path: str, partitions: int = 64, key: str = "node_key", body: str = "body_plain") -> None:
    """Write postings, by hash of term and sorted by term, and doc_stats: later queries read only their terms' row groups.

    A frequent term fills several files of its shard, so its postings are no single task's. Bodies are cut into terms
    once; what samples the range and what writes it reads these.
    """
    terms = materialize(_terms(nodes, key, body), "terms")
    posts = _folded(terms).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(partitions)).cast("int"))
    spread = posts.repartitionByRange("shard", "term", "node_key")
    spread.sortWithinPartitions("shard", "term", "node_key").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    terms.select("node_key", F.size("terms").cast("long").alias("dl")).write.mode("overwrite").parquet(f"{path}/doc_stats")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_stats) of an index that build_index() wrote, as search.scores() takes them."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats")


def read_postings(spark: SparkSession, path: str, terms: list[str], partitions: int = 64) -> DataFrame:
    """Postings of terms alone: their shards are pruned to, and the term filter reaches the scan."""
    shards = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(partitions)).cast("int")).distinct().collect()]
    return spark.read.parquet(f"{path}/postings").where(F.col("shard").isin(shards) & F.col("term").isin(terms))


def word_counts(docs: DataFrame, group: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, word, n, docs): occurrences of each word, and how many different documents have it.

    A row counts its words itself. Words of rows whose key no other row has are added up ahead of the shuffle; only
    those of repeated keys are told apart by key. A row without key is in no document.
    """
    repeated = broadcast_if_small(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col(key).alias("_key")))
    once = docs.join(repeated, F.col(key) == F.col("_key"), "left_anti")
    again = docs.join(repeated, F.col(key) == F.col("_key"), "left_semi")
    words = lambda df: df.select(group, key, F.explode(T.counted(T.fts_tokens(text))).alias("c")).select(group, key, F.col("c.token").alias("word"), F.col("c.n").alias("n"))
    whole = words(once).groupBy(group, "word").agg(F.sum("n").alias("n"), F.count(key).alias("docs"))
    parts = words(again).groupBy(group, "word").agg(F.sum("n").alias("n"), F.countDistinct(key).alias("docs"))
    return whole.unionByName(parts).groupBy(group, "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
