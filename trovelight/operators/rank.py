"""Fusing and re-ordering ranked lists. Positions count from 0 in fusion and are carried explicitly everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import constants as K
from ..functions import text as T

ROUTES = ("structural", "title", "alias", "alias_abbreviation", "body", "alias_soft", "edge_expanded")


def rrf(lists: DataFrame, k: int = K.RRF_K, top: int = 30) -> DataFrame:
    """lists (query_id, list_id, pos, item) to (query_id, item, score, rank): the sum of 1 / (k + pos + 1).

    An item twice in a list counts twice; ties keep the order of first appearance.
    """
    scored = lists.groupBy("query_id", "item").agg(F.sum(1.0 / (k + F.col("pos") + 1)).alias("score"), F.min(F.struct("list_id", "pos")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "item", "score", "rank")


def merge_dedupe(primary: DataFrame, secondary: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """Rows of two lists (keys, pos), the primary's first, each key once; limit 0 keeps all."""
    both = primary.select(*keys, "pos", F.lit(0).alias("prio")).unionByName(secondary.select(*keys, "pos", F.lit(1).alias("prio")))
    first = both.groupBy(*keys).agg(F.min(F.struct("prio", "pos")).alias("place"))
    if limit:
        first = first.orderBy("place", *keys).limit(limit)
    return first.select(*keys, "place.prio", "place.pos")


def merge_routes(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, route, pos, item) to (query_id, item, rank): routes in fixed precedence, then position."""
    route = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route"))
    best = candidates.where(route > 0).groupBy("query_id", "item").agg(F.min(F.struct(route.alias("route"), "pos")).alias("place"))
    return best.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "item")).alias("rank"))


def proximity_bucket(window) -> F.Column:  # noqa: ANN001
    """The bonus of the smallest window: 2 up to 50 characters, 1 up to 200, a half up to 500."""
    return F.when(window <= 50, 2.0).when(window <= 200, 1.0).when(window <= 500, 0.5).otherwise(0.0)


def proximity_rerank(hits: DataFrame, most: int = 50) -> DataFrame:
    """hits (query_id, text, node_id, body_plain, rank) in order of proximity group (2, some, none), then rank.

    Queries of fewer than two tokens, and hits behind the first most, get no bonus.
    """
    tokens = T.fts_tokens("text")
    measured = hits.withColumn("_tokens", tokens).withColumn("_window", A.min_window("body_plain", "_tokens"))
    counts = (F.size("_tokens") >= 2) & (F.col("rank") <= most)
    scored = measured.withColumn("bonus", F.when(counts, proximity_bucket(F.col("_window"))).otherwise(0.0)).drop("_tokens", "_window")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("bonus") >= 2, 0).when(F.col("bonus") >= 0.5, 1).otherwise(2), "rank")
    return scored.withColumn("rank", F.row_number().over(order))


def learned_boost(hits: DataFrame, weights: DataFrame, top: int = 5) -> DataFrame:
    """hits (query_id, node_id, rank) with the top learned nodes in front, by weight and then rank.

    weights: query_id, node_id, weight, decayed already.
    """
    joined = hits.join(weights.select("query_id", "node_id", "weight"), ["query_id", "node_id"], "left")
    by_weight = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("weight"), "rank")
    n = F.when(F.col("weight").isNotNull(), F.row_number().over(by_weight))
    front = joined.withColumn("_n", n).withColumn("_front", F.when(F.col("_n") <= top, F.col("_n")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_front"), "rank")
    return front.withColumn("boosted", F.row_number().over(order)).drop("_n", "_front")


def double_hits_first(rendered: DataFrame, grepped: DataFrame) -> DataFrame:
    """rendered (query_id, ref_path, pos): nodes whose file the line search also found come first."""
    found = grepped.select("query_id", F.col("file").alias("ref_path"), F.lit(1).alias("hit")).distinct()
    joined = rendered.join(found, ["query_id", "ref_path"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return joined.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hit"), "pos")))
