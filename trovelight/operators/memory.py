"""Learning from queries and feedback: folds, decay, suggestions, cache. Times are timestamps and now is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .common import cap_by, first_by


def clamp_step(weight: Column, delta: Column) -> Column:
    """One step of the fold: rises stop at the cap, falls at the floor, and neither moves a weight the other way."""
    return F.when(delta >= 0, F.least(weight + delta, F.lit(K.WEIGHT_CAP))).otherwise(F.greatest(weight + delta, F.lit(K.WEIGHT_FLOOR)))


def _then(a: Column, b: Column) -> Column:
    """Two moves (shift, then clamp to low and high), one after the other, as one move."""
    clamp = lambda x: F.least(F.greatest(x, b["low"]), b["high"])
    return F.struct((a["shift"] + b["shift"]).alias("shift"), clamp(a["low"] + b["shift"]).alias("low"), clamp(a["high"] + b["shift"]).alias("high"))


def fold_moves(items: Column) -> Column:
    """Moves of an array of (place, move as m), in order of place, as one move."""
    far = F.lit(float("inf"))
    none = F.struct(F.lit(0.0).alias("shift"), (-far).alias("low"), far.alias("high"))
    return F.aggregate(F.transform(F.array_sort(items), lambda x: x["m"]), none, _then)


def moved(weight: Column, move: Column) -> Column:
    """A weight after a move."""
    return F.least(F.greatest(weight + move["shift"], move["low"]), move["high"])


def fold_weights(deltas: DataFrame, keys: list[str], order: list[str], delta: str = "delta", time: str = "ts", block: int = 1000) -> DataFrame:
    """keys, weight, pos_count, neg_count, last_used: deltas folded in order, from 0, as clamp_step() moves them.

    Clamping doesn't commute, so order has to be total. A step is a shift and a clamp, and steps in a row are one
    such move. Events are range-partitioned by key and order, so a key's events lie in as many tasks as they need; runs
    of block events in a row are folded where they lie, and then the moves of a key.
    """
    far = F.lit(float("inf"))
    told = deltas.select(*keys, *[c for c in order if c not in keys], F.col(time).alias("t"), F.col(delta).cast("double").alias("d"))
    move = F.struct(F.col("d").alias("shift"), F.when(F.col("d") < 0, F.lit(float(K.WEIGHT_FLOOR))).otherwise(-far).alias("low"), F.when(F.col("d") < 0, far).otherwise(F.lit(float(K.WEIGHT_CAP))).alias("high"))
    spread = told.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.floor(F.monotonically_increasing_id() / block)  # ascends with the ranges, so with a key's order
    rows = spread.select(*keys, F.struct(*order).alias("o"), "t", "d", move.alias("m"), at.alias("at"))
    blocks = rows.groupBy(*keys, "at").agg(fold_moves(F.collect_list(F.struct("o", "m"))).alias("m"), F.sum((F.col("d") > 0).cast("int")).alias("pos"), F.sum((F.col("d") < 0).cast("int")).alias("neg"), F.max("t").alias("t"))
    whole = blocks.groupBy(*keys).agg(fold_moves(F.collect_list(F.struct("at", "m"))).alias("m"), F.sum("pos").alias("pos_count"), F.sum("neg").alias("neg_count"), F.max("t").alias("last_used"))
    return whole.select(*keys, moved(F.lit(0.0), F.col("m")).alias("weight"), "pos_count", "neg_count", "last_used")


def log_deltas(log: DataFrame) -> DataFrame:
    """query_log to implicit feedback: +1 for each node returned."""
    return log.select("query_norm", F.explode("top_node_ids").alias("node_id"), F.lit(1.0).alias("delta"), F.col("timestamp").alias("ts"), F.col("query_id").alias("seq"))


def feedback_deltas(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """node_feedback to deltas, by the query that it answers."""
    step = F.create_map(*[F.lit(x) for pair in K.FEEDBACK_STEP.items() for x in pair])
    return feedback.join(log.select("query_id", "query_norm"), "query_id").select("query_norm", "node_id", F.try_element_at(step, F.col("feedback_type")).alias("delta"), F.col("timestamp").alias("ts"), F.col("feedback_id").alias("seq")).where("delta is not null")


def query_weights(log: DataFrame, feedback: DataFrame) -> DataFrame:
    both = log_deltas(log).unionByName(feedback_deltas(feedback, log))
    return fold_weights(both, ["query_norm", "node_id"], ["ts", "seq"])


def learned_weights(weights: DataFrame, now: Column) -> DataFrame:
    """weights after decay; worn-out ones go."""
    return weights.withColumn("weight", T.decayed("weight", "last_used", now)).where("weight is not null")


def prune_weights(weights: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """weights without those under 0.01 that were last used more than days ago."""
    stale = (F.col("weight") < K.WEIGHT_MIN) & (F.col("last_used") < now - F.make_dt_interval(F.lit(days)))
    return weights.where(~stale)


def recommend_neighbors(queries: DataFrame, log: DataFrame, feedback: DataFrame, recent: int = 20) -> DataFrame:
    """(query_id, neighbors): the setting with the best record (+1 positive, -2 negative, latest rows), else the wording's.

    A tie goes to the setting nearest the wording's. Only records above zero overrule it.
    """
    asked = queries.select("query_id", T.query_key("text").alias("query_norm"), T.neighbor_heuristic("text").alias("wording"))
    rows = feedback.where("feedback_type <> 'neutral'").join(log.where("neighbors >= 0").select(F.col("query_id").alias("log_id"), "query_norm", "neighbors"), F.col("query_id") == F.col("log_id")).select("query_norm", "neighbors", "feedback_type", "timestamp", "feedback_id")
    order = Window.partitionBy("query_norm").orderBy(F.desc("timestamp"), F.desc("feedback_id"))
    late = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= recent)
    score = late.groupBy("query_norm", "neighbors").agg(F.sum(F.when(F.col("feedback_type") == "positive", 1).otherwise(-2)).alias("score"))
    joined = asked.join(score, "query_norm", "left").withColumn("away", F.abs(F.col("neighbors") - F.col("wording")))
    best = first_by(joined, ["query_id"], F.desc_nulls_last("score"), "away", "neighbors")
    return best.select("query_id", F.least(F.greatest(F.when(F.col("score") > 0, F.col("neighbors")).otherwise(F.col("wording")), F.lit(0)), F.lit(2)).alias("neighbors"))


def latest_text(log: DataFrame) -> DataFrame:
    """(query_norm, query_text): how a query was last worded."""
    return log.groupBy("query_norm").agg(F.max_by("query_text", F.struct("timestamp", "query_id")).alias("query_text"))


def suggest_rewrites(hits: DataFrame, weights: DataFrame, log: DataFrame, nodes: int | None = 20, limit: int = 3) -> DataFrame:
    """(query_id, suggestion, rank): other queries that learned one of a query's first nodes, the strongest first.

    hits: query_id, query_norm, node_id, rank. Without nodes all of them count, and rank isn't read.
    """
    first = hits if nodes is None else hits.where(F.col("rank") <= nodes)
    top = first.select("query_id", F.col("query_norm").alias("own"), "node_id").distinct()
    # Who is among a query's first limit is among the first limit + 1 of the node that gives it its weight: ahead of it there are only others of these, and the query itself.
    heads = cap_by(weights.where("weight > 0").select("node_id", "query_norm", "weight"), ["node_id"], limit + 1, F.desc("weight"), F.col("query_norm"))
    found = top.join(heads, "node_id").where("query_norm <> own")
    best = found.groupBy("query_id", "query_norm").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "query_norm")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).join(latest_text(log), "query_norm").select("query_id", F.col("query_text").alias("suggestion"), "rank")


def similar_queries(queries: DataFrame, log: DataFrame, now: Column, days: int = 90, limit: int = 5) -> DataFrame:
    """(query_id, log_id, rank): the newest logged queries of the same key, at most days old."""
    asked = queries.select("query_id", T.query_key("text").alias("query_norm"))
    past = log.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days))).select(F.col("query_id").alias("log_id"), "query_norm", "timestamp")
    order = Window.partitionBy("query_norm").orderBy(F.desc("timestamp"), F.desc("log_id"))
    newest = past.join(asked.select("query_norm").distinct(), "query_norm", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(newest, "query_norm").select("query_id", "log_id", "rank")


def history(log: DataFrame, substring: str = "", limit: int = 20) -> DataFrame:
    """Newest first, 1 to 10000 rows; the substring, ASCII letters in either case, is literal."""
    found = log.where(F.lower("query_text").contains(substring.lower())) if substring else log
    return found.orderBy(F.desc("timestamp"), F.desc("query_id")).limit(min(10000, max(1, limit)))


def stats(log: DataFrame, weights: DataFrame, feedback: DataFrame, now: Column, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row of counts, and the most frequent query keys."""
    counts = log.agg(F.count("*").alias("queries"), F.count_if(F.col("timestamp") >= now - F.make_dt_interval(F.lit(7))).alias("queries_7d"))
    counts = counts.withColumns({"weights": weights.agg(F.count("*").alias("n")).scalar(), "feedback": feedback.agg(F.count("*").alias("n")).scalar()})
    return counts, log.groupBy("query_norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_norm").limit(top)


def cache_put(cache: DataFrame, rows: DataFrame, now: Column, seconds: int = 300, most: int = 50, key: str = "query_norm") -> DataFrame:
    """The cache with rows put in, over entries of the same key, and without what cache_live() lets go."""
    stamped = rows.withColumn("cached_at", now.cast("timestamp")).select(*cache.columns)
    others = cache.join(stamped.select(key).distinct(), key, "left_anti").select(*cache.columns)
    return cache_live(others.unionByName(stamped), now, seconds, most, key)


def cache_live(cache: DataFrame, now: Column, seconds: int = 300, most: int = 50, key: str = "query_norm") -> DataFrame:
    """The newest entry of each key that is at most seconds old, and of these the newest most."""
    alive = first_by(cache.where(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(seconds))), [key], F.desc("cached_at"))
    return alive.orderBy(F.desc("cached_at"), key).limit(most)
