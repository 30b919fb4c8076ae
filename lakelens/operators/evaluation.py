"""Retrieval quality: found@k, precision@1 and NDCG@k with graded relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T


def unique_paths(results: DataFrame) -> DataFrame:
    """Files in rank order: query_id, path, rank (from 0); of several chunks of a file the best counts."""
    best = results.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path")) - 1).drop("first")


def relevance(items: DataFrame) -> DataFrame:
    """(query_id, key, gain): the relevance map, or the expected path with gain 1 where there is none."""
    graded = items.select("query_id", "expect", F.when(F.size(F.coalesce("relevant", F.create_map().cast("map<string,double>"))) > 0, F.col("relevant")).alias("m"))
    pairs = F.coalesce("m", F.map_from_arrays(F.array("expect"), F.array(F.lit(1.0))))
    return graded.where(F.col("m").isNotNull() | F.col("expect").isNotNull()).select("query_id", F.explode(pairs).alias("key", "gain"))


def ndcg(paths: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of every judged query; a key matches a path at a path boundary, and a path takes its best gain."""
    head = paths.where(F.col("rank") < k)
    gains = head.join(judged, "query_id").where(T.at_path_boundary(F.col("path"), F.col("key"))).groupBy("query_id", "path", "rank").agg(F.max("gain").alias("gain"))
    dcg = gains.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 2)).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    ideal = judged.withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 2)).alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(dcg, "query_id", "left").select("query_id", value.alias("ndcg"))


def found_at(paths: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, found, first): whether the expected string is part of one of the first k paths, and of the very first."""
    hits = paths.where(F.col("rank") < k).join(items.select("query_id", "expect"), "query_id").where(F.contains("path", "expect"))
    best = hits.groupBy("query_id").agg(F.min("rank").alias("r"))
    return items.select("query_id").join(best, "query_id", "left").select("query_id", F.col("r").isNotNull().cast("int").alias("found"), F.coalesce((F.col("r") == 0).cast("int"), F.lit(0)).alias("first"))


def summary(paths: DataFrame, items: DataFrame, k: int = 5, ndcg_k: int = 10) -> DataFrame:
    """One row: number of queries, found@k, precision@1 and mean NDCG; queries without results count as zero."""
    per = found_at(paths, items, k).join(ndcg(paths, relevance(items), ndcg_k), "query_id", "left")
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("found").alias("found_at_k"), F.avg("first").alias("precision_at_1"), F.avg(F.coalesce("ndcg", F.lit(0.0))).alias("ndcg"))
