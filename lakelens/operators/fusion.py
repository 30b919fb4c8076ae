"""Reciprocal rank fusion, reranking of the head, and how much to fetch for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T

DAMPING = 60
MODES = ("auto", "hybrid", "lexical", "semantic")


def fuse(arms: DataFrame, digits: int = 6) -> DataFrame:
    """Ranked lists into one: arms has query_id, arm, rank (from 0), path, start_line, end_line and other columns.

    A chunk is known by path and lines alone; its score is the sum of 1 / (60 + rank) over every time it is listed, its
    other columns are those of its first listing (by arm, then rank). Ties keep the order of first listing.
    """
    rest = [c for c in arms.columns if c not in ("query_id", "path", "start_line", "end_line", "arm", "rank", "score")]
    first = F.min(F.struct("arm", "rank", *rest)).alias("first")
    total = F.sum(F.lit(1.0).cast("double") / (DAMPING + F.col("rank"))).alias("score")
    fused = arms.groupBy("query_id", "path", "start_line", "end_line").agg(total, first)
    flat = fused.select("query_id", "path", "start_line", "end_line", F.round("score", digits).alias("score"), "first.arm", F.col("first.rank").alias("arm_rank"), *(f"first.{c}" for c in rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "arm", "arm_rank", "path", "start_line")
    return flat.withColumn("rank", F.row_number().over(order) - 1)


def rerank_head(ranked: DataFrame, relevance: Column, top_k: int) -> DataFrame:
    """The first ``top_k`` of each query by ``relevance`` (ties in old order) with it as score; the tail keeps order and score.

    A query with fewer than two results is left as it is.
    """
    many = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1
    head = (F.col("rank") < top_k) & many
    scored = ranked.withColumn("_head", head).withColumn("_old", F.col("rank")).withColumn("score", F.when(F.col("_head"), relevance).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("_head"), F.when(F.col("_head"), -F.col("score")).asc_nulls_last(), "_old")
    return scored.withColumn("rank", F.row_number().over(order) - 1).drop("_head", "_old")


def term_overlap(query: Column, text: Column) -> Column:
    """A simple relevance: the number of the query's distinct tokens that the text holds."""
    return F.size(F.array_intersect(T.tokens(query), T.tokens(text))).cast("double")


def clamp(n: Column, cap: int) -> Column:
    """Results asked for, between 1 and the cap."""
    return F.greatest(F.lit(1), F.least(n, F.lit(cap)))


def arm_size(n: Column, mode: Column, rerank_top_k: Column | None = None) -> Column:
    """Candidates each arm fetches: n, or three times as many (ten at least) for hybrid; what a reranker reads at least."""
    size = F.when(mode == "hybrid", F.greatest(n * 3, F.lit(10))).otherwise(n)
    return size if rerank_top_k is None else F.greatest(size, F.coalesce(rerank_top_k, F.lit(0)))
