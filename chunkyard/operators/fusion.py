"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A result of zero-based rank r scores 1 / (RRF + r).
RRF = 2
#: Each list is fetched so many times deeper than the result.
PREFETCH = 3
RERANK_WIDENING = 4


def rrf_term(rank: Column, constant: int = RRF) -> Column:
    """``rank`` counts from one; no rank, no score."""
    return F.coalesce(1 / (constant + rank - 1), F.lit(0.0))


def fuse(sparse: DataFrame, dense: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", constant: int = RRF, fallback: bool = True) -> DataFrame:
    """The k best of each query from two ranked lists (query, key, score, rank).

    A query without any sparse result keeps its dense scores when ``fallback`` is set, as a single
    search without a known token is a dense one.
    """
    s = sparse.select(query, key, F.col("rank").alias("sparse_rank"))
    d = dense.select(query, key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    both = s.join(d, [query, key], "full_outer")
    fused = F.round(rrf_term(F.col("sparse_rank"), constant) + rrf_term(F.col("dense_rank"), constant), 6)
    if fallback:
        known = F.max(F.col("sparse_rank").isNotNull()).over(Window.partitionBy(query))
        both = both.withColumn("score", F.when(known, fused).otherwise(F.col("dense_score")))
    else:
        both = both.withColumn("score", fused)
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return both.select(query, key, "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
