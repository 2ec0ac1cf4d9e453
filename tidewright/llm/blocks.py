"""Pairs a stated query set with all candidate rows block by block: bounded groups on both sides, spread evenly by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_of(n_rows: int, rows_per_block: int) -> int:
    return max(1, -(-n_rows // rows_per_block))


def shard_of(key: str, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n_shards)).cast("int")


def pair_blocks(queries: DataFrame, candidates: DataFrame, key: str, n_shards: int, n_groups: int, search, schema: str) -> DataFrame:
    """Run search(candidate rows, query rows) for each pair of candidate shard and query group. Candidates that bring a column shard_ are dealt already.

    Candidates are sent once per query group and queries once per shard. Neither a shard nor a group grows with the input: only
    their number does."""
    left = candidates if "shard_" in candidates.columns else candidates.withColumn("shard_", shard_of(key, n_shards))
    left = left.withColumn("group_", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = queries.withColumn("group_", F.pmod(F.xxhash64(F.lit(2), key), F.lit(n_groups)).cast("int")).withColumn("shard_", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    n = n_shards * n_groups
    left, right = (x.repartition(n, "shard_", "group_") for x in (left, right))
    return left.groupBy("shard_", "group_").cogroup(right.groupBy("shard_", "group_")).applyInPandas(search, schema)


def best_per_query(found: DataFrame, k: int, *best: Column) -> DataFrame:
    """Merge the shards' results: the k best of each query, ties to the smaller vec_id. Spark ranks within each task before the shuffle."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best, F.col("vec_id").asc())))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
