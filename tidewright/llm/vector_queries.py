"""Queries of operators 1, 7 and 12 over the table embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table
from tidewright.llm.hard_negatives import labelled_rows, mine
from tidewright.llm.hnsw import nearest_neighbours, usable_rows
from tidewright.llm.topk import exact_topk, one_row_per_id, sparse_rows


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_row_per_id(sparse_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0))
    return exact_topk(rows.where(F.col("id") % 20 == 0), rows, 20)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest_neighbours(rows.where(F.col("id") % 100 == 0), rows, 10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled_rows(vectors.withColumn("label", label), "vec_id", "embedding", "label", 256.0)
    return mine(rows, rows.where(F.col("id") % 100 == 0), 5, 10, 30, 90)


QUERIES = {"op12_hard_negatives": op12_hard_negatives, "op1_exact_topk": op1_exact_topk, "op7_nearest_neighbours": op7_nearest_neighbours}

ORACLE_SQL = {
    "op1_exact_topk": """
        WITH usable AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM usable),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        ints AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
        scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM ints a JOIN ints c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r, vec_id AS negative_id, positive_score, score AS negative_score
            FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 10
    """,
}
