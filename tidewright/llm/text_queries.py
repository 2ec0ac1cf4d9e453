"""Queries of operators 9, 10 and 13 over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import table
from tidewright.llm.jaccard_join import JaccardJoin
from tidewright.llm.language_id import language_id
from tidewright.llm.quality import quality


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(table(spark, sf_dir, "documents")).groups()


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_quality": op13_quality, "op10_language_id": op10_language_id, "op9_jaccard_join": op9_jaccard_join}

ORACLE_SQL = {
    "op9_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        shingled AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
            FROM words),
        exploded AS (SELECT doc_id, unnest(s) AS shingle FROM shingled),
        sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM exploded a JOIN exploded b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r)
        SELECT sizes.doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(r) AS component_id
        FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY sizes.doc_id
    """,
}
