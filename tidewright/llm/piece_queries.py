"""Query of operator 4 over the table documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table, unused
from tidewright.llm.sentencepiece_scan import encode

PIECES = "piece_bpe_32k.model"


def encoded(docs: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """The columns of keep, ids, n_tokens, n_chars of the decoded text, and round_trip: whether that is the text again.

    Ids are decoded where they were made, so that they take no further way."""
    said, = unused(docs, "said_")
    back = encode(docs.withColumn(said, F.xxhash64(F.coalesce("text", F.lit("")))), tokenizer, [*keep, said])
    return back.select(
        *keep, "ids", F.size("ids").cast("long").alias("n_tokens"), F.char_length("decoded_").cast("long").alias("n_chars"),
        (F.xxhash64("decoded_") == F.col(said)).alias("round_trip"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids_hash, n_tokens, n_chars, round_trip): a digest of each text's ids, and whether they decode to the text again."""
    rows = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ["doc_id"])
    return rows.withColumn("ids", F.xxhash64("ids")).withColumnRenamed("ids", "ids_hash")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}

ORACLE_SQL: dict[str, str] = {}
