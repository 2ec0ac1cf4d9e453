"""Queries of operators 3, 8 and 11 over the table documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import scratch_path, table
from tidewright.llm.token_alignment import align
from tidewright.llm.token_counts import token_counts
from tidewright.llm.token_files import file_count, read_files, write_files

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
LIMIT = 1024
END_ID = 2


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), LIMIT)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch_path(spark, "token-files")
    manifest = write_files(docs, folder, public_tokenizers.path(BYTE_BPE), END_ID, file_count(spark, size))
    return read_files(manifest, folder)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return align(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES), file_count(spark, size))


QUERIES = {"op11_token_alignment": op11_token_alignment, "op3_token_counts": op3_token_counts, "op8_token_files": op8_token_files}

ORACLE_SQL: dict[str, str] = {}
