"""A training-data pipeline of four stages over the table documents; counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next one's docs. All but
the last return the columns of documents. Rows without an id are never taken for copies; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import cut, table, unused
from tidewright.llm.jaccard_join import BROADCAST_IDS, JaccardJoin
from tidewright.llm.language_id import ADDED, annotate, fitted
from tidewright.llm.mixing import select_documents
from tidewright.llm.mixing_queries import SEED, WEIGHTS
from tidewright.llm.piece_queries import PIECES, encoded

#: A text of MIN_CHARS or more that costs more bits a letter than this in every language is in none of them; a uniform draw of letters costs less.
MAX_BITS, MIN_CHARS = 7.0, 50
#: Share of all tokens that the mixture takes.
SHARE = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and longer ones that resemble no learned language, go."""
    lang, _, bits = (F.col(c) for c in unused(docs, *ADDED))
    unlike = (bits > MAX_BITS) & (F.char_length("text") >= MIN_CHARS)
    return annotate(docs, fitted(docs)).where((lang != "und") & ~unlike).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links connect, the one of smallest id stays, and of several of that id one; of rows that repeat id and text, one."""
    pick, = unused(docs, "pick_")
    groups = cut(JaccardJoin(docs).rows().select("doc_id", F.col("pick").alias(pick), "component_id", "comp"), "groups")
    first = groups.where("doc_id = component_id")
    shared = first.where("comp is not null").groupBy("comp").agg(F.min(pick).alias("lead"), F.max(pick).alias("last")).where("lead != last")
    also = first.join(shared, "comp").where(F.col(pick) != F.col("lead"))
    row = ["doc_id", pick]
    gone = groups.where("doc_id != component_id").select(row).unionByName(also.select(row)).distinct()
    few = gone.count() <= BROADCAST_IDS // 2
    named = docs.withColumn(pick, F.xxhash64("doc_id", "text"))
    kept = named.join(F.broadcast(gone) if few else gone, row, "left_anti")
    repeated = first.groupBy(row).agg(F.count("*").alias("times")).where("times > 1").select(row)
    if (n := repeated.count()) == 0:
        return kept.select(*docs.columns)
    repeated = F.broadcast(repeated) if n <= BROADCAST_IDS // 2 else repeated
    once = kept.join(repeated, row, "left_semi").dropDuplicates(row)
    return kept.join(repeated, row, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights of their domains, languages and sources, each once."""
    return select_documents(docs, WEIGHTS, SHARE, 1, SEED).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, n_chars, round_trip) of each document."""
    return encoded(docs, public_tokenizers.path(PIECES), ["doc_id", "lang", "source"])


STAGES = [("language_id", identify_language), ("jaccard_join", join_near_copies), ("source_mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: Language identification, the suffix automata and SentencePiece can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
