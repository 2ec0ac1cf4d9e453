"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidewright.llm import chat_queries, mixing_queries, page_queries, piece_queries, text_queries, token_queries, vector_queries

MODULES = [vector_queries, page_queries, mixing_queries, chat_queries, token_queries, text_queries, piece_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
