"""Query of operator 2 over the table pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import table
from tidewright.llm.wrappers import extract


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extraction": op2_html_extraction}

ORACLE_SQL: dict[str, str] = {}
