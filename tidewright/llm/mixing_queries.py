"""Query of operator 5 over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table
from tidewright.llm.mixing import select_documents

#: Target weights by level; names that are not given weigh 1.
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 2.0}, "language": {"en": 5.0, "de": 2.0, "fr": 2.0}, "source": {"src0": 2.0}}
SHARE, EPOCHS, SEED = 0.6, 2, 7


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = select_documents(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, EPOCHS, SEED)
    return taken.select("doc_id", F.col("domain_").alias("domain"), "lang", "source", F.col("times_").cast("long").alias("times"))


QUERIES = {"op5_source_mixing": op5_source_mixing}


def _level(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[name].items()) + " ELSE 1.0 END"


def _divide(level: str, parent: list[str], above: str) -> str:
    """The siblings of a level in order of room / weight; the first that doesn't fill sets the level of all behind it."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, level])
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    return f"""
        {level}_nodes AS (SELECT {keys}, sum(room) AS room, CAST({_level(level)} AS DOUBLE) AS weight FROM sized GROUP BY {keys} HAVING sum(room) > 0),
        {level}_order AS (
            SELECT {keys}, room, weight, parent_budget, row_number() OVER w AS place,
                   (parent_budget - sum(room) OVER w + room) / (sum(weight) OVER ({by}) - sum(weight) OVER w + weight) AS level
            FROM {level}_nodes {join}
            WINDOW w AS ({by} ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        {level}_level AS (SELECT {", ".join(parent + ["1 AS one"])}, min_by(level, place) AS shared FROM {level}_order WHERE room / weight > level GROUP BY ALL),
        {level}_budget AS (
            SELECT {", ".join(f"o.{k}" for k in [*parent, level])}, CASE WHEN room / weight <= level THEN room ELSE greatest(0, weight * shared) END AS parent_budget
            FROM {level}_order o LEFT JOIN {level}_level l ON {" AND ".join([f"o.{k} = l.{k}" for k in parent] + ["l.one = 1"])})"""


ORACLE_SQL = {
    "op5_source_mixing": f"""
        WITH placed AS (
            SELECT doc_id, lang, source AS src, coalesce(lang, '') AS language, coalesce(source, '') AS source,
                   CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN ''
                        ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) // 5 AS VARCHAR) END AS domain,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
            FROM documents),
        leaves AS (SELECT domain, language, source, sum(tokens) AS tokens FROM placed GROUP BY ALL),
        sized AS (SELECT *, CAST(tokens AS DOUBLE) * {EPOCHS} AS room FROM leaves),
        root AS (SELECT CAST(floor(sum(tokens) * {SHARE}) AS DOUBLE) AS parent_budget FROM leaves),
        {_divide("domain", [], "root")},
        {_divide("language", ["domain"], "domain_budget")},
        {_divide("source", ["domain", "language"], "language_budget")},
        budgets AS (
            SELECT domain, language, source, tokens AS held, CAST(floor(parent_budget + 1e-6) AS BIGINT) AS budget
            FROM leaves JOIN source_budget USING (domain, language, source) WHERE tokens > 0),
        keyed AS (
            SELECT p.*, budget // held AS whole, budget % held AS rest,
                   md5('{SEED}:' || CAST(budget // held AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
            FROM placed p JOIN budgets USING (domain, language, source)),
        summed AS (
            SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
            FROM keyed)
        SELECT doc_id, domain, lang, src AS source, CAST(whole + CASE WHEN until <= rest THEN 1 ELSE 0 END AS BIGINT) AS times
        FROM summed WHERE whole + CASE WHEN until <= rest THEN 1 ELSE 0 END > 0
    """,
}
