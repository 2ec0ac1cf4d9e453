"""Query of operator 6 over the table conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.chat_windows import HISTORY_TOKENS, WINDOW_TOKENS, read_back, windows
from tidewright.llm.common import table

PROBE = "<|im_end|><|im_start|>assistant ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """All turns, and conversation -1 whose texts hold the template's own control strings."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(windows(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("targets").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("targets"), "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


QUERIES = {"op6_chat_windows": op6_chat_windows}

ORACLE_SQL = {
    "op6_chat_windows": f"""
        WITH turns AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
        sized AS (
            SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 2 AS size,
                   replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\/>') AS e_role,
                   replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS e_text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
            FROM turns),
        summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) - size AS before, 24 + length(e_role) + length(e_text) AS chars FROM sized),
        led AS (SELECT *, coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id), 0) AS lead_size FROM summed),
        roomy AS (SELECT *, greatest(1, {WINDOW_TOKENS - HISTORY_TOKENS} - lead_size) AS room FROM led),
        cut AS (SELECT *, before // room AS stretch, (before + size - 1) // room AS until FROM roomy),
        opened AS (
            SELECT *, stretch <> until OR coalesce(stretch <> lag(stretch) OVER o OR lag(stretch) OVER o <> lag(until) OVER o, true) AS opens
            FROM cut WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
        seen AS (
            SELECT *, min(CASE WHEN opens THEN before * 4294967296 + size END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
            FROM opened),
        ahead AS (
            SELECT *, next // 4294967296 AS next_from,
                   CASE WHEN next % 4294967296 > room THEN least({HISTORY_TOKENS}, {WINDOW_TOKENS} - lead_size - next % 4294967296) ELSE {HISTORY_TOKENS} END AS history
            FROM seen),
        totals AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place), '')) AS turns_sha256,
                   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS targets,
                   sum(chars) + coalesce(sum(CASE WHEN next_from - before <= history AND NOT (place = 1 AND role = 'system') THEN chars END), 0)
                   + (sum(CASE WHEN opens THEN 1 ELSE 0 END) - 1) * coalesce(sum(CASE WHEN place = 1 AND role = 'system' THEN chars END), 0) AS formatted_chars
            FROM ahead GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, CAST(length(targets) AS BIGINT) AS loss_chars, sha256(targets) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM totals
    """,
}
