"""Running summaries of ensembles as members finish: a Structured Streaming aggregate in update mode.

The state of a departure is six numbers, whatever the number of members. Each trigger's changed departures are written as a table of
their own; a departure's summary is its row of the last trigger that changed it. A warning, once given, is never taken back, as counts only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.ensemble import certificate, count_of

c = F.col


def running_summaries(members: DataFrame, expected: int) -> DataFrame:
    """(departure, n_f, n_inf, n_inc, n_err, k_daylight, certificate) of a stream of finished members (departure, kind, daylight)."""
    found = members.groupBy("departure").agg(
        count_of("feasible").alias("n_f"), count_of("infeasible").alias("n_inf"), count_of("inconclusive").alias("n_inc"), count_of("error").alias("n_err"),
        F.count_if((c("kind") == "feasible") & c("daylight")).alias("k_daylight"),
    )
    return found.withColumn("certificate", certificate(expected))


def run_to_end(summaries: DataFrame, folder: str) -> DataFrame:
    """All that there is of the stream, trigger by trigger, to tables in the folder; the last row of each departure. folder: a new one that all executors share."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batches/n={number}")

    summaries.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    spark: SparkSession = summaries.sparkSession
    rows = spark.read.parquet(f"{folder}/batches/*")
    last = Window.partitionBy("departure").orderBy(c("batch").desc())
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "batch")
