"""The frames that the queries run on, derived from the driver's tables by arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_of(ts: Column) -> Column:
    """Whole seconds since the epoch of a zoneless timestamp, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1_000_000).cast("long")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as two positions, a time, courses and speeds."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", epoch_of(F.col("ts")).alias("t"),
        ((u * 37 % 200) / 100 + 57.5).alias("lat"), ((e * 91 % 200) / 100 + 10.0).alias("lon"),
        ((e * 53 % 200) / 100 + 57.5).alias("lat2"), ((u * 29 % 200) / 100 + 10.0).alias("lon2"),
        ((e + u) * 17 % 200 / 100 + 57.5).alias("lat3"), ((e + u) * 23 % 200 / 100 + 10.0).alias("lon3"),
        ((e * 37 % 720) - 360).cast("double").alias("a"), (u * 53 % 360).cast("double").alias("b"),
        (e * 7 % 300 / 10).alias("tws"), (u * 11 % 50 / 10).alias("hs"), (e * 13 % 11).cast("long").alias("k"),
        ((e * 19 % 41 - 20) / 10).alias("u"), ((u * 31 % 41 - 20) / 10).alias("v"), (e * 97 % 65536).cast("int").alias("flags"),
    )


POSITIONS = """
    SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t,
           (user_id * 37 % 200)::DOUBLE / 100 + 57.5::DOUBLE AS lat, (event_id * 91 % 200)::DOUBLE / 100 + 10::DOUBLE AS lon,
           (event_id * 53 % 200)::DOUBLE / 100 + 57.5::DOUBLE AS lat2, (user_id * 29 % 200)::DOUBLE / 100 + 10::DOUBLE AS lon2,
           ((event_id + user_id) * 17 % 200)::DOUBLE / 100 + 57.5::DOUBLE AS lat3, ((event_id + user_id) * 23 % 200)::DOUBLE / 100 + 10::DOUBLE AS lon3,
           ((event_id * 37 % 720) - 360)::DOUBLE AS a, (user_id * 53 % 360)::DOUBLE AS b,
           (event_id * 7 % 300)::DOUBLE / 10 AS tws, (user_id * 11 % 50)::DOUBLE / 10 AS hs, event_id * 13 % 11 AS k,
           (event_id * 19 % 41 - 20)::DOUBLE / 10 AS u, (user_id * 31 % 41 - 20)::DOUBLE / 10 AS v, CAST(event_id * 97 % 65536 AS INTEGER) AS flags
    FROM events"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ensemble members: thirty to a departure, each with an outcome."""
    return as_members(table(spark, sf_dir, "orders"))


def as_members(orders: DataFrame) -> DataFrame:
    """The same of a table or a stream of orders."""
    o = F.col("o_orderkey")
    fate, draw = o * 17 % 23, o * 13 % 20
    rows = orders.select(
        F.floor(o / 30).alias("departure"), (o % 30).alias("member"), F.floor("o_totalprice").alias("duration_s"), (o % 3 != 0).alias("daylight"),
        (o * 7 % 100 / 100).alias("beat_share"), (o * 11 % 100 / 100).alias("motor_share"), (o * 19 % 400 / 10).alias("fuel_l"),
        F.when(o * 29 % 97 == 0, None).otherwise(o * 31 % 25 / 10).alias("max_hs"), fate.alias("fate"), draw.alias("draw"),
    )
    kind = F.when(F.col("fate") == 0, "error").when(F.col("fate") <= 1 + F.col("departure") % 5, "inconclusive").when(F.col("draw") < F.col("departure") % 8, "infeasible").otherwise("feasible")
    return rows.withColumn("kind", kind).drop("fate", "draw")


MEMBERS = """
    SELECT o_orderkey // 30 AS departure, o_orderkey % 30 AS member, CAST(floor(o_totalprice) AS BIGINT) AS duration_s, o_orderkey % 3 <> 0 AS daylight,
           (o_orderkey * 7 % 100)::DOUBLE / 100 AS beat_share, (o_orderkey * 11 % 100)::DOUBLE / 100 AS motor_share, (o_orderkey * 19 % 400)::DOUBLE / 10 AS fuel_l,
           CASE WHEN o_orderkey * 29 % 97 = 0 THEN NULL ELSE (o_orderkey * 31 % 25)::DOUBLE / 10 END AS max_hs,
           CASE WHEN o_orderkey * 17 % 23 = 0 THEN 'error' WHEN o_orderkey * 17 % 23 <= 1 + (o_orderkey // 30) % 5 THEN 'inconclusive'
                WHEN o_orderkey * 13 % 20 < (o_orderkey // 30) % 8 THEN 'infeasible' ELSE 'feasible' END AS kind
    FROM orders"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a grid of 50 columns and 8 steps in time; every value by its place, some missing."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(p / 50).alias("i"), (p % 50).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"), p.alias("p"), "p_retailprice")
    value = F.when((F.col("p") * 13 + F.col("k") * 7) % 41 == 0, None).otherwise(F.col("p_retailprice") / 100 + F.col("k") * (F.col("p") % 7) / 10)
    return rows.select("i", "j", "k", value.alias("v"))


NODES = """
    SELECT p_partkey // 50 AS i, p_partkey % 50 AS j, k,
           CASE WHEN (p_partkey * 13 + k * 7) % 41 = 0 THEN NULL ELSE p_retailprice / 100 + (k * (p_partkey % 7))::DOUBLE / 10 END AS v
    FROM part, (SELECT unnest(range(0, 8)) AS k)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the steps of routes: an order's lines in a total order, an hour apart."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route"), (F.row_number().over(order) - 1).cast("long").alias("seq"),
        ((F.col("l_partkey") * 37 % 200) / 100 + 57.5).alias("lat"), ((F.col("l_suppkey") * 91 % 200) / 100 + 10.0).alias("lon"),
        (F.floor("l_quantity") % 16).cast("int").alias("flags"), F.when(F.col("l_partkey") % 17 == 0, None).otherwise(F.col("l_suppkey") % 40 / 10).alias("hs"),
        F.floor("l_extendedprice").alias("c1"), F.floor(F.col("l_discount") * 100 + 0.5).alias("c2"), F.floor(F.col("l_tax") * 100 + 0.5).alias("c3"), F.floor("l_quantity").alias("c4"),
    ).withColumn("t_s", F.col("seq") * 3600)


STEPS = """
    SELECT *, seq * 3600 AS t_s FROM (
        SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS seq,
               (l_partkey * 37 % 200)::DOUBLE / 100 + 57.5::DOUBLE AS lat, (l_suppkey * 91 % 200)::DOUBLE / 100 + 10::DOUBLE AS lon,
               CAST(floor(l_quantity) AS BIGINT) % 16 AS flags, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE (l_suppkey % 40)::DOUBLE / 10 END AS hs,
               CAST(floor(l_extendedprice) AS BIGINT) AS c1, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS c2, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS c3,
               CAST(floor(l_quantity) AS BIGINT) AS c4
        FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as rectangles with a reason."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    lat, lon = (s * 47 % 200) / 100 + 57.5, (s * 71 % 200) / 100 + 10.0
    reason = F.element_at(F.array(F.lit("land"), F.lit("tss"), F.lit("uncertain")), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(s.alias("box"), (lat - (n + 1) / 400).alias("south"), (lat + (n + 1) / 400).alias("north"), (lon - (n + 1) / 300).alias("west"), (lon + (n + 1) / 300).alias("east"), reason.alias("reason"))


BOXES = """
    SELECT s_suppkey AS box, (s_suppkey * 47 % 200)::DOUBLE / 100 + 57.5::DOUBLE - (s_nationkey + 1)::DOUBLE / 400 AS south,
           (s_suppkey * 47 % 200)::DOUBLE / 100 + 57.5::DOUBLE + (s_nationkey + 1)::DOUBLE / 400 AS north,
           (s_suppkey * 71 % 200)::DOUBLE / 100 + 10::DOUBLE - (s_nationkey + 1)::DOUBLE / 300 AS west,
           (s_suppkey * 71 % 200)::DOUBLE / 100 + 10::DOUBLE + (s_nationkey + 1)::DOUBLE / 300 AS east,
           ['land', 'tss', 'uncertain'][s_nationkey % 3 + 1] AS reason
    FROM supplier"""
