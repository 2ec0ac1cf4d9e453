"""A sailed route's steps against weather, boat and chart: one row a step, the first rejection of a route by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: The kinds that no other departure time mends.
HARD = ["boatLimits", "point", "clearance", "segment", "tss"]


def first_rejections(steps: DataFrame, rules: list[tuple[str, Column]], route: str = "route", seq: str = "seq") -> DataFrame:
    """(route, steps, kind, at, t_s, hard): of each route how many steps were sailed, and the first rule in order that rejects its first rejected step."""
    kind = F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])
    rows = steps.withColumn("kind_", kind)
    bad = F.min(F.when(c("kind_").isNotNull(), F.struct(c(seq).alias("at"), c("kind_").alias("kind"), c("t_s").alias("t_s"))))
    found = rows.groupBy(route).agg(F.count("*").alias("all_"), bad.alias("bad"), F.max("t_s").alias("end_s"))
    return found.select(route, F.coalesce(c("bad.at"), c("all_")).alias("steps"), c("bad.kind").alias("kind"), F.coalesce(c("bad.t_s"), c("end_s")).alias("t_s"), F.coalesce(c("bad.kind").isin(HARD), F.lit(False)).alias("hard"))


def position_at(steps: DataFrame, asked: DataFrame, route: str = "route") -> DataFrame:
    """(route, at_s, lat, lon) on the straight line between the steps around each asked moment (route, at_s), the ends beyond them."""
    order = Window.partitionBy(route).orderBy("t_s", "seq")
    ends = steps.withColumns({"t2": F.lead("t_s").over(order), "lat2": F.lead("lat").over(order), "lon2": F.lead("lon").over(order), "first": F.row_number().over(order) == 1})
    met = asked.join(ends, route).where(((c("at_s") >= c("t_s")) | c("first")) & ((c("at_s") < c("t2")) | c("t2").isNull()))
    share = F.when(c("t2").isNull() | (c("at_s") <= c("t_s")), 0.0).otherwise((c("at_s") - c("t_s")) / (c("t2") - c("t_s")))
    return met.select(route, "at_s", (c("lat") + share * (F.coalesce("lat2", "lat") - c("lat"))).alias("lat"), (c("lon") + share * (F.coalesce("lon2", "lon") - c("lon"))).alias("lon"))
