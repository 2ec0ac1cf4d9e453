"""Sea forecasts of points: one JSON document a point, read by from_json into a series of strictly rising moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of the document.
SCHEMA = (
    "geometry struct<coordinates: array<double>>, properties struct<meta: struct<error: string>, timeseries: array<struct<time: string, data: struct<instant: struct<details: "
    "struct<sea_surface_wave_height: double, sea_surface_wave_from_direction: double>>>>>>"
)


def forecasts(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, source_lat, source_lon, status, times array<struct<epoch_s, hs, from_deg>>) of each document.

    failed: no document, no series or a moment that is none; no-data: the document says so or its series is empty; else ok. Of moments that
    don't rise the later ones are left out; what is no number is NULL. A fold over one document's own series, so nothing is shuffled."""
    rows = bodies.select(key, F.from_json(body, SCHEMA).alias("b"))
    series = c("b.properties.timeseries")

    def entry(x: Column) -> Column:
        details = x["data"]["instant"]["details"]
        return F.struct(F.unix_seconds(x["time"].try_cast("timestamp")).alias("epoch_s"), finite(details["sea_surface_wave_height"]).alias("hs"), finite(details["sea_surface_wave_from_direction"]).alias("from_deg"))

    rows = rows.withColumn("all_", F.transform(series, entry))
    failed = c("all_").isNull() | F.exists("all_", lambda x: x["epoch_s"].isNull())
    status = F.when(F.coalesce(failed, F.lit(True)), "failed").when(c("b.properties.meta.error").isNotNull() | (F.size("all_") == 0), "no-data").otherwise("ok")
    none = F.array().cast("array<struct<epoch_s: bigint, hs: double, from_deg: double>>")

    def rising(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)["epoch_s"]
        return F.when((F.size(kept) == 0) | (x["epoch_s"] > last), F.concat(kept, F.array(x))).otherwise(kept)

    place = c("b.geometry.coordinates")
    rows = rows.select(key, F.get(place, F.lit(1)).alias("source_lat"), F.get(place, F.lit(0)).alias("source_lon"), status.alias("status"), "all_")
    return rows.select(key, "source_lat", "source_lon", "status", F.when(c("status") == "ok", F.aggregate("all_", none, rising)).otherwise(none).alias("times"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


c = F.col
