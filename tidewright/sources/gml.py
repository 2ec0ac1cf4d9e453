"""Features of GML documents: any number of files, one row a feature, by Spark's XML reader and column expressions.

Positions are "lat lon" pairs; rings and lines come back as arrays of (x, y), x the longitude, as the spatial operators take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A ring has so many positions at least, and its ends lie this near.
RING, NEAR = 4, 1e-9


def positions(text: Column) -> Column:
    """array<struct<x,y>> of a list of positions; a pair that holds no two numbers is left out, as is a lone last number."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("double"))
    at = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    pairs = F.when(F.size(numbers) >= 2, F.transform(at, lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("x"), F.get(numbers, 2 * i).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))


def is_closed(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((F.size(ring) >= RING) & (F.abs(first["x"] - last["x"]) < NEAR) & (F.abs(first["y"] - last["y"]) < NEAR), F.lit(False))


def features(spark: SparkSession, path: str, tag: str, attributes: dict[str, str]) -> DataFrame:
    """(id, attributes, rings array<array<struct<x,y>>>, closed array<boolean>) of the features of one tag; each posList, or pos of a point, is a ring.

    tag: as the document writes it, prefix included. attributes: name without prefix -> type, NULL where the feature has none of that type. The document is never held whole: the reader cuts it into features."""
    rows = spark.read.format("xml").option("rowTag", tag).option("singleVariantColumn", "feature").load(path)
    text, prefix, value = rows.select(F.to_json("feature").alias("json")), r"(?:\w+:)?", r'(?:\{[^{}]*"_VALUE":)?'
    lists = F.regexp_extract_all("json", F.lit(f'"{prefix}(?:posList|pos)":{value}"([^"]*)"'), F.lit(1))
    named = [F.regexp_extract("json", f'"{prefix}{name}":{value}"?([^",}}]*)', 1).try_cast(kind).alias(name) for name, kind in attributes.items()]
    found = text.select(F.regexp_extract("json", f'"_{prefix}id":"([^"]*)"', 1).alias("id"), *named, F.transform(lists, lambda x: positions(F.regexp_replace(x, r"\\[ntr]", " "))).alias("rings"))
    return found.withColumn("closed", F.transform("rings", is_closed))
