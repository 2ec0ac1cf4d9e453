"""Quantised grids: parameters, codes, temporal and spatial prediction, and lookups between nodes.

A grid is a frame of nodes (i, j, k, v): row, column, step in time and value, NULL where there is none. Everything is a window or a join
on these keys, so it spreads over the nodes; blocks have BLOCK nodes a side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SENTINEL = 32, 255
c = F.col


def levels(bits: int) -> int:
    return 2**bits - 2


def to_raw(compact: Column) -> Column:
    """Codes leave the sentinel out."""
    return F.when(compact >= SENTINEL, compact + 1).otherwise(compact)


def to_compact(raw: Column) -> Column:
    return F.when(raw > SENTINEL, raw - 1).otherwise(raw)


def rounded(x: Column, mode: str) -> Column:
    return {"nearest": F.floor(x + 0.5), "up": F.ceil(x), "down": F.floor(x)}[mode]


def encode(v: Column, offset: Column, scale: Column, bits: int = 8, mode: str = "nearest") -> Column:
    """The code of a value; the sentinel of NULL and NaN, and 0 where the block has one value only."""
    code = F.least(F.lit(levels(bits)), F.greatest(F.lit(0), rounded(F.try_divide(v - offset, scale), mode)))
    return F.when(v.isNull() | F.isnan(v), SENTINEL).when(scale == 0, 0).otherwise(to_raw(code)).cast("int")


def decode(raw: Column, offset: Column, scale: Column) -> Column:
    return F.when(raw != SENTINEL, offset + to_compact(raw) * scale)


def encode_angle(degrees: Column, bits: int = 8) -> Column:
    """Round the circle: one step more than there are levels, and the last one meets the first."""
    steps = levels(bits) + 1
    code = F.floor((degrees % 360 + 360) % 360 / (360 / steps) + 0.5) % steps
    return F.when(degrees.isNull() | F.isnan(degrees), SENTINEL).otherwise(to_raw(code)).cast("int")


def decode_angle(raw: Column, bits: int = 8) -> Column:
    return F.when(raw != SENTINEL, to_compact(raw) * (360 / (levels(bits) + 1)))


def parameters(nodes: DataFrame, bits: int = 8) -> DataFrame:
    """(bi, bj, k, offset, scale) of each block and step; a block without values has none."""
    rows = nodes.withColumns({"bi": F.floor(c("i") / BLOCK), "bj": F.floor(c("j") / BLOCK)})
    ends = rows.groupBy("bi", "bj", "k").agg(F.min("v").alias("offset"), F.max("v").alias("high"))
    return ends.select("bi", "bj", "k", "offset", ((c("high") - c("offset")) / levels(bits)).alias("scale"))


def coded(nodes: DataFrame, bits: int = 8, mode: str = "nearest") -> DataFrame:
    """The nodes with their block's parameters and their codes; one shuffle by block and step."""
    block = Window.partitionBy("bi", "bj", "k")
    rows = nodes.withColumns({"bi": F.floor(c("i") / BLOCK), "bj": F.floor(c("j") / BLOCK)})
    rows = rows.withColumns({"offset": F.min("v").over(block), "scale": (F.max("v").over(block) - F.min("v").over(block)) / levels(bits)})
    return rows.withColumn("code", encode(c("v"), c("offset"), c("scale"), bits, mode))


def delta(codes: DataFrame) -> DataFrame:
    """Each node's codes as differences in time modulo 256."""
    series = Window.partitionBy("i", "j").orderBy("k")
    return codes.withColumn("delta", F.pmod(c("code") - F.coalesce(F.lag("code").over(series), F.lit(0)), F.lit(256)))


def undelta(deltas: DataFrame) -> DataFrame:
    series = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("code", F.pmod(F.sum("delta").over(series), F.lit(256)).cast("int"))


def neighbours(codes: DataFrame) -> DataFrame:
    """left, above and corner of each code within its step; 0 beyond the edge."""
    row, column = Window.partitionBy("i", "k").orderBy("j"), Window.partitionBy("j", "k").orderBy("i")
    rows = codes.withColumn("left", F.coalesce(F.lag("code").over(row), F.lit(0)))
    return rows.withColumns({"above": F.coalesce(F.lag("code").over(column), F.lit(0)), "corner": F.coalesce(F.lag("left").over(column), F.lit(0))})


def median_edge() -> Column:
    """The prediction from left, above and corner."""
    low, high = F.least("left", "above"), F.greatest("left", "above")
    return F.when(c("corner") >= high, low).when(c("corner") <= low, high).otherwise(c("left") + c("above") - c("corner"))


def entropy(codes: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Bits a code of order 0, by keys."""
    counts = codes.groupBy(*keys, code).count()
    p = c("count") / F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.sum(-c("p") * F.log2("p")).alias("bits"))


def corners(queries: DataFrame, axes: dict[str, str]) -> DataFrame:
    """A row for each corner of positive weight: axes names, for each key of the nodes, the column with the place on it."""

    def sides(place: str) -> Column:
        low, share = F.floor(c(place)), c(place) - F.floor(c(place))
        both = F.array(F.struct(low.alias("at"), (1 - share).alias("w")), F.struct((low + 1).alias("at"), share.alias("w")))
        return F.filter(both, lambda x: x["w"] > 0)

    for key, place in axes.items():
        queries = queries.withColumn(f"{key}_", F.explode(sides(place)))
    weight = reduce(lambda a, b: a * b, [c(f"{key}_.w") for key in axes])
    return queries.withColumns({key: c(f"{key}_.at") for key in axes} | {"w": weight}).drop(*[f"{key}_" for key in axes])


def lookup(queries: DataFrame, nodes: DataFrame, axes: dict[str, str], key: str, values: dict[str, Column]) -> DataFrame:
    """(key, values): weighted sums over the corners; NULL if any corner that counts is missing or lies outside."""
    met = corners(queries.select(key, *axes.values()), axes).join(nodes.hint("merge"), list(axes), "left")  # the size of nodes made by exploding is guessed too low: not to be broadcast
    sums = [F.when(F.count(v) == F.count("*"), F.sum(c("w") * v)).alias(name) for name, v in values.items()]
    return met.groupBy(key).agg(*sums)
