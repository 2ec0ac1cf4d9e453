"""Routes as steps (route, seq, t_s, lat, lon, ...): legs, totals, positions in time, gaps, dominance and label chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import bearing, distance_nm

c = F.col


def along():
    return Window.partitionBy("route").orderBy("seq")


def legs(steps: DataFrame) -> DataFrame:
    """From each step to the next: (route, seq, course, nm, seconds) and the flags of the step that ends it."""
    to = {f"{x}2": F.lead(x).over(along()) for x in ("lat", "lon", "t_s", "flags")}
    rows = steps.withColumns(to).where("t_s2 IS NOT NULL")
    place = [c(x) for x in ("lat", "lon", "lat2", "lon2")]
    return rows.select("route", "seq", "lat", "lon", "t_s", "lat2", "lon2", "t_s2", bearing(*place).alias("course"), distance_nm(*place).alias("nm"), (c("t_s2") - c("t_s")).alias("seconds"), c("flags2").alias("flags"))


def totals(steps: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Distance and time of each route, the seconds under each flag, and those under the last two together."""
    rows = legs(steps)
    under = {name: c("flags").bitwiseAND(1 << bit) != 0 for name, bit in bits.items()}
    sums = [F.sum(F.when(x, c("seconds")).otherwise(0)).alias(f"{name}_s") for name, x in under.items()]
    both = reduce(lambda a, b: a & b, list(under.values())[-2:])
    return rows.groupBy("route").agg(F.sum("nm").alias("nm"), F.sum("seconds").alias("duration_s"), *sums, F.sum(F.when(both, c("seconds")).otherwise(0)).alias("both_s"))


def hourly(steps: DataFrame, every_s: int, most: int = 48) -> DataFrame:
    """(route, h, lat, lon) at whole multiples of every_s, most of them at most, on the straight line between the steps around it.

    Each leg makes the times that fall in it, so no join is needed; the last step has its own."""
    to = {f"{x}2": F.lead(x).over(along()) for x in ("lat", "lon", "t_s")}
    rows = steps.withColumns(to)
    first, last = F.ceil(c("t_s") / every_s), F.when(c("t_s2").isNull(), F.floor(c("t_s") / every_s)).otherwise(F.ceil(c("t_s2") / every_s) - 1)
    rows = rows.where(first <= last).withColumn("h", F.explode(F.sequence(first, last))).where(c("h") < most)
    share = F.coalesce(F.try_divide(c("h") * every_s - c("t_s"), c("t_s2") - c("t_s")), F.lit(0.0))
    return rows.select("route", "h", *[(c(x) + F.coalesce(c(f"{x}2") - c(x), F.lit(0.0)) * share).alias(x) for x in ("lat", "lon")])


def longest_gap(samples: DataFrame, good: Column, interval_s: int) -> DataFrame:
    """(route, gap_s): the longest run of samples that are not good, from its first to its last and half an interval; NULL if there is none."""
    rows = samples.withColumn("run", F.count_if(good).over(along())).withColumn("good", good)
    runs = rows.groupBy("route", "run").agg(F.min(F.when(~c("good"), c("t_s"))).alias("a"), F.max(F.when(~c("good"), c("t_s"))).alias("b"))
    return runs.groupBy("route").agg(F.max(c("b") - c("a") + interval_s / 2).alias("gap_s"))


def dominates(a: str, b: str, costs: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [c(f"{a}.{x}") <= c(f"{b}.{x}") for x in costs]) & reduce(lambda x, y: x | y, [c(f"{a}.{x}") < c(f"{b}.{x}") for x in costs])


def front(rows: DataFrame, key: str, costs: list[str], most: int = 10_000) -> DataFrame:
    """The rows that no other row of their key dominates.

    Rows are sorted by their costs within a key, and each is compared with those that came before and stayed: what dominates a row
    sorts before it, and by transitivity something that stays dominates it too. A key of more than `most` rows is first dealt into
    parts of about that many, whose own fronts hold the key's front, so that no task gathers a hot key."""

    def step(kept: Column, row: Column) -> Column:
        beaten = F.exists(kept, lambda k: reduce(lambda x, y: x & y, [k[x] <= row[x] for x in costs]))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(row)))

    def fronts(of: DataFrame, *keys: str) -> DataFrame:
        kept = F.aggregate(F.slice("all_", 2, 1 << 30), F.slice("all_", 1, 1), step)
        return of.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*costs))).alias("all_")).select(*keys, F.explode(kept).alias("f_")).select(*keys, "f_.*")

    points = rows.select(key, *costs)
    hot = points.groupBy(key).agg(F.ceil(F.count("*") / most).alias("parts_")).where("parts_ > 1")
    if not hot.isEmpty():
        dealt = points.join(hot, key).withColumn("part_", F.pmod(F.xxhash64(*costs), F.col("parts_")))
        points = points.join(hot, key, "left_anti").unionByName(fronts(dealt, key, "part_").select(key, *costs))
    return rows.join(fronts(points, key), [key, *costs], "left_semi")


def chains(labels: DataFrame, rounds: int = 32) -> DataFrame:
    """(label, root, depth) by doubling: each round follows the parent's parent, until all have reached a root (whose parent is NULL); parents in a circle are an error.

    Each round is a checkpoint in the shared folder, so the plan doesn't grow."""
    rows = labels.select("label", F.coalesce("parent", "label").alias("to"), F.when(c("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(rounds):
        ahead = rows.select(c("label").alias("to"), c("to").alias("to2"), c("depth").alias("depth2"))
        rows = rows.join(ahead, "to").select("label", c("to2").alias("to"), (c("depth") + c("depth2")).alias("depth"), (c("to") != c("to2")).alias("moved")).checkpoint()
        if rows.where("moved").isEmpty():
            return rows.select("label", c("to").alias("root"), "depth")
        rows = rows.drop("moved")
    raise ValueError(f"chains are longer than 2 ** {rounds} labels, or go in a circle")


def placed(rows: DataFrame, keys: list[str], bucket: Column, order: list) -> DataFrame:
    """The rows with place, from 1 within their keys in the order: by bucket, a bounded number of which rises with the order, then within it. Keys may be few: no
    window holds more than a bucket's rows."""
    rows = rows.withColumn("bucket_", bucket)
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(before, F.lit(0))).drop("n_")
    within = F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy(*order))
    return rows.withColumn("within_", within).join(counts, [*keys, "bucket_"]).withColumn("place", (c("before_") + c("within_")).cast("int")).drop("bucket_", "within_", "before_")
