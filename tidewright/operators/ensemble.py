"""Ensemble outcomes: classification, counts, order statistics, lights, certificates and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPECTED = 30
GREEN_HS_CAP = 1.0


def nearest_rank(ordered: Column, percent: int) -> Column:
    """The nearest-rank percentile of an ascending array; NULL of none."""
    return F.get(ordered, F.greatest(F.lit(1), F.floor((F.size(ordered) * percent + 99) / 100)).cast("int") - 1)


def ascending(value: Column) -> Column:
    """A group's values that are not NULL, in order; groups are the members of one departure."""
    return F.sort_array(F.collect_list(value))


def count_of(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def null_poisoned_max(value: Column, where: Column) -> Column:
    """The largest value, 0 of none, NULL as soon as one that counts is NULL."""
    return F.when(F.count_if(where & value.isNull()) > 0, None).otherwise(F.coalesce(F.max(F.when(where, value)), F.lit(0.0)))


def classify(reached: Column, full: Column, abort: Column, no_weather: Column, bound: Column, capped: Column, exhausted: Column) -> Column:
    """A member's outcome from its search; the order of the rules binds."""
    return (
        F.when((abort == "error") & ~no_weather & ~bound, "error")
        .when(no_weather & ~reached, "inconclusive/coverage")
        .when(reached & ~full, "inconclusive/field-coverage")
        .when(~reached & bound, "rerun-without-bound")
        .when(capped & ~reached, "inconclusive/budget")
        .when(reached, "feasible")
        .when(exhausted, "infeasible")
        .otherwise("error")
    )


def after_rerun(kind: Column, reruns: Column) -> Column:
    return F.when((kind == "rerun-without-bound") & (reruns >= 1), "inconclusive/bound").otherwise(kind)


def summarise(members: DataFrame, keys: list[str], expected: int = EXPECTED) -> DataFrame:
    """One row a departure from (keys, member, kind, duration_s, daylight, beat_share, motor_share, fuel_l, max_hs); a member without a kind isn't finished and doesn't count."""
    good, names = F.col("kind") == "feasible", ["duration_s", "beat_share", "motor_share"]
    out = members.groupBy(*keys).agg(
        F.count("kind").alias("n"), count_of("feasible").alias("n_f"), count_of("infeasible").alias("n_inf"), count_of("inconclusive").alias("n_inc"), count_of("error").alias("n_err"),
        F.max(F.when(good, F.col("duration_s"))).alias("worst_s"), F.array(*[F.struct(ascending(F.when(good, F.col(x).cast("double"))).alias("a")) for x in names]).alias("ordered_"),
        F.max(F.when(good, F.col("fuel_l"))).alias("fuel_worst"), F.count_if(good & F.col("daylight")).alias("k_daylight"),
        null_poisoned_max(F.col("max_hs"), good).alias("max_hs"),
    )
    percentiles = {f"{short}_p{p}" if short else f"p{p}_s": nearest_rank(F.col("ordered_")[i]["a"], p) for i, short in enumerate(["", "beat", "motor"]) for p in (50, 90)}
    out = out.withColumns(percentiles | {x: percentiles[x].cast("long") for x in ("p50_s", "p90_s")}).drop("ordered_")
    decided = F.col("n_f") + F.col("n_inf")
    return out.withColumns({
        "share": F.when(decided > 0, F.col("n_f") / decided), "inconclusive_share": F.col("n_inc") / expected, "complete": F.col("n") == expected,
        "share_min": F.col("n_f") / expected, "share_max": (F.col("n_f") + expected - F.col("n")) / expected,
    })


def threshold_rate(k: Column, n: Column) -> Column:
    """The rate of one threshold; 1 while nothing has counted."""
    return F.when(n > 0, k / n).otherwise(1.0)


def light(expected: int = EXPECTED) -> tuple[Column, Column]:
    """(colour, reason) of a complete departure."""
    n_f, n_inf, undecided, share = F.col("n_f"), F.col("n_inf"), F.col("n_inc") + F.col("n_err"), F.col("share")
    rate = threshold_rate(F.col("k_daylight"), n_f)
    none, red, green = n_f + n_inf == 0, share < 0.7, (share >= 0.9) & (rate >= 0.9)
    thin, shaky = n_f < 12, undecided > expected / 3
    wavy = green & ~(F.col("inconclusive_share") > 0.2) & ~thin & ~shaky
    colour = F.when(none, "gul").when(red, "rod").when(wavy, "gronn").otherwise("gul")
    reason = (
        F.when(none, "inkonklusiv").when(red, F.when((n_f + n_inf < 12) | shaky, "tynt-grunnlag").otherwise("andel"))
        .when(F.col("inconclusive_share") > 0.2, "inkonklusiv").when(thin, "tynt-utvalg").when(shaky, "usikkert-grunnlag").when(wavy, None).when(share < 0.9, "andel").otherwise("tid")
    )
    return colour, reason


def wave_capped(colour: Column, reason: Column, max_hs: Column, period_known: bool, cap: float = GREEN_HS_CAP) -> tuple[Column, Column]:
    """A green light turns yellow where the waves are unknown, or high with an unknown period."""
    blind = (colour == "gronn") & max_hs.isNull()
    steep = (colour == "gronn") & (max_hs > cap) & F.lit(not period_known)
    return F.when(blind | steep, "gul").otherwise(colour), F.when(blind, "bolgedata-mangler").when(steep, "bolgeperiode-ukjent").otherwise(reason)


def certificate(expected: int = EXPECTED) -> Column:
    """What an incomplete departure already is for certain: rod/andel, gul/tid or NULL. It only ever warns."""
    n_f, room = F.col("n_f"), expected - F.col("n_inf") - F.col("n_inc") - F.col("n_err")
    needed = F.array_max(F.transform(F.sequence(n_f, F.greatest(room, n_f)), lambda m: m - F.ceil(F.lit(0.9) * m) + 1))
    late = (room >= n_f) & (n_f - F.col("k_daylight") >= needed)
    return F.when(F.col("n_inf") > 0.3 * expected, "rod/andel").when(late, "gul/tid")


def rank_departures(summaries: DataFrame) -> DataFrame:
    """rank and provisional: the robust departures by time, then the rest by share, then the incomplete ones; NULL ranks worst.

    Ranking is over all departures at once: they are sorted in ranges, and a range's ranks follow those of the ranges before it."""
    most = summaries.agg(F.max(F.when(F.col("complete"), F.col("n_f"))).alias("most"))
    rows = summaries.crossJoin(F.broadcast(most))
    bucket = F.when(~F.col("complete"), 2).when(F.col("n_f") >= F.col("most") - 2, 0).otherwise(1)
    endless, worst = F.lit(2**62), F.lit(-1.0)
    p90, share = F.coalesce(F.col("p90_s"), endless), F.coalesce(F.col("share"), worst)
    rows = rows.withColumns({"bucket": bucket, "by_time": F.when(bucket == 0, p90).when(bucket == 2, F.coalesce(F.col("control_s"), endless)), "by_share": share, "late": p90})
    order = [F.col("bucket"), F.col("by_time").asc_nulls_last(), F.col("by_share").desc(), F.col("late"), F.col("departure")]
    ordered = rows.select("departure", "complete", "bucket", "by_time", "by_share", "late").repartitionByRange(*order).sortWithinPartitions(*order)
    # written once, as ranges drawn anew could differ; an id made in a range has the range's number above 33 bits of the row's
    ordered = ordered.select("departure", "complete").checkpoint().withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    before, total = [F.lit(0).cast("int")], 0
    sizes = {r["range"]: r["count"] for r in ordered.groupBy("range").count().collect()}  # one row a range
    for i in range(max(sizes, default=0)):
        total += sizes.get(i, 0)
        before.append(F.lit(total).cast("int"))
    rank = F.element_at(F.array(*before), F.col("range").cast("int") + 1) + F.col("at").bitwiseAND(F.lit(2**33 - 1)).cast("int") + 1
    return ordered.select("departure", rank.alias("rank"), (~F.col("complete")).alias("provisional"))


def worst_first(members: DataFrame, keys: list[str]) -> DataFrame:
    """The order to look at members in: infeasible, then feasible from the slowest, then the rest."""
    group = F.when(F.col("kind") == "infeasible", 0).when(F.col("kind") == "feasible", 1).otherwise(2)
    slow = F.when(F.col("kind") == "feasible", -F.col("duration_s"))
    return members.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(group, slow.asc_nulls_last(), "member")))


def kendall(pairs: DataFrame, keys: list[str], item: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-b and the inversions of two scores within each group, over each pair once. Groups are a departure's members."""
    left, right = (pairs.select(*keys, F.col(item).alias(f"i{s}"), F.col(a).alias(f"a{s}"), F.col(b).alias(f"b{s}")) for s in "pq")
    both = left.join(right, keys).where("ip < iq")
    x, y = F.signum(F.col("ap") - F.col("aq")), F.signum(F.col("bp") - F.col("bq"))
    sums = both.groupBy(*keys).agg(F.sum(x * y).alias("s"), F.count_if(x != 0).alias("nx"), F.count_if(y != 0).alias("ny"), F.count_if(x * y < 0).alias("inversions"))
    return sums.select(*keys, F.try_divide(F.col("s"), F.sqrt(F.col("nx").cast("double") * F.col("ny"))).alias("tau"), "inversions")
