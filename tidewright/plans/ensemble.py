"""Queries of ensembles over members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import angles as A
from tidewright.operators import ensemble as E
from tidewright.sources.files import checkpoint_folder
from tidewright.plans.proxies import MEMBERS, members, positions, steps, table

c = F.col
HAV = "2 * asin(least(1.0, sqrt(power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2))))"
BRG = "((degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360) % 360)"
SUMMARY = f"""
    SELECT departure, count(*) AS n, count(*) FILTER (kind = 'feasible') AS n_f, count(*) FILTER (kind = 'infeasible') AS n_inf,
           count(*) FILTER (kind = 'inconclusive') AS n_inc, count(*) FILTER (kind = 'error') AS n_err,
           max(duration_s) FILTER (kind = 'feasible') AS worst_s,
           quantile_disc(duration_s, 0.5) FILTER (kind = 'feasible') AS p50_s, quantile_disc(duration_s, 0.9) FILTER (kind = 'feasible') AS p90_s,
           quantile_disc(beat_share, 0.5) FILTER (kind = 'feasible') AS beat_p50, quantile_disc(beat_share, 0.9) FILTER (kind = 'feasible') AS beat_p90,
           quantile_disc(motor_share, 0.5) FILTER (kind = 'feasible') AS motor_p50, quantile_disc(motor_share, 0.9) FILTER (kind = 'feasible') AS motor_p90,
           max(fuel_l) FILTER (kind = 'feasible') AS fuel_worst, count(*) FILTER (kind = 'feasible' AND daylight) AS k_daylight,
           CASE WHEN count(*) FILTER (kind = 'feasible' AND max_hs IS NULL) > 0 THEN NULL ELSE coalesce(max(max_hs) FILTER (kind = 'feasible'), 0) END AS max_hs,
           CASE WHEN count(*) FILTER (kind IN ('feasible', 'infeasible')) > 0
                THEN count(*) FILTER (kind = 'feasible')::DOUBLE / count(*) FILTER (kind IN ('feasible', 'infeasible')) END AS share,
           count(*) FILTER (kind = 'inconclusive')::DOUBLE / 30 AS inconclusive_share, count(*) = 30 AS complete,
           count(*) FILTER (kind = 'feasible')::DOUBLE / 30 AS share_min, (count(*) FILTER (kind = 'feasible') + 30 - count(*))::DOUBLE / 30 AS share_max
    FROM ({{members}}) GROUP BY departure"""
ALL_SQL = SUMMARY.format(members=MEMBERS)
#: The first members only, as if the rest were still at sea.
PART_SQL = SUMMARY.format(members=f"SELECT * FROM ({MEMBERS}) WHERE member < 12 + departure % 18")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summarise(members(spark, sf_dir), ["departure"])


def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summarise(at_sea(members(spark, sf_dir), c("member") >= 12 + c("departure") % 18), ["departure"])


def at_sea(rows: DataFrame, unfinished: Column) -> DataFrame:
    """Members without an outcome so far."""
    return rows.withColumn("kind", F.when(~unfinished, c("kind")))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def rank_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: members to counts, order statistics, shares and the departures' order."""
    control = members(spark, sf_dir).where("member = 0").select("departure", c("duration_s").alias("control_s"))
    some = E.summarise(at_sea(members(spark, sf_dir), (c("departure") % 9 == 0) & (c("member") >= 20)), ["departure"])
    return E.rank_departures(some.join(control, "departure"))


def departure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries(spark, sf_dir), "share", "inconclusive_share", "share_min", "share_max")


def share_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partial(spark, sf_dir).select("departure", "share_min", "share_max"), "share_min", "share_max")


def feasible_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).select("departure", "worst_s", "p50_s", "p90_s", "beat_p50", "beat_p90", "motor_p50", "motor_p90", "fuel_worst")


def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour, reason = E.light()
    return summaries(spark, sf_dir).select("departure", colour.alias("colour"), reason.alias("reason"))


def wave_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour, reason = E.light()
    rows = summaries(spark, sf_dir).withColumns({"colour": colour, "reason": reason})
    colour, reason = E.wave_capped(c("colour"), c("reason"), c("max_hs"), False)
    return rows.select("departure", colour.alias("colour"), reason.alias("reason"), "max_hs")


def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial(spark, sf_dir).select("departure", E.certificate().alias("certificate"))


def threshold_rate_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries(spark, sf_dir)
    quick = members(spark, sf_dir).where("kind = 'feasible'").groupBy("departure").agg(F.count_if(c("duration_s") < 200_000).alias("k_quick"))
    rates = [E.threshold_rate(c("k_daylight"), c("n_f")), E.threshold_rate(F.coalesce("k_quick", F.lit(0)), c("n_f"))]
    return rows.join(quick, "departure", "left").select("departure", F.round(F.least(F.lit(1.0), *rates), 6).alias("rate"))


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).withColumn("counts_", c("kind") == "feasible")
    rows = rows.groupBy("departure").agg(E.ascending(F.when(c("kind") == "feasible", c("duration_s"))).alias("all"))
    return rows.select("departure", *[E.nearest_rank(c("all"), p).cast("long").alias(f"p{p}") for p in (0, 10, 25, 50, 75, 90, 100)])


def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).groupBy("departure").agg(*[F.round(F.expr(f"percentile(duration_s, {p / 100})"), 6).alias(f"p{p}") for p in (25, 50, 90)])


def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("departure")
    rows = members(spark, sf_dir).withColumns({"place": F.row_number().over(by.orderBy("duration_s", "member")) - 1, "n": F.count("*").over(by)})
    return rows.groupBy("departure").agg(*[F.max(F.when(c("place") == F.least(c("n") - 1, F.floor(c("n") * p / 100)), c("duration_s"))).alias(f"p{p}") for p in (50, 90)])


def max_hs_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("route").agg(E.null_poisoned_max(c("hs"), F.lit(True)).alias("max_hs"))


def ensemble_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).groupBy("departure").agg(F.count("*").alias("n"), E.count_of("feasible").alias("n_f"))
    return rows.select("departure", "n", F.round(c("n_f") / c("n"), 6).alias("fraction"))


def member_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c("event_id")
    kind = E.classify(o % 2 == 0, o % 3 != 0, F.when(o % 5 == 0, "error").otherwise("none"), o % 7 == 0, o % 11 == 0, o % 13 == 0, o % 4 == 1)
    return positions(spark, sf_dir).select("event_id", kind.alias("kind"), E.after_rerun(kind, o % 2).alias("after"))


def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.worst_first(members(spark, sf_dir), ["departure"]).select("departure", "member", "place")


def rank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("departure").orderBy(c("max_hs").asc_nulls_last(), "member")
    return members(spark, sf_dir).select("departure", "member", F.row_number().over(order).alias("place"))


def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.kendall(members(spark, sf_dir), ["departure"], "member", "fuel_l", "beat_share"), "tau").select("departure", "tau")


def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kendall(members(spark, sf_dir), ["departure"], "member", "fuel_l", "beat_share").select("departure", "inversions")


def rank_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best departures with their ties, for each number that counted."""
    rows = summaries(spark, sf_dir).withColumn("place", F.rank().over(Window.partitionBy("n_f").orderBy(c("p90_s").asc_nulls_last())))
    return rows.where("place = 1").groupBy("n_f").agg(F.array_join(F.array_sort(F.collect_list("departure")).cast("array<string>"), ",").alias("tops"))


def rel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = c("u"), c("v")
    diff = F.when((a == 0) & (b == 0), 0.0).when(b != 0, F.try_divide(a - b, b))
    return positions(spark, sf_dir).select("event_id", F.round(diff, 6).alias("diff"))


def band_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a median within two hundredths of the reference, and that less than a fifth of the spread?"""
    rows = summaries(spark, sf_dir).withColumn("gap", F.abs(c("p90_s") - c("p50_s")))
    verdict = F.when(c("p90_s").isNull(), "none").when((c("gap") <= 0.02 * c("p50_s")) & (c("gap") < 0.2 * (c("worst_s") - c("p50_s"))), "within").otherwise("outside")
    return rows.select("departure", verdict.alias("verdict"))


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the differences between members of one departure and the next, where both count."""
    rows = members(spark, sf_dir).where("kind = 'feasible'").select("departure", "member", "duration_s")
    later = rows.select((c("departure") - 1).alias("departure"), "member", c("duration_s").alias("later_s"))
    return rows.join(later, ["departure", "member"]).groupBy("departure").agg(F.round(F.expr("percentile(later_s - duration_s, 0.5)"), 6).alias("median"), F.round(F.expr("percentile(later_s - duration_s, 0.75) - percentile(later_s - duration_s, 0.25)"), 6).alias("iqr"), F.count("*").alias("pairs"))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).groupBy("departure").agg(F.array_sort(F.collect_set(F.when(c("kind") == "infeasible", c("member")))).alias("bad"), F.array_sort(F.collect_set(F.when(c("daylight") & (c("kind") != "feasible"), c("member")))).alias("dark"))
    return rows.select("departure", (c("bad") == c("dark")).alias("equal"), F.array_join(F.array_except("bad", "dark").cast("array<string>"), ",").alias("missing"))


def alternating_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    n = 5
    rows = regions.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("repeat", ((c("r_regionkey") - c("repeat") + n) % n).alias("place"), "r_name")


def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools, solos and their loads as one numbered plan; three short literal lists."""
    pools = spark.range(4, 8).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(F.concat(F.lit("pool-"), "id", F.lit("-"), "repeat").alias("run"))
    solos = spark.range(0, 6).withColumn("load", F.explode(F.array(*map(F.lit, ["spin", "stream", "alloc"])))).select(F.concat(F.lit("solo-"), "load", F.lit("-"), "id").alias("run"))
    return pools.unionByName(solos)


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative range of durations by perturbation, the largest, and whether any run conflicts with the control."""
    rows = members(spark, sf_dir).where("member < 6").withColumn("what", F.when(c("member") % 2 == 0, "cruising").otherwise("current"))
    good = c("kind") == "feasible"
    ranges = rows.groupBy("departure", "what").agg(F.count_if(good).alias("n"), F.min(F.when(good, c("duration_s"))).alias("low"), F.max(F.when(good, c("duration_s"))).alias("high"), F.max(~good).alias("conflict"))
    ranges = ranges.withColumn("range", F.when((c("n") >= 2) & (c("low") > 0), (c("high") - c("low")) / c("low")))
    out = ranges.groupBy("departure").agg(F.max("conflict").alias("conflict"), F.max(F.when(c("what") == "cruising", c("range"))).alias("cruising"), F.max(F.when(c("what") == "current", c("range"))).alias("current"))
    largest = F.when(c("cruising").isNull() & c("current").isNull(), None).when(F.coalesce("cruising", F.lit(-1.0)) >= F.coalesce("current", F.lit(-1.0)), "cruising").otherwise("current")
    return rounded(out.withColumn("largest", largest), "cruising", "current")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's position by the hour, about the control's track."""
    rows = members(spark, sf_dir).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(7))))
    side = F.when(c("kind") == "feasible", 0.05).otherwise(-0.05) * c("h") / 8 + (c("member") * 7 % 11 - 5) / 400
    return rows.select("departure", "member", "kind", "h", (57.5 + c("h") / 10 + (c("departure") % 10) / 50).alias("lat"), (10.0 + c("h") / 20 + F.when(c("departure") % 3 == 0, side).otherwise((c("member") - 15) / 300)).alias("lon"))


HOURLY = f"""
    SELECT departure, member, kind, h, 57.5::DOUBLE + h::DOUBLE / 10 + (departure % 10)::DOUBLE / 50 AS lat,
           10::DOUBLE + h::DOUBLE / 20 + CASE WHEN departure % 3 = 0
               THEN CASE WHEN kind = 'feasible' THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END * h / 8 + (member * 7 % 11 - 5)::DOUBLE / 400 ELSE (member - 15)::DOUBLE / 300 END AS lon
    FROM ({MEMBERS}), (SELECT unnest(range(0, 8)) AS h)"""


def offsets(rows: DataFrame) -> DataFrame:
    """Signed distance of every member's position from the control's leg of the hour, by hour."""
    leg = Window.partitionBy("departure").orderBy("h")
    control = rows.where("member = 0").select("departure", "h", c("lat").alias("lat_a"), c("lon").alias("lon_a"), F.lead("lat").over(leg).alias("lat_b"), F.lead("lon").over(leg).alias("lon_b")).where("lat_b IS NOT NULL")
    joined = rows.where("member > 0").join(control, ["departure", "h"])
    return joined.withColumn("off", F.round(A.cross_track(c("lat_a"), c("lon_a"), c("lat_b"), c("lon_b"), c("lat"), c("lon")), 6))


OFFSETS = f"""
    WITH hourly AS ({HOURLY}),
    control AS (SELECT * FROM (SELECT departure, h, lat AS lat_a, lon AS lon_a, lead(lat) OVER w AS lat_b, lead(lon) OVER w AS lon_b FROM hourly WHERE member = 0 WINDOW w AS (PARTITION BY departure ORDER BY h)) WHERE lat_b IS NOT NULL),
    offsets AS (
        SELECT departure, member, kind, h,
               round(CASE WHEN {HAV.format('lat_a', 'lon_a', 'lat', 'lon')} = 0 THEN 0 ELSE asin(greatest(-1.0, least(1.0, sin({HAV.format('lat_a', 'lon_a', 'lat', 'lon')})
                     * sin(radians({BRG.format('lat_a', 'lon_a', 'lat', 'lon')} - {BRG.format('lat_a', 'lon_a', 'lat_b', 'lon_b')}))))) * 3440.065 END, 6) AS off
        FROM hourly JOIN control USING (departure, h) WHERE member > 0)"""


def fan_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offsets(hourly(spark, sf_dir)).where("kind = 'feasible'").groupBy("departure", "h").agg(E.ascending(c("off")).alias("all"))
    return rows.where(F.size("all") >= 3).select("departure", "h", *[E.nearest_rank(c("all"), p).alias(f"p{p}") for p in (0, 10, 50, 90, 100)])


def first_split(hours: DataFrame, keys: list[str], margin: float = 2.0, concordance: float = 0.75) -> DataFrame:
    """The first hour at which the classes lie apart by the margin, and which side is the feasible one. hours: keys, h, and f and i, the classes' offsets in order."""

    def at(p: int, kind: str):
        return E.nearest_rank(c(kind), p)

    found = hours.withColumns({"f50": at(50, "f"), "i50": at(50, "i"), "f25": at(25, "f"), "f75": at(75, "f"), "i25": at(25, "i"), "i75": at(75, "i")})
    high = c("f50") > c("i50")
    found = found.where("f50 <> i50").withColumns({"high_is_feasible": high, "high": F.when(high, c("f25")).otherwise(c("i25")), "low": F.when(high, c("i75")).otherwise(c("f75"))}).where(c("high") - c("low") >= margin)
    found = found.withColumns({"top": F.when(high, c("f")).otherwise(c("i")), "bottom": F.when(high, c("i")).otherwise(c("f"))})
    agree = (F.size(F.filter("top", lambda x: x >= c("high"))) >= concordance * F.size("top")) & (F.size(F.filter("bottom", lambda x: x <= c("low"))) >= concordance * F.size("bottom"))
    middle = (c("high") + c("low")) / 2
    apart = found.where(agree).withColumn("hits", F.size(F.filter("top", lambda x: x >= middle)) + F.size(F.filter("bottom", lambda x: x <= middle))).withColumn("of", F.size("top") + F.size("bottom"))
    return apart.groupBy(*keys).agg(F.min_by(F.struct("h", "high_is_feasible", "hits", "of"), "h").alias("s")).select(*keys, "s.*")


def decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour that tells the outcomes apart, if it stays when any one member is left out: from each hour's ordered offsets, without another shuffle of the members."""
    ready = summaries(spark, sf_dir).where("complete AND n_f >= 12 AND n_inf >= 3").select("departure")
    rows = offsets(hourly(spark, sf_dir)).join(ready, "departure").where("kind IN ('feasible', 'infeasible')").select("departure", "member", "kind", "h", "off")
    one = F.struct("off", "member")
    checkpoint_folder(spark)
    hours = rows.repartition("departure").groupBy("departure", "h").agg(*[E.ascending(F.when(c("kind") == kind, one)).alias(name) for kind, name in (("feasible", "f"), ("infeasible", "i"))]).checkpoint()  # read four times below

    def left(name: str, keep=None):
        return F.transform(F.filter(name, keep) if keep else c(name), lambda x: x["off"])

    first = first_split(hours.select("departure", "h", left("f").alias("f"), left("i").alias("i")), ["departure"]).checkpoint()
    # only where there is an hour at all, each of at most thirty members is left out in turn
    hours = hours.join(first.select("departure"), "departure", "left_semi")
    members = F.flatten(F.array(F.transform("f", lambda x: x["member"]), F.transform("i", lambda x: x["member"])))
    out = hours.select("departure", F.explode(members).alias("without")).distinct()
    others = hours.join(out, "departure").select("departure", "without", "h", *[left(x, lambda m: m["member"] != c("without")).alias(x) for x in ("f", "i")])
    again = first_split(others, ["departure", "without"]).select("departure", "without", c("h").alias("h_"), c("high_is_feasible").alias("side_"))
    held = out.join(first, "departure").join(again, ["departure", "without"], "left")
    steady = F.coalesce((F.abs(c("h_") - c("h")) <= 1) & (c("side_") == c("high_is_feasible")), F.lit(False))
    stable = held.groupBy("departure").agg(F.min(steady).alias("stable")).where("stable")
    return first.join(stable, "departure").select("departure", "h", "high_is_feasible", "hits", "of")


def cardinal_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = F.array(*[F.struct(A.angle_between(A.norm360(c("a")), F.lit(float(d))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, d) in enumerate([("nord", 0), ("ost", 90), ("sor", 180), ("vest", 270)])])
    return positions(spark, sf_dir).select("event_id", F.array_min(away)["name"].alias("cardinal"))


def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).where("kind IN ('feasible', 'infeasible') AND max_hs IS NOT NULL").groupBy("departure", "kind").agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("members"))


def flag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("route").agg(F.bit_or("flags").alias("flags"))


def receipt_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A departure's plan as a record with a name of its own content; what came of it is written once."""
    colour, _ = E.light()
    rows = summaries(spark, sf_dir).select("departure", "p50_s", colour.alias("colour"))
    receipt = F.to_json(F.struct("colour", "departure", F.coalesce("p50_s", F.lit(0)).alias("p50_s")))
    sailed = c("member") % 10 == 3  # the members whose passage was sailed
    once = members(spark, sf_dir).groupBy("departure").agg(F.min_by(F.when(sailed, c("duration_s")), F.when(sailed, c("member"))).alias("realized_s"))
    return rows.select("departure", F.sha2(receipt, 256).alias("receipt")).join(once, "departure", "left")


def member_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("member"))
    given = members(spark, sf_dir).where("kind <> 'error'").groupBy("departure").agg(F.collect_set("member").alias("have"))
    return given.crossJoin(F.broadcast(known.agg(F.collect_set("member").alias("all")))).select("departure", F.size(F.array_intersect("all", "have")).alias("with_data"), F.size(F.array_except("all", "have")).alias("missing"), F.size(F.array_except("have", "all")).alias("unknown"))


def entropy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = members(spark, sf_dir).groupBy("departure", "kind").count()
    share = c("count") / F.sum("count").over(Window.partitionBy("departure"))
    return counts.withColumn("p", share).groupBy("departure").agg(F.round(F.sum(-c("p") * F.log2("p")), 6).alias("bits"))


_LIGHT = """
    CASE WHEN n_f + n_inf = 0 THEN 'gul' WHEN share < 0.7 THEN 'rod'
         WHEN inconclusive_share > 0.2 OR n_f < 12 OR n_inc + n_err > 10 THEN 'gul'
         WHEN share >= 0.9 AND (n_f = 0 OR k_daylight >= 0.9 * n_f) THEN 'gronn' ELSE 'gul' END AS colour,
    CASE WHEN n_f + n_inf = 0 THEN 'inkonklusiv' WHEN share < 0.7 THEN CASE WHEN n_f + n_inf < 12 OR n_inc + n_err > 10 THEN 'tynt-grunnlag' ELSE 'andel' END
         WHEN inconclusive_share > 0.2 THEN 'inkonklusiv' WHEN n_f < 12 THEN 'tynt-utvalg' WHEN n_inc + n_err > 10 THEN 'usikkert-grunnlag'
         WHEN share >= 0.9 AND k_daylight::DOUBLE / n_f >= 0.9 THEN NULL WHEN share < 0.9 THEN 'andel' ELSE 'tid' END AS reason"""
_PAIRS = f"""
    WITH m AS ({MEMBERS}), pairs AS (
        SELECT p.departure, sign(p.fuel_l - q.fuel_l) AS x, sign(p.beat_share - q.beat_share) AS y FROM m p JOIN m q ON p.departure = q.departure AND p.member < q.member)"""
_CONTROL = f"(SELECT departure, duration_s AS control_s FROM ({MEMBERS}) WHERE member = 0)"


def _rank_sql() -> str:
    some = SUMMARY.format(members=f"SELECT * FROM ({MEMBERS}) WHERE departure % 9 <> 0 OR member < 20")
    return f"""
        WITH s AS (SELECT * FROM ({some}) JOIN {_CONTROL} USING (departure)),
        b AS (SELECT *, CASE WHEN NOT complete THEN 2 WHEN n_f >= (SELECT max(n_f) FROM s WHERE complete) - 2 THEN 0 ELSE 1 END AS bucket FROM s)
        SELECT departure, CAST(row_number() OVER (ORDER BY bucket,
                   CASE bucket WHEN 0 THEN p90_s WHEN 2 THEN control_s END NULLS LAST,
                   share DESC NULLS LAST, p90_s NULLS LAST, departure) AS INTEGER) AS rank, NOT complete AS provisional FROM b"""


def _disc(value: str, *ps: int, where: str = "") -> str:
    return ", ".join(f"quantile_disc({value}, {p / 100}){where} AS p{p}" for p in ps)


_SPLITS = """
    {name}_hours AS (
        SELECT {keys}, h, quantile_disc(off, 0.5) FILTER (kind = 'feasible') AS f50, quantile_disc(off, 0.5) FILTER (kind = 'infeasible') AS i50,
               quantile_disc(off, 0.25) FILTER (kind = 'feasible') AS f25, quantile_disc(off, 0.75) FILTER (kind = 'feasible') AS f75,
               quantile_disc(off, 0.25) FILTER (kind = 'infeasible') AS i25, quantile_disc(off, 0.75) FILTER (kind = 'infeasible') AS i75
        FROM {rows} WHERE kind IN ('feasible', 'infeasible') GROUP BY {keys}, h),
    {name}_sides AS (SELECT *, f50 > i50 AS high_is_feasible, CASE WHEN f50 > i50 THEN f25 ELSE i25 END AS high, CASE WHEN f50 > i50 THEN i75 ELSE f75 END AS low FROM {name}_hours WHERE f50 <> i50),
    {name}_checked AS (
        SELECT {keys}, h, high_is_feasible, any_value(high) AS high, any_value(low) AS low,
               count(*) FILTER ((kind = 'feasible') = high_is_feasible) AS n_top, count(*) FILTER ((kind = 'feasible') <> high_is_feasible) AS n_bottom,
               count(*) FILTER ((kind = 'feasible') = high_is_feasible AND off >= high) AS in_top, count(*) FILTER ((kind = 'feasible') <> high_is_feasible AND off <= low) AS in_bottom,
               count(*) FILTER ((kind = 'feasible') = high_is_feasible AND off >= (high + low) / 2) + count(*) FILTER ((kind = 'feasible') <> high_is_feasible AND off <= (high + low) / 2) AS hits, count(*) AS n
        FROM {name}_sides JOIN (SELECT * FROM {rows} WHERE kind IN ('feasible', 'infeasible')) USING ({keys}, h) GROUP BY {keys}, h, high_is_feasible),
    {name} AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY h) AS r FROM {name}_checked
                       WHERE high - low >= 2 AND in_top >= 0.75 * n_top AND in_bottom >= 0.75 * n_bottom) WHERE r = 1)"""
_FLAGS = "(CAST(floor(l_quantity) AS BIGINT) % 16)"
_HS = "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE (l_suppkey % 40)::DOUBLE / 10 END"
_NUMBERS = "n, n_f, n_inf, n_inc, n_err, worst_s, p50_s, p90_s, beat_p50, beat_p90, motor_p50, motor_p90, fuel_worst, k_daylight, max_hs"

QUERIES = {f.__name__: f for f in (
    rank_departures, departure_summary, share_bounds, feasible_estimates, traffic_light, wave_cap, certificate, threshold_rate_min, percentile_nearest_rank, percentile_linear, percentile_floor, max_hs_steps,
    ensemble_summary, member_classify, worst_first, rank_positions, kendall_tau_b, inversions, rank_for, rel_diff, band_verdict, paired_diff, set_ops, alternating_order, run_plan, sensitivity, fan_band, decision_rule,
    cardinal_for, split_members, flag_union, receipt_freeze, member_census, entropy_histogram)}

ORACLE_SQL = {
    "rank_departures": _rank_sql(),
    "departure_summary": f"SELECT departure, {_NUMBERS}, round(share, 6) AS share, round(inconclusive_share, 6) AS inconclusive_share, complete, round(share_min, 6) AS share_min, round(share_max, 6) AS share_max FROM ({ALL_SQL})",
    "share_bounds": f"SELECT departure, round(share_min, 6) AS share_min, round(share_max, 6) AS share_max FROM ({PART_SQL})",
    "feasible_estimates": f"SELECT departure, worst_s, p50_s, p90_s, beat_p50, beat_p90, motor_p50, motor_p90, fuel_worst FROM ({ALL_SQL})",
    "traffic_light": f"SELECT departure, {_LIGHT} FROM ({ALL_SQL})",
    "wave_cap": f"""
        SELECT departure, CASE WHEN colour = 'gronn' AND (max_hs IS NULL OR max_hs > 1) THEN 'gul' ELSE colour END AS colour,
               CASE WHEN colour = 'gronn' AND max_hs IS NULL THEN 'bolgedata-mangler' WHEN colour = 'gronn' AND max_hs > 1 THEN 'bolgeperiode-ukjent' ELSE reason END AS reason, max_hs
        FROM (SELECT *, {_LIGHT} FROM ({ALL_SQL}))""",
    "certificate": f"""
        SELECT departure, CASE WHEN n_inf > 9 THEN 'rod/andel'
            WHEN 30 - n_inf - n_inc - n_err >= n_f AND n_f - k_daylight >= list_max([m - CAST(ceil(0.9::DOUBLE * m) AS BIGINT) + 1 for m in range(n_f, 31 - n_inf - n_inc - n_err)]) THEN 'gul/tid' END AS certificate
        FROM ({PART_SQL})""",
    "threshold_rate_min": f"""
        SELECT departure, round(least(1, CASE WHEN n_f > 0 THEN k_daylight::DOUBLE / n_f ELSE 1 END, CASE WHEN n_f > 0 THEN coalesce(k, 0)::DOUBLE / n_f ELSE 1 END), 6) AS rate
        FROM ({ALL_SQL}) LEFT JOIN (SELECT departure, count(*) FILTER (duration_s < 200000) AS k FROM ({MEMBERS}) WHERE kind = 'feasible' GROUP BY departure) USING (departure)""",
    "percentile_nearest_rank": f"SELECT departure, {_disc('duration_s', 0, 10, 25, 50, 75, 90, 100, where=chr(32) + 'FILTER (kind = ' + repr('feasible') + ')')} FROM ({MEMBERS}) GROUP BY departure",
    "percentile_linear": f"SELECT departure, {', '.join(f'round(quantile_cont(duration_s::DOUBLE, {p / 100}), 6) AS p{p}' for p in (25, 50, 90))} FROM ({MEMBERS}) GROUP BY departure",
    "percentile_floor": f"SELECT departure, {', '.join(f'list_sort(list(duration_s))[least(count(*), CAST(floor(count(*) * {p} / 100) AS BIGINT) + 1)] AS p{p}' for p in (50, 90))} FROM ({MEMBERS}) GROUP BY departure",
    "max_hs_steps": f"SELECT l_orderkey AS route, CASE WHEN bool_or({_HS} IS NULL) THEN NULL ELSE max({_HS}) END AS max_hs FROM lineitem GROUP BY l_orderkey",
    "ensemble_summary": f"SELECT departure, count(*) AS n, round(count(*) FILTER (kind = 'feasible')::DOUBLE / count(*), 6) AS fraction FROM ({MEMBERS}) GROUP BY departure",
    "member_classify": """
        SELECT event_id, kind, CASE WHEN kind = 'rerun-without-bound' AND event_id % 2 >= 1 THEN 'inconclusive/bound' ELSE kind END AS after FROM (
            SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN 'error' WHEN event_id % 7 = 0 AND event_id % 2 <> 0 THEN 'inconclusive/coverage'
                WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'inconclusive/field-coverage' WHEN event_id % 2 <> 0 AND event_id % 11 = 0 THEN 'rerun-without-bound'
                WHEN event_id % 13 = 0 AND event_id % 2 <> 0 THEN 'inconclusive/budget' WHEN event_id % 2 = 0 THEN 'feasible' WHEN event_id % 4 = 1 THEN 'infeasible' ELSE 'error' END AS kind FROM events)""",
    "worst_first": f"SELECT departure, member, CAST(row_number() OVER (PARTITION BY departure ORDER BY CASE kind WHEN 'infeasible' THEN 0 WHEN 'feasible' THEN 1 ELSE 2 END, CASE WHEN kind = 'feasible' THEN -duration_s END, member) AS INTEGER) AS place FROM ({MEMBERS})",
    "rank_positions": f"SELECT departure, member, CAST(row_number() OVER (PARTITION BY departure ORDER BY max_hs NULLS LAST, member) AS INTEGER) AS place FROM ({MEMBERS})",
    "kendall_tau_b": _PAIRS + " SELECT departure, round(sum(x * y) / sqrt(nullif(count(*) FILTER (x <> 0)::DOUBLE * count(*) FILTER (y <> 0), 0)), 6) AS tau FROM pairs GROUP BY departure",
    "inversions": _PAIRS + " SELECT departure, count(*) FILTER (x * y < 0) AS inversions FROM pairs GROUP BY departure",
    "rank_for": f"SELECT n_f, string_agg(CAST(departure AS VARCHAR), ',' ORDER BY departure) AS tops FROM (SELECT *, rank() OVER (PARTITION BY n_f ORDER BY p90_s NULLS LAST) AS r FROM ({ALL_SQL})) WHERE r = 1 GROUP BY n_f",
    "rel_diff": "SELECT event_id, round(CASE WHEN u = 0 AND v = 0 THEN 0 WHEN v <> 0 THEN (u - v) / v END, 6) AS diff FROM (SELECT event_id, (event_id * 19 % 41 - 20)::DOUBLE / 10 AS u, (user_id * 31 % 41 - 20)::DOUBLE / 10 AS v FROM events)",
    "band_verdict": f"SELECT departure, CASE WHEN p90_s IS NULL THEN 'none' WHEN p90_s - p50_s <= 0.02 * p50_s AND p90_s - p50_s < 0.2 * (worst_s - p50_s) THEN 'within' ELSE 'outside' END AS verdict FROM ({ALL_SQL})",
    "paired_diff": f"""
        WITH m AS (SELECT * FROM ({MEMBERS}) WHERE kind = 'feasible'), d AS (SELECT p.departure, (q.duration_s - p.duration_s)::DOUBLE AS d FROM m p JOIN m q ON q.departure = p.departure + 1 AND q.member = p.member)
        SELECT departure, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr, count(*) AS pairs FROM d GROUP BY departure""",
    "set_ops": f"""
        SELECT departure, count(*) FILTER (bad <> dark) = 0 AS equal, coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (bad AND NOT dark), '') AS missing
        FROM (SELECT departure, member, kind = 'infeasible' AS bad, daylight AND kind <> 'feasible' AS dark FROM ({MEMBERS})) GROUP BY departure""",
    "alternating_order": "SELECT CAST(repeat AS INTEGER) AS repeat, CAST((r_regionkey - repeat + 5) % 5 AS INTEGER) AS place, r_name FROM region, (SELECT unnest(range(0, 4)) AS repeat)",
    "run_plan": "SELECT 'pool-' || p || '-' || r AS run FROM (SELECT unnest(range(4, 8)) AS p), (SELECT unnest(range(1, 6)) AS r) UNION ALL SELECT 'solo-' || l || '-' || i FROM (SELECT unnest(['spin', 'stream', 'alloc']) AS l), (SELECT unnest(range(0, 6)) AS i)",
    "sensitivity": f"""
        WITH r AS (
            SELECT departure, member % 2 = 0 AS cruise, count(*) FILTER (kind = 'feasible') AS n, min(duration_s) FILTER (kind = 'feasible') AS low, max(duration_s) FILTER (kind = 'feasible') AS high, bool_or(kind <> 'feasible') AS conflict
            FROM ({MEMBERS}) WHERE member < 6 GROUP BY ALL),
        s AS (SELECT departure, bool_or(conflict) AS conflict, max(CASE WHEN cruise AND n >= 2 AND low > 0 THEN (high - low)::DOUBLE / low END) AS cruising, max(CASE WHEN NOT cruise AND n >= 2 AND low > 0 THEN (high - low)::DOUBLE / low END) AS current FROM r GROUP BY departure)
        SELECT departure, conflict, round(cruising, 6) AS cruising, round(current, 6) AS current,
               CASE WHEN cruising IS NULL AND current IS NULL THEN NULL WHEN coalesce(cruising, -1) >= coalesce(current, -1) THEN 'cruising' ELSE 'current' END AS largest FROM s""",
    "fan_band": OFFSETS + f" SELECT departure, CAST(h AS INTEGER) AS h, {_disc('off', 0, 10, 50, 90, 100)} FROM offsets WHERE kind = 'feasible' GROUP BY departure, h HAVING count(*) >= 3",
    "decision_rule": OFFSETS + f""",
        ready AS (SELECT o.* FROM offsets o JOIN (SELECT departure FROM ({ALL_SQL}) WHERE complete AND n_f >= 12 AND n_inf >= 3) USING (departure)),
        outs AS (SELECT DISTINCT departure, member AS without FROM ready WHERE kind IN ('feasible', 'infeasible')),
        others AS (SELECT o.without, r.* FROM outs o JOIN ready r ON r.departure = o.departure AND r.member <> o.without),
        {_SPLITS.format(name='split_all', keys='departure', rows='ready')}, {_SPLITS.format(name='split_out', keys='departure, without', rows='others')},
        held AS (SELECT o.departure, bool_and(coalesce(abs(x.h - f.h) <= 1 AND x.high_is_feasible = f.high_is_feasible, false)) AS stable
                 FROM outs o JOIN split_all f USING (departure) LEFT JOIN split_out x ON x.departure = o.departure AND x.without = o.without GROUP BY o.departure)
        SELECT departure, CAST(h AS INTEGER) AS h, high_is_feasible, CAST(hits AS INTEGER) AS hits, CAST(n AS INTEGER) AS of FROM split_all JOIN held USING (departure) WHERE stable""",
    "cardinal_for": """
        SELECT event_id, CASE WHEN d <= 45 OR d >= 315 THEN 'nord' WHEN d <= 135 THEN 'ost' WHEN d <= 225 THEN 'sor' ELSE 'vest' END AS cardinal
        FROM (SELECT event_id, ((event_id * 37 % 720) - 360 + 720) % 360 AS d FROM events)""",
    "split_members": f"SELECT departure, kind, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members FROM ({MEMBERS}) WHERE kind IN ('feasible', 'infeasible') AND max_hs IS NOT NULL GROUP BY departure, kind",
    "flag_union": f"SELECT l_orderkey AS route, CAST(bit_or({_FLAGS}) AS INTEGER) AS flags FROM lineitem GROUP BY l_orderkey",
    "receipt_freeze": f"""
        SELECT s.departure, sha256('{{"colour":"' || colour || '","departure":' || s.departure || ',"p50_s":' || coalesce(p50_s, 0) || '}}') AS receipt, realized_s
        FROM (SELECT departure, p50_s, {_LIGHT} FROM ({ALL_SQL})) s LEFT JOIN (SELECT departure, min_by(duration_s, member) AS realized_s FROM ({MEMBERS}) WHERE member % 10 = 3 GROUP BY departure) USING (departure)""",
    "member_census": f"""
        SELECT departure, CAST(count(*) FILTER (member < 25) AS INTEGER) AS with_data, CAST(25 - count(*) FILTER (member < 25) AS INTEGER) AS missing, CAST(count(*) FILTER (member >= 25) AS INTEGER) AS unknown
        FROM ({MEMBERS}) WHERE kind <> 'error' GROUP BY departure""",
    "entropy_histogram": f"SELECT departure, round(sum(-p * log2(p)), 6) AS bits FROM (SELECT departure, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY departure) AS p FROM ({MEMBERS}) GROUP BY departure, kind) GROUP BY departure",
}
