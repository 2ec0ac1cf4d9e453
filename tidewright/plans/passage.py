"""Queries of a passage's rules, charts, evaluation, weather fields and packages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import angles as A
from tidewright.functions import passage as V
from tidewright.functions import seaway as S
from tidewright.operators import charts as C
from tidewright.operators import evaluation as E
from tidewright.operators import grid as G
from tidewright.operators.routes import longest_gap as gap_of
from tidewright.operators.ensemble import EXPECTED
from tidewright.operators.spatial import at_places, clipped, contained, crosses
from tidewright.plans.grid import AXES, MET, places
from tidewright.plans.proxies import BOXES, MEMBERS, NODES, POSITIONS, STEPS, as_members, boxes, members, nodes, positions, steps, table
from tidewright.plans.scalars import between
from tidewright.plans.voyage import rings, spots
from tidewright.sources.files import scratch
from tidewright.streaming.running import run_to_end, running_summaries

c = F.col
N360 = "((({0}) % 360 + 360) % 360)"
NEED = {"depth": 4.0, "air": 6.0}


def six(*names: str) -> list[Column]:
    return [F.round(name, 6).alias(name) for name in names]


def unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


# -- steps ------------------------------------------------------------------------------------------------------------------------


def guard_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.when(c("k") == 3, None).when(c("k") == 4, -1.0).when(c("k") == 5, float("nan")).otherwise(c("hs") / 10)
    return positions(spark, sf_dir).select("event_id", F.round(V.guard_band(local, F.lit(0.5)), 6).alias("kn"))


def hard_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", V.hard_limit(c("tws"), c("k") / 20, unless(c("user_id") % 5 == 0, c("hs")), 25.0, 3.5).alias("limit"))


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = unless(c("user_id") % 5 == 0, c("hs"))
    from_deg = F.when(c("user_id") % 3 == 0, (c("event_id") * 7 % 360).cast("double"))
    made = V.kinematics(c("lat"), c("lon"), A.norm360(c("a")), c("b"), c("tws"), known, from_deg, c("u"), c("v"), 1800, 2.5, 5.5)
    return positions(spark, sf_dir).withColumns(made)


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stepped(spark, sf_dir).select("event_id", "motor", *six("twa", "bsp", "sog", "nm", "next_lat", "next_lon"))


def soft_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    night, against = c("k") % 2 == 0, S.wind_against_current(c("b"), c("u"), c("v"))
    rows = positions(spark, sf_dir).select("event_id", *[x.cast("long").alias(name) for name, x in V.soft_costs(A.angle_between(c("b"), A.norm360(c("a"))), c("k") % 3 == 0, night, against, 1800, c("k") * 10).items()])
    return rows


def cost_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", *[V.accumulated(c("user_id"), part).cast("long").alias(name) for name, part in (("t_s", c("tws") * 7), ("beat_s", c("hs") * 5), ("motor_s", c("k") / 2), ("night_s", c("tws") * 0.25))])


def data_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", V.missing_data(unless(c("k") == 1, c("u")), unless(c("k") % 3 == 1, c("hs"))).alias("bits"))


def tub_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = V.reach_nm(unless(c("k") == 3, c("user_id") * 10.0), c("tws") - 1, unless(c("k") == 4, c("hs")), unless(c("k") == 5, c("k") / 10))
    return positions(spark, sf_dir).select("event_id", F.round(reach, 6).alias("nm"))


def field_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    nm = V.field_bound_nm(c("tws") * 10, 0.05, 57.5)
    return positions(spark, sf_dir).select("event_id", F.round(nm, 6).alias("nm"), F.floor(nm * 3600 / 9).alias("seconds"))


def share_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", F.round(V.share_of(c("hs"), c("k")), 6).alias("share"))


def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harbour's depths against draught and clearance."""
    return positions(spark, sf_dir).select("event_id", V.depth_gate(unless(c("k") % 4 == 0, c("tws")), unless(c("k") % 5 == 0, c("hs") * 3), F.lit(2.1) + c("k") / 20).alias("gate"))


def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", F.round(V.length_weight(c("hs"), c("tws") * 12), 6).alias("weight"))


def boat_vmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that sails, motor and current give, over all angles at the strongest wind allowed; and with the margin of a harbour's bound."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.least(c("n_nationkey") + 5.0, F.lit(22.0)).alias("tws"), (c("n_regionkey") / 2).alias("current"))
    most = rows.withColumn("twa", F.explode(F.sequence(F.lit(0), F.lit(180), F.lit(5)))).groupBy("n_nationkey", "current").agg(F.max(S.boat_speed(c("tws"), c("twa"))).alias("sails"))
    kn = F.greatest(c("sails"), F.lit(5.5)) + c("current")
    return most.select("n_nationkey", F.round(kn, 6).alias("kn"), F.round(kn + V.ADMISSIBLE_KN, 6).alias("harbour_kn"))


def scaled_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boat's polar by a cruising factor, none of a factor that isn't positive; the current by a scale, and what bounds it."""
    factor, scale = c("k") / 8, c("k") / 5
    return positions(spark, sf_dir).select("event_id", F.round(F.when(factor > 0, S.boat_speed(c("tws"), c("b") % 181) * factor), 6).alias("kn"), *[F.round(c(x) * scale, 6).alias(x) for x in ("u", "v")], F.round(3 * F.greatest(F.lit(1.0), scale), 6).alias("most"))


# -- charts -----------------------------------------------------------------------------------------------------------------------


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles as charted areas of nine kinds."""
    kinds = F.array(*map(F.lit, ["dry", "rock", "shoal", "band", "fairway", "quality", "guard", "air", "season"]))
    quality = F.element_at(F.array(*map(F.lit, C.QUALITY)), (c("box") % 6 + 1).cast("int"))
    return boxes(spark, sf_dir).drop("reason").withColumns({"kind": F.element_at(kinds, (c("box") % 9 + 1).cast("int")), "depth": unless(c("box") % 4 == 0, c("box") % 12 + 0.5), "quality": quality})


def chart_point_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.point_verdicts(positions(spark, sf_dir).select("event_id", "lat", "lon"), areas(spark, sf_dir), "event_id", NEED, 0.1)
    return found.select("event_id", "trust", F.array_join("reasons", ",").alias("reasons"))


def catzoc_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst class of the zones that a chord meets, U where there is none."""
    rows = positions(spark, sf_dir).select("event_id", "lat", "lon", (c("lat") + c("u") / 20).alias("lat2"), (c("lon") + c("v") / 20).alias("lon2"))
    found = clipped(rows, areas(spark, sf_dir).where("kind = 'quality'"), "event_id", 0.1).groupBy("event_id").agg(F.max(C.quality_rank(c("quality2"))).alias("rank"))
    return rows.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce(F.element_at(F.array(*map(F.lit, C.QUALITY)), (c("rank") + 1).cast("int")), F.lit("U")).alias("quality"))


def hazard_buffer_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer is a circle where its centre is known, else its polygon. The circle lies within the buffer's box."""
    points, found = spots(spark, sf_dir, "box % 3 != 0 AS known")
    metres = A.distance_m(c("lat"), c("lon"), (c("south") + c("north")) / 2, (c("west") + c("east")) / 2)
    hit = F.when(c("known"), metres <= (c("north") - c("south")) * 30000).otherwise(crosses(c("lat"), c("lon"), c("ring")))
    return at_places(points, found.where(hit), ["copies"]).select("event_id", F.explode("copies").alias("box"))


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", "lat", "lon", (c("lat") + c("u") / 40).alias("lat2"), (c("lon") + c("v") / 40).alias("lon2"))


def seg_hits_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments_hit(chords(spark, sf_dir), rings(spark, sf_dir), "event_id", 0.1)


def seg_within_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chords(spark, sf_dir).withColumns({"lat2": c("lat") + (c("lat2") - c("lat")) / 10, "lon2": c("lon") + (c("lon2") - c("lon")) / 10})
    return C.segments_within(rows, rings(spark, sf_dir), "event_id", 0.1)


def tiles_along_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles each chord passes, and whether the package has them all."""
    found = C.along_tiles(chords(spark, sf_dir).withColumns({"lat2": c("lat2") + 0.0003, "lon2": c("lon2") + 0.0007}), "event_id", 0.05, 0.03)
    there = (c("x") * 7 + c("y") * 3) % 5 != 0
    return found.groupBy("event_id").agg(F.count("*").alias("tiles"), F.bool_and(there).alias("all_covered"))


def chord_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of a chord within the same harbour's radius, or its end within either's."""
    def near(lat, lon, at_lat, at_lon):
        return A.flat_distance(c(lat), c(lon), at_lat, at_lon) <= 6

    start, dest = (F.lit(58.0), F.lit(11.0)), (F.lit(58.1), F.lit(11.1))
    chord = (near("lat", "lon", *start) & near("lat2", "lon2", *start)) | (near("lat", "lon", *dest) & near("lat2", "lon2", *dest))
    return positions(spark, sf_dir).select("event_id", chord.alias("chord"), (near("lat2", "lon2", *start) | near("lat2", "lon2", *dest)).alias("point"))


# -- evaluation -------------------------------------------------------------------------------------------------------------------


def evaluate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route's steps against the weather's window, wind, the boat's limits, its speed and the chart, in that order."""
    blocked = C.segments_flagged(sailed_legs(spark, sf_dir), rings(spark, sf_dir), "leg", 0.1, {"blocked": c("box") % 5 == 0}).where("blocked")
    tws = c("c1") % 31
    rows = steps(spark, sf_dir).withColumn("leg", c("route") * 100 + c("seq")).join(blocked, "leg", "left")
    rules = [
        ("noWeather", (c("t_s") > 5 * 3600) | (c("c1") % 37 == 0)), ("boatLimits", V.hard_limit(tws, F.lit(0.5), c("hs"), 28.0, 3.6) != "ok"),
        ("noSpeed", S.boat_speed(tws, c("c4") % 181) <= V.STILL_KN), ("segment", c("blocked")),
    ]
    return E.first_rejections(rows, rules)


def sailed_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("route").orderBy("seq")
    return steps(spark, sf_dir).select((c("route") * 100 + c("seq")).alias("leg"), "lat", "lon", F.lead("lat").over(order).alias("lat2"), F.lead("lon").over(order).alias("lon2")).where("lat2 is not null")


def position_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("route"), ((c("o_custkey") * 977) % 30000 - 5000).cast("long").alias("at_s"))
    return E.position_at(steps(spark, sf_dir), asked).select("route", "at_s", *six("lat", "lon"))


def wave_category_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of the three category bits over a route's steps."""
    bits = F.bit_or(F.when(c("c4") % 5 == 0, 1 << 12).when(c("c4") % 11 == 0, 1 << 13).when(c("c4") % 23 == 0, 1 << 14).otherwise(0))
    found = steps(spark, sf_dir).groupBy("route").agg(bits.alias("bits"))
    return found.select("route", F.when(c("bits").bitwiseAND(1 << 14) != 0, "> 20 nm").when(c("bits").bitwiseAND(1 << 13) != 0, "5–20 nm").when(c("bits").bitwiseAND(1 << 12) != 0, "< 5 nm").alias("worst"))


def corridor_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("route").agg(*[F.round(f(x), 6).alias(name) for name, f, x in (("south", F.min, "lat"), ("north", F.max, "lat"), ("west", F.min, "lon"), ("east", F.max, "lon"))])


def control_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each step the stretch to the next one, at the last the one before it; a route of one step has none."""
    order = Window.partitionBy("route").orderBy("seq")
    rows = steps(spark, sf_dir).select("route", "seq", F.lead("seq").over(order).alias("after"), F.lag("seq").over(order).alias("before"))
    return rows.select("route", "seq", F.when(c("after").isNotNull(), c("seq")).otherwise(c("before")).alias("a"), F.coalesce("after", F.when(c("before").isNotNull(), c("seq"))).alias("b")).where("a is not null")


def gap_at_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gap_of(steps(spark, sf_dir), c("c4") % 3 == 0, 3600)
    return found.select("route", F.coalesce(c("gap_s") >= 7200, F.lit(False)).alias("at_limit"))


# -- fields and packages ------------------------------------------------------------------------------------------------------------


def grid_lookup_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as they are, no unit is changed; NULL where any corner lacks."""
    found = G.lookup(places(spark, sf_dir), nodes(spark, sf_dir), AXES, "event_id", {"u": c("v") / 20 - 0.5, "w": c("j") / 50 - c("v") / 30})
    return found.select("event_id", *six("u", "w"))


def grid_lookup_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.lookup(places(spark, sf_dir), nodes(spark, sf_dir), AXES, "event_id", {"hs": c("v") / 5 - 2, "tp": unless(c("j") % 7 == 0, c("v") / 4 + 3)})
    level = V.wave_level(c("hs"), c("tp"), F.lit(None).cast("double"))
    return found.select("event_id", F.round(level["hs"], 6).alias("hs"), F.round(level["tp"], 6).alias("tp"))


def field_at_or_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's value, else the least of its eight neighbours."""
    rows = nodes(spark, sf_dir).where("k = 0").select("i", "j", "v")
    moves = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1)])
    offers = rows.where("v is not null").select("i", "j", "v", F.explode(moves).alias("m")).select((c("i") + c("m.di")).alias("i"), (c("j") + c("m.dj")).alias("j"), "v")
    near = offers.groupBy("i", "j").agg(F.min("v").alias("near"))
    return rows.join(near, ["i", "j"], "left").select("i", "j", F.round(F.coalesce("v", "near"), 6).alias("v"))


def field_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a node's tiles in order the first that has a value serves it; the largest value bounds it."""
    return nodes(spark, sf_dir).groupBy("i", "j").agg(F.min_by(F.when(c("v").isNotNull(), c("v")), F.when(c("v").isNotNull(), c("k"))).alias("v"), F.min(F.when(c("v").isNotNull(), c("k"))).alias("tile"), F.max("v").alias("most")).select("i", "j", "tile", *six("v", "most"))


def member_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a member's wind: 48 hours from departure at most, but for the control."""
    layer_from, layer_to, depart = c("departure") * 3600, c("departure") * 3600 + c("duration_s"), c("departure") * 1800
    to = F.when(c("member") == 0, layer_to).otherwise(F.least(layer_to, depart + V.MEMBER_HORIZON_S))
    return members(spark, sf_dir).select("departure", "member", F.least(layer_from, to).alias("from_s"), to.alias("to_s"))


def tiles_for_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of all cells within reach, each grown by a cell."""
    rows = nodes(spark, sf_dir).where("k = 0 and v <= 15").select((10 + c("j") / 10).alias("lon"), (57 + c("i") / 10).alias("lat"))

    def span(x: str) -> Column:
        return F.explode(F.sequence(F.floor((c(x) - 0.1) / 0.5), F.floor((c(x) + 0.2) / 0.5)))

    return rows.withColumn("x", span("lon")).withColumn("y", span("lat")).select("x", "y").distinct()


def tile_size_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a package's tiles where they agree, else NULL."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", (F.lit(0.5) + F.when(c("s_suppkey") % 9 == 0, 0.25).otherwise(0.0)).alias("size"))
    found = rows.groupBy("s_nationkey").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    return found.select("s_nationkey", F.when(c("high") - c("low") <= 1e-9, c("low")).alias("size"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(c("o_custkey").alias("package"), o.alias("tile"), (o % 4).alias("member"), (o % 11 == 0).alias("rejected"), (o % 3 == 0).alias("current"), (o % 5 != 0).alias("mask"))


def tile_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected member goes from all tiles of its package, a rejected control with its tile; a current without its mask, or the reverse, goes."""
    rows = entries(spark, sf_dir)
    out = rows.where("rejected and member != 0").select("package", "member").distinct()
    return rows.where("not (rejected and member = 0)").join(out, ["package", "member"], "left_anti").select("package", "tile", "member", (c("current") & c("mask")).alias("current"))


def member_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's tiles by member, in their order."""
    return entries(spark, sf_dir).groupBy("package", "member").agg(F.array_join(F.array_sort(F.collect_list("tile")).cast("array<string>"), ",").alias("tiles"))


def status_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok if all sources are, else their reasons in order."""
    rows = entries(spark, sf_dir).groupBy("package").agg(F.bool_and(~c("rejected")).alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("rejected"), c("tile")))), lambda t: F.concat(F.lit("tile "), t.cast("string"))), "; ").alias("reason"))
    return rows


def select_ensemble_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest three runs the first with 30 members; else the newest control alone, else none."""
    newest = Window.partitionBy("o_custkey").orderBy(c("o_orderkey").desc())
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (c("o_orderkey") * 7 % 33).alias("members"), F.row_number().over(newest).alias("place")).where("place <= 3")
    found = runs.groupBy("o_custkey").agg(F.max(F.when(c("members") >= 30, c("o_orderkey"))).alias("full"), F.max(F.when(c("members") >= 1, c("o_orderkey"))).alias("control"))
    return found.select("o_custkey", F.coalesce("full", "control").alias("run"), F.when(c("full").isNotNull(), "ensemble").when(c("control").isNotNull(), "control-only").otherwise("none").alias("kind"))


def bbox_index_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indices of the nodes within each rectangle, and whether they touch the block's open edge; none where no node lies within."""
    near = boxes(spark, sf_dir).select("box", (c("south") - 0.3).alias("south"), (c("north") + 0.3).alias("north"), (c("west") - 0.3).alias("west"), (c("east") + 0.3).alias("east"))
    rows = nodes(spark, sf_dir).where("k = 0").select("i", "j", (57.5 + c("i") / 10).alias("lat"), (10 + c("j") / 25).alias("lon"))
    found = contained(rows, near, 0.4).groupBy("box").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    return found.withColumn("open_edge", (c("i0") == 0) | (c("j0") == 0) | (c("j1") == 49))


def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted tiles that a package has, and those that it lacks."""
    rows = positions(spark, sf_dir)
    wanted = rows.select(F.floor(c("lon") / 0.1).alias("x"), F.floor(c("lat") / 0.1).alias("y")).distinct()
    there = rows.where("k = 0").select(F.floor(c("lon") / 0.1).alias("x"), F.floor(c("lat") / 0.1).alias("y")).distinct().withColumn("covered", F.lit(True))
    return wanted.join(there, ["x", "y"], "left").select("x", "y", F.coalesce("covered", F.lit(False)).alias("covered"))


def archive_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects older than seven days before the newest event."""
    rows = positions(spark, sf_dir).select("event_id", "t")
    return rows.join(F.broadcast(rows.agg(F.max("t").alias("now"))), F.col("now") - F.col("t") > 7 * 86400).select("event_id", (c("now") - c("t")).alias("age_s"))


def wave_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point series whose times don't rise strictly, and how often."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = positions(spark, sf_dir).select("user_id", c("event_id"), (c("t") - c("k") * 40000).alias("at")).withColumn("falls", c("at") <= F.lag("at").over(order))
    return rows.where("falls").groupBy("user_id").agg(F.count("*").alias("falls"))


def quant_fixed_lsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a fixed step over each step's range, the bits they need and those they are stored in."""
    levels = (F.floor((F.max("v") - F.min("v")) / 0.05 + 0.5) + 1).alias("levels")
    found = nodes(spark, sf_dir).groupBy("k").agg(levels)
    return found.select("k", "levels", S.bits_for(c("levels") - 1).cast("long").alias("bits"), F.when(S.bits_for(c("levels") - 1) <= 8, 8).otherwise(16).alias("stored"))


def stream_running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summary as a stream of finished members leaves behind."""
    folder = scratch(spark, "running")
    plain = table(spark, sf_dir, "orders")
    plain.repartition(4, "o_orderkey").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    return run_to_end(running_summaries(as_members(stream), EXPECTED), f"{folder}/out")


QUERIES = {f.__name__: f for f in (
    guard_band, hard_limits, kinematics, soft_cost, cost_accumulate, data_flags, tub_reach, field_lower_bound, share_of, depth_gate, rank_weights, boat_vmax, scaled_models, chart_point_verdict, catzoc_worst,
    hazard_buffer_hit, seg_hits_polygon, seg_within_any, tiles_along_segment, chord_exempt, evaluate_route, position_at, wave_category_worst, corridor_bbox, control_segment, gap_at_limit, grid_lookup_current,
    grid_lookup_waves, field_at_or_near, field_compose, member_horizon, tiles_for_field, tile_size_infer, tile_screen, member_group, status_combine, select_ensemble_run, bbox_index_window, tile_cover,
    archive_expiry, wave_validate, quant_fixed_lsb, stream_running_summary)}

_P = f"FROM ({POSITIONS})"
_POLAR = "8.5 * (1 - exp(-least({0}, 25) / 9)) * (CASE WHEN {1} < 32 THEN 0 WHEN {1} <= 100 THEN 0.55 + 0.45 * ({1} - 32) / 68 ELSE 1 - 0.25 * ({1} - 100) / 80 END)"
_AREAS = f"""
    SELECT *, ['dry', 'rock', 'shoal', 'band', 'fairway', 'quality', 'guard', 'air', 'season'][box % 9 + 1] AS kind, CASE WHEN box % 4 <> 0 THEN (box % 12)::DOUBLE + 0.5 END AS depth,
           box % 6 AS quality FROM ({BOXES})"""
_RINGS = f"SELECT *, (south + north) / 2 AS my, (west + east) / 2 AS mx FROM ({BOXES})"
_SIDES = """
    SELECT box, mx AS ax, south AS ay, east AS bx, my AS by_ FROM r UNION ALL SELECT box, east, my, mx, north FROM r
    UNION ALL SELECT box, mx, north, west, my FROM r UNION ALL SELECT box, west, my, mx, south FROM r"""


def _turn(a: str, b: str, p: str) -> str:
    (ax, ay), (bx, by), (px, py) = (x.split(",") for x in (a, b, p))
    return f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def _inside(lat: str, lon: str) -> str:
    return f"(SELECT count(*) FROM e WHERE e.box = m.box AND (ay > {lat}) <> (by_ > {lat}) AND {lon} < (ax - bx) * ({lat} - by_) / (ay - by_) + bx) % 2 = 1"


def _flags(segments: str) -> str:
    """Every pair of a segment and a ring whose boxes meet, with what holds of it."""
    a, b, p, q = "lon,lat", "lon2,lat2", "ax,ay", "bx,by_"
    return f"""
        s AS ({segments}), r AS ({_RINGS}), e AS ({_SIDES}),
        m AS (
            SELECT s.*, r.box FROM s JOIN r ON least(lon, lon2) <= east AND greatest(lon, lon2) >= west AND least(lat, lat2) <= north AND greatest(lat, lat2) >= south),
        x AS (
            SELECT DISTINCT event_id, m.box FROM m JOIN e ON e.box = m.box
            WHERE {_turn(p, q, a)} * {_turn(p, q, b)} <= 0 AND {_turn(a, b, p)} * {_turn(a, b, q)} <= 0),
        f AS (SELECT m.event_id, m.box, {_inside('lat', 'lon')} AS first_in, {_inside('lat2', 'lon2')} AS last_in, x.box IS NOT NULL AS crossed FROM m LEFT JOIN x ON x.event_id = m.event_id AND x.box = m.box)"""


_CHORDS = "SELECT event_id, lat, lon, lat + u / 40 AS lat2, lon + v / 40 AS lon2 FROM ({0})".format(POSITIONS)
_SHORT = "SELECT event_id, lat, lon, lat + (lat + u / 40 - lat) / 10 AS lat2, lon + (lon + v / 40 - lon) / 10 AS lon2 FROM ({0})".format(POSITIONS)
_ENTRIES = "SELECT o_custkey AS package, o_orderkey AS tile, o_orderkey % 4 AS member, o_orderkey % 11 = 0 AS rejected, o_orderkey % 3 = 0 AS current, o_orderkey % 5 <> 0 AS mask FROM orders"
_DIAGONAL = "sqrt(9.0 + power(3 * cos(radians(57.5::DOUBLE)), 2))"
_NEAR = "sqrt(power(({2} - {0}) * 60, 2) + power(({3} - {1}) * 60 * cos(radians({0})), 2)) <= 6"

ORACLE_SQL = {
    "guard_band": f"SELECT event_id, round(CASE WHEN k IN (3, 4, 5) THEN 0.5::DOUBLE ELSE hs / 10 END, 6) AS kn {_P}",
    "hard_limits": f"SELECT event_id, CASE WHEN tws > 25 - k::DOUBLE / 20 THEN 'tws' WHEN user_id % 5 <> 0 AND hs > 3.5 THEN 'hs' ELSE 'ok' END AS \"limit\" {_P}",
    "kinematics": f"""
        WITH h AS (SELECT *, {N360.format('a')} AS heading {_P}),
        t AS (SELECT *, {between('b', 'heading')} AS twa, coalesce(CASE WHEN user_id % 3 = 0 THEN {between('event_id * 7 % 360', 'heading')} END, {between('b', 'heading')}) AS rel FROM h),
        w AS (SELECT *, CASE WHEN user_id % 5 = 0 OR hs <= 0 THEN 1 ELSE greatest(0.45, 1 - (CASE WHEN rel < 60 THEN 0.09 WHEN rel <= 120 THEN 0.045 ELSE 0.02 END) * hs) END AS wf FROM t),
        g AS (SELECT *, {_POLAR.format('tws', 'twa')} * wf AS sails FROM w),
        b AS (SELECT *, sails < 2.5 AS motor, CASE WHEN sails < 2.5 THEN 5.5 * wf ELSE sails END AS bsp FROM g),
        d AS (SELECT *, bsp * sin(radians(heading)) + u AS east, bsp * cos(radians(heading)) + v AS north FROM b),
        o AS (SELECT *, CASE WHEN bsp > 0.05 AND sqrt(east * east + north * north) > 0.05 THEN sqrt(east * east + north * north) END AS sog FROM d),
        n AS (SELECT *, sog / 2 AS nm, CASE WHEN sog IS NOT NULL THEN {N360.format('degrees(atan2(east, north))')} END AS course FROM o)
        SELECT event_id, motor, round(twa::DOUBLE, 6) AS twa, round(bsp::DOUBLE, 6) AS bsp, round(sog::DOUBLE, 6) AS sog, round(nm::DOUBLE, 6) AS nm,
               round((lat + nm * cos(radians(course)) / 60)::DOUBLE, 6) AS next_lat, round((lon + nm * sin(radians(course)) / (60 * cos(radians(lat))))::DOUBLE, 6) AS next_lon FROM n""",
    "soft_cost": f"""
        WITH t AS (SELECT *, {between('b', N360.format('a'))} < 60 AS beat_on, k % 2 = 0 AS night_on, k % 3 = 0 AS motor_on,
                          sqrt(u * u + v * v) >= 0.5 AND {between(N360.format('degrees(atan2(u, v))'), N360.format('b + 180'))} > 135 AS against {_P})
        SELECT event_id, 1800 + k * 10 AS dt, CASE WHEN beat_on THEN 1800 ELSE 0 END::BIGINT AS beat, CASE WHEN motor_on THEN 1800 ELSE 0 END::BIGINT AS motor, CASE WHEN night_on THEN 1800 ELSE 0 END::BIGINT AS night,
               (CASE WHEN beat_on THEN 8 ELSE 0 END + CASE WHEN motor_on THEN 2 ELSE 0 END + CASE WHEN night_on THEN 4 ELSE 0 END + CASE WHEN against THEN 16 ELSE 0 END)::BIGINT AS flags FROM t""",
    "cost_accumulate": f"SELECT event_id, " + ", ".join(f"CAST(user_id + floor({x} + 0.5) AS BIGINT) AS {n}" for n, x in (("t_s", "tws * 7"), ("beat_s", "hs * 5"), ("motor_s", "k::DOUBLE / 2"), ("night_s", "tws * 0.25::DOUBLE"))) + f" {_P}",
    "data_flags": f"SELECT event_id, CASE WHEN k = 1 THEN 1024 ELSE 0 END + CASE WHEN k % 3 = 1 THEN 256 ELSE 0 END AS bits {_P}",
    "tub_reach": f"SELECT event_id, round(CASE WHEN k <> 3 AND tws - 1 > 0 THEN (CASE WHEN k = 4 THEN 1.09::DOUBLE ELSE hs END) * (tws - 1) * (user_id * 10) * (1 + CASE WHEN k = 5 THEN 0.25::DOUBLE ELSE k::DOUBLE / 10 END) / 3600 END, 6) AS nm {_P}",
    "field_lower_bound": f"SELECT event_id, round(nm, 6) AS nm, CAST(floor(nm * 3600 / 9) AS BIGINT) AS seconds FROM (SELECT event_id, greatest(0, tws * 10 / sqrt(4 - 2 * sqrt(2::DOUBLE)) - 2 * {_DIAGONAL}) AS nm {_P})",
    "share_of": f"SELECT event_id, round(CASE WHEN k = 0 THEN 0 ELSE hs / k END, 6) AS share {_P}",
    "depth_gate": f"""
        SELECT event_id, CASE WHEN least(d, e) IS NULL THEN 'missing' WHEN least(d, e) < 2.1::DOUBLE + k::DOUBLE / 20 THEN 'shallow' ELSE 'ok' END AS gate
        FROM (SELECT event_id, k, CASE WHEN k % 4 <> 0 THEN tws END AS d, CASE WHEN k % 5 <> 0 THEN hs * 3 END AS e {_P})""",
    "rank_weights": f"SELECT event_id, round(hs * (1 + log10(greatest(1, tws * 12 / 10))), 6) AS weight {_P}",
    "boat_vmax": f"""
        SELECT n_nationkey, round(greatest(max({_POLAR.format('tws', 'twa')})::DOUBLE, 5.5) + any_value(current), 6) AS kn, round(greatest(max({_POLAR.format('tws', 'twa')})::DOUBLE, 5.5) + any_value(current) + 0.3, 6) AS harbour_kn
        FROM (SELECT n_nationkey, least(n_nationkey + 5.0, 22)::DOUBLE AS tws, n_regionkey::DOUBLE / 2 AS current, unnest(range(0, 181, 5)) AS twa FROM nation) GROUP BY n_nationkey""",
    "scaled_models": f"SELECT event_id, round(CASE WHEN k > 0 THEN ({_POLAR.format('tws', '(b % 181)')})::DOUBLE * k / 8 END, 6) AS kn, round(u * (k::DOUBLE / 5), 6) + 0.0 AS u, round(v * (k::DOUBLE / 5), 6) + 0.0 AS v, round(3 * greatest(1, k::DOUBLE / 5), 6) AS most {_P}",
    "chart_point_verdict": f"""
        WITH p AS ({POSITIONS}), a AS ({_AREAS}), contour AS (SELECT min(depth) AS contour FROM a WHERE kind = 'band' AND depth >= 4),
        f AS (
            SELECT event_id, bool_or(kind = 'dry') AS dry, bool_or(kind = 'rock' OR kind = 'shoal' AND (depth IS NULL OR depth < 4)) AS rock, min_by(depth, box) FILTER (kind = 'band') AS band,
                   bool_or(kind = 'fairway' OR kind = 'quality' AND quality < 3) AS trusted, bool_or(kind = 'quality') AS rated, bool_or(kind = 'guard') AS guarded, bool_or(kind = 'air' AND depth < 6) AS low, bool_or(kind = 'season') AS season
            FROM p JOIN a ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY event_id),
        g AS (
            SELECT p.event_id, coalesce(dry, false) AS dry, coalesce(rock, false) AS rock, coalesce(band <= contour, false) AS shallow, coalesce(trusted, false) AS trusted, coalesce(rated, false) AS rated, coalesce(guarded, false) AS guarded,
                   coalesce(low, false) AS low, coalesce(season, false) AS season FROM p LEFT JOIN f USING (event_id) CROSS JOIN contour),
        h AS (SELECT *, NOT (dry OR rock OR shallow) AS open FROM g)
        SELECT event_id, CASE WHEN NOT open THEN 'no-go' WHEN low OR season OR NOT trusted OR guarded THEN 'usikkert' ELSE 'trygt' END AS trust,
               array_to_string(list_filter([CASE WHEN dry THEN 'torrfall' END, CASE WHEN rock THEN 'skjaer-buffer' END, CASE WHEN shallow THEN 'grunnere-enn-sikkerhetskontur' END, CASE WHEN open AND trusted AND guarded THEN 'usikker-sondering-i-baand' END,
                   CASE WHEN open AND NOT trusted AND rated THEN 'lav-datakvalitet' END, CASE WHEN open AND NOT trusted AND NOT rated THEN 'utenfor-farled-lav-tetthet' END, CASE WHEN low THEN 'for-lav-luftspenn' END,
                   CASE WHEN season THEN 'vernesone-aktiv' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM h""",
    "catzoc_worst": f"""
        WITH s AS (SELECT event_id, lat, lon, lat + u / 20 AS lat2, lon + v / 20 AS lon2 FROM ({POSITIONS})), a AS ({_AREAS}),
        w AS (SELECT event_id, quality, lon2 - lon AS dx, lat2 - lat AS dy, lat, lon, south, north, west, east FROM s JOIN a ON kind = 'quality' AND least(lon, lon2) <= east AND greatest(lon, lon2) >= west AND least(lat, lat2) <= north AND greatest(lat, lat2) >= south),
        x AS (SELECT *, CASE WHEN dx = 0 THEN 0 ELSE least((west - lon) / dx, (east - lon) / dx) END AS x0, CASE WHEN dx = 0 THEN 1 ELSE greatest((west - lon) / dx, (east - lon) / dx) END AS x1,
                     CASE WHEN dy = 0 THEN 0 ELSE least((south - lat) / dy, (north - lat) / dy) END AS y0, CASE WHEN dy = 0 THEN 1 ELSE greatest((south - lat) / dy, (north - lat) / dy) END AS y1 FROM w),
        z AS (SELECT event_id, max(quality) AS q FROM x WHERE greatest(x0, y0, 0) <= least(x1, y1, 1) GROUP BY event_id)
        SELECT s.event_id, coalesce(['A1', 'A2', 'B', 'C', 'D', 'U'][q + 1], 'U') AS quality FROM s LEFT JOIN z USING (event_id)""",
    "hazard_buffer_hit": f"""
        WITH p AS ({POSITIONS}), r AS ({_RINGS}), e AS ({_SIDES}), m AS (SELECT event_id, lat, lon, r.* FROM p JOIN r ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
        SELECT event_id, box FROM m WHERE CASE WHEN box % 3 <> 0
            THEN 2 * 6371000 * asin(least(1.0, sqrt(power(sin(radians(my - lat) / 2), 2) + cos(radians(lat)) * cos(radians(my)) * power(sin(radians(mx - lon) / 2), 2)))) <= (north - south) * 30000
            ELSE {_inside('lat', 'lon')} END""",
    "seg_hits_polygon": f"WITH {_flags(_CHORDS)} SELECT event_id, box FROM f WHERE first_in OR last_in OR crossed",
    "seg_within_any": f"WITH {_flags(_SHORT)} SELECT event_id FROM f GROUP BY event_id HAVING bool_or(first_in) AND bool_or(last_in) AND NOT bool_or(crossed)",
    "tiles_along_segment": f"""
        WITH s AS (SELECT event_id, lat, lon, lat + u / 40 + 0.0003::DOUBLE AS lat2, lon + v / 40 + 0.0007::DOUBLE AS lon2 FROM ({POSITIONS})),
        x AS (SELECT event_id, unnest(range(CAST(floor(least(lon, lon2) / 0.05::DOUBLE) AS BIGINT) + 1, CAST(floor(greatest(lon, lon2) / 0.05::DOUBLE) AS BIGINT) + 1)) AS i, lon AS a, lon2 - lon AS d FROM s),
        y AS (SELECT event_id, unnest(range(CAST(floor(least(lat, lat2) / 0.03::DOUBLE) AS BIGINT) + 1, CAST(floor(greatest(lat, lat2) / 0.03::DOUBLE) AS BIGINT) + 1)) AS i, lat AS a, lat2 - lat AS d FROM s),
        t AS (SELECT event_id, 0::DOUBLE AS t FROM s UNION SELECT event_id, 1 FROM s UNION SELECT event_id, (i * 0.05::DOUBLE - a) / d FROM x WHERE d <> 0 UNION SELECT event_id, (i * 0.03::DOUBLE - a) / d FROM y WHERE d <> 0),
        m AS (SELECT event_id, (t + lead(t) OVER (PARTITION BY event_id ORDER BY t)) / 2 AS t FROM t WHERE t BETWEEN 0 AND 1),
        u AS (SELECT DISTINCT event_id, CAST(floor((lon + (lon2 - lon) * t) / 0.05::DOUBLE) AS BIGINT) AS x, CAST(floor((lat + (lat2 - lat) * t) / 0.03::DOUBLE) AS BIGINT) AS y FROM s JOIN m USING (event_id) WHERE t IS NOT NULL)
        SELECT event_id, count(*) AS tiles, bool_and((x * 7 + y * 3) % 5 <> 0) AS all_covered FROM u GROUP BY event_id""",
    "chord_exempt": f"""
        SELECT event_id, ({_NEAR.format('lat', 'lon', '58.0', '11.0')} AND {_NEAR.format('lat2', 'lon2', '58.0', '11.0')}) OR ({_NEAR.format('lat', 'lon', '58.1', '11.1')} AND {_NEAR.format('lat2', 'lon2', '58.1', '11.1')}) AS chord,
               {_NEAR.format('lat2', 'lon2', '58.0', '11.0')} OR {_NEAR.format('lat2', 'lon2', '58.1', '11.1')} AS point {_P}""",
    "evaluate_route": f"""
        WITH st AS ({STEPS}), l AS (SELECT route * 100 + seq AS event_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM st WINDOW w AS (PARTITION BY route ORDER BY seq)),
        {_flags("SELECT * FROM l WHERE lat2 IS NOT NULL")},
        blocked AS (SELECT DISTINCT event_id AS leg FROM f WHERE box % 5 = 0 AND (first_in OR last_in OR crossed)),
        kinds AS (
            SELECT st.*, CASE WHEN t_s > 18000 OR c1 % 37 = 0 THEN 'noWeather' WHEN c1 % 31 > 27.5 OR coalesce(hs > 3.6, false) THEN 'boatLimits'
                              WHEN {_POLAR.format('(c1 % 31)', '(c4 % 181)')} <= 0.05 THEN 'noSpeed' WHEN leg IS NOT NULL THEN 'segment' END AS kind
            FROM st LEFT JOIN blocked ON leg = route * 100 + seq),
        bad AS (SELECT route, min(seq) AS at_seq, min_by(kind, seq) AS kind, min_by(t_s, seq) AS t_s FROM kinds WHERE kind IS NOT NULL GROUP BY route)
        SELECT route, coalesce(any_value(at_seq), count(*)) AS steps, any_value(bad.kind) AS kind, coalesce(any_value(bad.t_s), max(kinds.t_s)) AS t_s, coalesce(any_value(bad.kind) IN ('boatLimits', 'point', 'clearance', 'segment', 'tss'), false) AS hard
        FROM kinds LEFT JOIN bad USING (route) GROUP BY route""",
    "position_at": f"""
        WITH st AS ({STEPS}), asked AS (SELECT o_orderkey AS route, o_custkey * 977 % 30000 - 5000 AS at_s FROM orders),
        held AS (SELECT asked.route, at_s, greatest(0, least(max(t_s), at_s)) AS m, max(t_s) AS z FROM asked JOIN st USING (route) GROUP BY asked.route, at_s)
        SELECT h.route, at_s, round(a.lat + (coalesce(b.lat, a.lat) - a.lat) * (m - a.t_s) / 3600, 6) AS lat, round(a.lon + (coalesce(b.lon, a.lon) - a.lon) * (m - a.t_s) / 3600, 6) AS lon
        FROM held h JOIN st a ON a.route = h.route AND a.t_s = m // 3600 * 3600 LEFT JOIN st b ON b.route = h.route AND b.t_s = a.t_s + 3600""",
    "wave_category_worst": f"""
        SELECT route, CASE WHEN bool_or(c4 % 5 <> 0 AND c4 % 11 <> 0 AND c4 % 23 = 0) THEN '> 20 nm' WHEN bool_or(c4 % 5 <> 0 AND c4 % 11 = 0) THEN '5–20 nm' WHEN bool_or(c4 % 5 = 0) THEN '< 5 nm' END AS worst
        FROM ({STEPS}) GROUP BY route""",
    "corridor_bbox": f"SELECT route, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM ({STEPS}) GROUP BY route",
    "control_segment": f"""
        SELECT route, seq, CASE WHEN seq < last THEN seq ELSE seq - 1 END AS a, CASE WHEN seq < last THEN seq + 1 ELSE seq END AS b
        FROM (SELECT route, seq, max(seq) OVER (PARTITION BY route) AS last FROM ({STEPS})) WHERE last > 0""",
    "gap_at_limit": f"""
        WITH s AS (SELECT route, seq, c4 % 3 = 0 AS good, t_s FROM ({STEPS})), r AS (SELECT *, seq - row_number() OVER (PARTITION BY route ORDER BY seq) AS run FROM s WHERE NOT good),
        g AS (SELECT route, max(t) - min(t) + 1800 AS gap FROM (SELECT route, run, t_s AS t FROM r) GROUP BY route, run)
        SELECT route, coalesce(max(gap) >= 7200, false) AS at_limit FROM (SELECT DISTINCT route FROM s) LEFT JOIN g USING (route) GROUP BY route""",
    "grid_lookup_current": f"SELECT event_id, round(CASE WHEN count(v) = count(*) THEN sum(w * (v / 20 - 0.5)) END, 6) + 0.0 AS u, round(CASE WHEN count(v) = count(*) THEN sum(w * (j::DOUBLE / 50 - v / 30)) END, 6) + 0.0 AS w FROM ({MET}) GROUP BY event_id",
    "grid_lookup_waves": f"""
        SELECT event_id, CASE WHEN hs IS NOT NULL THEN round(greatest(0, hs), 6) END AS hs, CASE WHEN hs IS NOT NULL THEN round(tp, 6) END AS tp FROM (
            SELECT event_id, CASE WHEN count(v) = count(*) THEN sum(w * (v / 5 - 2)) END AS hs, CASE WHEN count(CASE WHEN j % 7 <> 0 THEN v END) = count(*) THEN sum(w * (v / 4 + 3)) END AS tp FROM ({MET}) GROUP BY event_id)""",
    "field_at_or_near": f"""
        WITH n AS (SELECT i, j, v FROM ({NODES}) WHERE k = 0)
        SELECT n.i, n.j, round(coalesce(any_value(n.v), min(o.v)), 6) AS v FROM n JOIN n o ON abs(n.i - o.i) <= 1 AND abs(n.j - o.j) <= 1 GROUP BY n.i, n.j""",
    "field_compose": f"SELECT i, j, min(k) FILTER (v IS NOT NULL) AS tile, round(min_by(v, k) FILTER (v IS NOT NULL), 6) AS v, round(max(v), 6) AS most FROM ({NODES}) GROUP BY i, j",
    "member_horizon": f"""
        SELECT departure, member, least(departure * 3600, to_s) AS from_s, to_s FROM (
            SELECT departure, member, CASE WHEN member = 0 THEN departure * 3600 + duration_s ELSE least(departure * 3600 + duration_s, departure * 1800 + 172800) END AS to_s FROM ({MEMBERS}))""",
    "tiles_for_field": f"""
        WITH n AS (SELECT 10 + j::DOUBLE / 10 AS lon, 57 + i::DOUBLE / 10 AS lat FROM ({NODES}) WHERE k = 0 AND v <= 15),
        a AS (SELECT lat, unnest(range(CAST(floor((lon - 0.1::DOUBLE) / 0.5) AS BIGINT), CAST(floor((lon + 0.2::DOUBLE) / 0.5) AS BIGINT) + 1)) AS x FROM n)
        SELECT DISTINCT x, y FROM (SELECT x, unnest(range(CAST(floor((lat - 0.1::DOUBLE) / 0.5) AS BIGINT), CAST(floor((lat + 0.2::DOUBLE) / 0.5) AS BIGINT) + 1)) AS y FROM a)""",
    "tile_size_infer": "SELECT s_nationkey, CASE WHEN bool_or(s_suppkey % 9 = 0) = bool_and(s_suppkey % 9 = 0) THEN CASE WHEN bool_or(s_suppkey % 9 = 0) THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END END AS size FROM supplier GROUP BY s_nationkey",
    "tile_screen": f"""
        WITH e AS ({_ENTRIES}) SELECT package, tile, member, current AND mask AS current FROM e
        WHERE NOT (rejected AND member = 0) AND NOT EXISTS (SELECT 1 FROM e o WHERE o.rejected AND o.member <> 0 AND o.package = e.package AND o.member = e.member)""",
    "member_group": f"SELECT package, member, string_agg(CAST(tile AS VARCHAR), ',' ORDER BY tile) AS tiles FROM ({_ENTRIES}) GROUP BY package, member",
    "status_combine": f"SELECT package, bool_and(NOT rejected) AS ok, coalesce(string_agg('tile ' || tile, '; ' ORDER BY tile) FILTER (rejected), '') AS reason FROM ({_ENTRIES}) GROUP BY package",
    "select_ensemble_run": """
        WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey * 7 % 33 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders),
        g AS (SELECT o_custkey, max(o_orderkey) FILTER (m >= 30) AS f, max(o_orderkey) FILTER (m >= 1) AS c FROM r WHERE place <= 3 GROUP BY o_custkey)
        SELECT o_custkey, coalesce(f, c) AS run, CASE WHEN f IS NOT NULL THEN 'ensemble' WHEN c IS NOT NULL THEN 'control-only' ELSE 'none' END AS kind FROM g""",
    "bbox_index_window": f"""
        SELECT box, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(i) = 0 OR min(j) = 0 OR max(j) = 49 AS open_edge
        FROM ({BOXES}) JOIN (SELECT DISTINCT i, j FROM ({NODES})) ON 57.5::DOUBLE + i::DOUBLE / 10 BETWEEN south - 0.3::DOUBLE AND north + 0.3::DOUBLE AND 10 + j::DOUBLE / 25 BETWEEN west - 0.3::DOUBLE AND east + 0.3::DOUBLE
        GROUP BY box""",
    "tile_cover": f"SELECT CAST(floor(lon / 0.1::DOUBLE) AS BIGINT) AS x, CAST(floor(lat / 0.1::DOUBLE) AS BIGINT) AS y, bool_or(k = 0) AS covered {_P} GROUP BY 1, 2",
    "archive_expiry": f"SELECT event_id, now - t AS age_s FROM (SELECT event_id, t, max(t) OVER () AS now {_P}) WHERE now - t > 7 * 86400",
    "wave_validate": f"SELECT user_id, count(*) AS falls FROM (SELECT user_id, t - k * 40000 <= lag(t - k * 40000) OVER (PARTITION BY user_id ORDER BY event_id) AS falls {_P}) WHERE falls GROUP BY user_id",
    "quant_fixed_lsb": f"""
        SELECT k, levels, CASE WHEN levels <= 1 THEN 1 ELSE CAST(ceil(log2(levels)) AS BIGINT) END AS bits, CASE WHEN levels <= 256 THEN 8 ELSE 16 END AS stored
        FROM (SELECT k, CAST(floor((max(v) - min(v)) / 0.05::DOUBLE + 0.5) AS BIGINT) + 1 AS levels FROM ({NODES}) GROUP BY k)""",
    "stream_running_summary": f"""
        WITH g AS (
            SELECT departure, count(*) FILTER (kind = 'feasible') AS n_f, count(*) FILTER (kind = 'infeasible') AS n_inf, count(*) FILTER (kind = 'inconclusive') AS n_inc, count(*) FILTER (kind = 'error') AS n_err,
                   count(*) FILTER (kind = 'feasible' AND daylight) AS k_daylight FROM ({MEMBERS}) GROUP BY departure),
        n AS (SELECT *, {EXPECTED} - n_inf - n_inc - n_err AS room FROM g),
        o AS (SELECT *, list_max(list_transform(range(n_f, greatest(room, n_f) + 1), lambda m: m - ceil(0.9 * m) + 1)) AS needed FROM n)
        SELECT departure, n_f, n_inf, n_inc, n_err, k_daylight, CASE WHEN n_inf > 0.3 * {EXPECTED} THEN 'rod/andel' WHEN room >= n_f AND n_f - k_daylight >= needed THEN 'gul/tid' END AS certificate FROM o""",
}
