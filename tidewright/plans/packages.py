"""Queries of certificates, packages, harbours, flags and block layouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import angles as A
from tidewright.functions.passage import STILL_KN
from tidewright.functions.seaway import boat_speed
from tidewright.operators import grid as G
from tidewright.plans.grid import CODED
from tidewright.plans.proxies import BOXES, MEMBERS, NODES, POSITIONS, STEPS, boxes, members, nodes, positions, steps, table
from tidewright.plans.scalars import n180
from tidewright.sources.files import scratch
from tidewright.sources.layers import read_layers, write_layers

c = F.col
N360 = "((({0}) % 360 + 360) % 360)"
#: A decode error beyond this is no measurement; fields of a package.
PLAUSIBLE_KN, FIELDS, TURNS = 1.0, ["wind", "current", "waves"], 6


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("tile"), c("o_custkey").alias("package"), F.element_at(F.array(F.lit("current"), F.lit("current-coastal")), (o % 2 + 1).cast("int")).alias("field"), (o % 7 != 0).alias("present"),
        (o % 9 != 0).alias("whole"), (o % 5 == 0).alias("clipped"), F.when(o % 4 != 0, o % 31 / 20 - 0.1).alias("error"), (o % 3).alias("kind"), (o * 7 % 5).alias("member"), (o * 11 % 4 != 0).alias("ok"), (o * 977 % 40000).alias("age_s"),
    )


def cert_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(~c("present") | c("error").isNull(), "no-certificate").when(c("clipped"), "clipping").when(c("error") > PLAUSIBLE_KN, "implausible").otherwise("accepted")
    return certificates(spark, sf_dir).select("tile", verdict.alias("verdict"))


def shared_cert_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A current layer needs its error besides; a coastal mask does not."""
    current = c("field") == "current"
    verdict = F.when(~c("present"), "no-certificate").when(~c("whole"), "incomplete").when(c("clipped"), "clipping").when(current & (c("error").isNull() | (c("error") < 0)), "no-error").when(current & (c("error") > PLAUSIBLE_KN), "implausible").otherwise("accepted")
    return certificates(spark, sf_dir).select("tile", "field", verdict.alias("verdict"))


def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each package and known field the first entry of the control: its age, whether it is stale, its source."""
    rows = certificates(spark, sf_dir).withColumn("field", F.element_at(F.array(*map(F.lit, FIELDS)), (c("kind") + 1).cast("int")))
    known = rows.select("package").distinct().withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    first = rows.where("member = 0").groupBy("package", "field").agg(F.min_by(F.struct("age_s", "ok"), "tile").alias("x"))
    found = known.join(first, ["package", "field"], "left")
    return found.select("package", "field", c("x").isNotNull().alias("present"), c("x.age_s").alias("age_s"), (c("x.age_s") > 21600).alias("stale"), F.when(c("x.ok"), "ok").when(~c("x.ok"), "reduced").alias("source"))


def missing_field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for each field that a package lacks; waves by point hide that of waves."""
    return field_presence(spark, sf_dir).where((~c("present")) & ~((c("field") == "waves") & (c("package") % 2 == 0))).select("package", F.concat(F.lit("mangler-"), c("field")).alias("flag"))


def harbour_approachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no-weather, waves, onshore or ok. The onshore limit is lowered by the guard band; unknown waves don't forbid."""
    onshore = A.angle_between(c("b"), A.norm360(c("a"))) <= 60
    verdict = F.when(c("k") == 2, "no-weather").when((c("user_id") % 5 != 0) & (c("hs") > 3), "waves").when(onshore & (c("tws") > 14 - c("k") / 10), "onshore").otherwise("ok")
    return positions(spark, sf_dir).select("event_id", verdict.alias("verdict"))


def steered(target: Column, wind_from: Column, tws: Column, u: Column, v: Column) -> Column:
    """struct(heading, corrected): the heading at which the current carries the boat along the target course, by fixed-point turns; the target itself where none does."""
    cross = u * F.cos(F.radians(target)) - v * F.sin(F.radians(target))

    def turn(acc: Column, _: Column) -> Column:
        bsp = boat_speed(tws, A.angle_between(wind_from, acc["heading"]))
        sine = F.try_divide(-cross, F.when(bsp > STILL_KN, bsp))
        fits = acc["corrected"] & F.coalesce(F.abs(sine) <= 1, F.lit(False))
        return F.struct(F.when(fits, A.norm360(target + F.degrees(F.asin(A.clamp(sine, -1.0, 1.0))))).otherwise(target).alias("heading"), fits.alias("corrected"))

    start = F.struct(target.alias("heading"), F.lit(True).alias("corrected"))
    return F.when((u == 0) & (v == 0), start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn))


def course_to_steer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positions(spark, sf_dir).select("event_id", steered(A.norm360(c("a")), c("b"), c("tws") + 3, c("u") / 4, c("v") / 4).alias("s"))
    return found.select("event_id", F.round("s.heading", 4).alias("heading"), "s.corrected")


def perturbation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five variants of each departure's control, and its worst feasible member where there is one."""
    worst = members(spark, sf_dir).groupBy("departure").agg(F.max(F.when(c("kind") == "feasible", F.struct("duration_s", "member"))).alias("w"))
    names = ["as-is", "slow", "fast", "less-current", "more-current"]
    plan = F.array_append(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(0).cast("long").alias("member")) for n in names]), F.struct(F.lit("worst-member").alias("variant"), c("w.member").alias("member")))
    return worst.select("departure", F.explode(plan).alias("p")).select("departure", "p.variant", "p.member").where("member IS NOT NULL")


def display_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route's flag codes in the order of their first step, each once."""
    first = steps(spark, sf_dir).groupBy("route", (c("c4") % 7).alias("code")).agg(F.min("seq").alias("seq"))
    return first.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"].cast("string")), ",").alias("codes"))


def flag_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and severity of each code; a code without an entry keeps its name and warns."""
    labels = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(c("n_nationkey").alias("code"), c("n_name").alias("label"), F.when(c("n_regionkey") == 1, "info").otherwise("warning").alias("severity"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", c("s_nationkey").alias("code"))
    return rows.join(F.broadcast(labels), "code", "left").select("s_suppkey", F.coalesce("label", F.concat(F.lit("kode "), c("code").cast("string"))).alias("label"), F.coalesce("severity", F.lit("warning")).alias("severity"))  # 25 labels


def lattice_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of a rectangle's cells that are to be kept."""
    def centres(low: str, high: str, step: float) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((c(high) - c(low)) / step - 0.000001) - 1)))

    rows = boxes(spark, sf_dir).withColumn("i", centres("south", "north", 0.02)).withColumn("j", centres("west", "east", 0.03))
    return rows.where("(i + j + box) % 3 <> 0").select("box", "i", "j", F.round(c("south") + (c("i") + 0.5) * 0.02, 6).alias("lat"), F.round(c("west") + (c("j") + 0.5) * 0.03, 6).alias("lon"))


def slice_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rectangle's window of the grid, counted from its own corner."""
    windows = table(spark, sf_dir, "nation").select("n_nationkey", (c("n_nationkey") % 3).alias("i0"), (c("n_nationkey") % 3 + 2).alias("i1"), (c("n_nationkey") % 7 * 5).alias("j0"), (c("n_nationkey") % 7 * 5 + 4).alias("j1"))
    cells = windows.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    found = cells.join(nodes(spark, sf_dir).where("k = 0").hint("merge"), ["i", "j"])
    return found.select("n_nationkey", (c("i") - c("i0")).alias("i"), (c("j") - c("j0")).alias("j"), F.round("v", 6).alias("v"))


def regular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values gathered through each cell's source and each step's source time, in knots; NULL where either lacks."""
    cells = spark.range(0, 300).select(c("id").alias("cell"), F.when(c("id") % 11 != 0, c("id") * 7 % 500).alias("source"))
    times = spark.range(0, 6).select(c("id").alias("step"), F.when(c("id") != 4, (c("id") * 3 + 1) % 8).alias("k"))
    native = nodes(spark, sf_dir).select((c("i") * 50 + c("j")).alias("source"), "k", "v")
    found = cells.crossJoin(F.broadcast(times)).join(native.hint("merge"), ["source", "k"], "left")  # 300 cells and 6 steps of a fixed grid
    return found.select("cell", "step", F.round(c("v") * 3600 / 1852, 6).alias("kn"))


def layer_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block and step as the bytes of its codes in row order."""
    codes = G.coded(nodes(spark, sf_dir)).select(F.floor(c("i") / 32).alias("bi"), F.floor(c("j") / 32).alias("bj"), "k", "i", "j", c("code").cast("int").alias("code"))
    whole = codes.groupBy("bi", "bj", "k").agg(F.array_sort(F.collect_list(F.struct("i", "j", "code"))).alias("rows"))  # a block has 1024 nodes at most
    return whole.select("bi", "bj", "k", F.lower(F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(r["code"]), 2, "0")), "")).alias("bytes"))


def layer_deserialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes read back from the bytes, by their place in the block."""
    rows = layer_serialize(spark, sf_dir).select("bi", "bj", "k", "bytes", F.explode(F.sequence(F.lit(0), F.floor(F.length("bytes") / 2).cast("int") - 1)).alias("place"))
    return rows.select("bi", "bj", "k", "place", F.conv(F.substr("bytes", c("place") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("code"))


def layer_folder(spark: SparkSession, sf_dir: str) -> str:
    """The grid's even and odd steps as two layers in files of a folder of their own."""
    rows = G.coded(nodes(spark, sf_dir)).withColumns({"layer": F.when(c("k") % 2 == 0, "even").otherwise("odd"), "k": F.floor(c("k") / 2)})
    place = {"lat0": 57.5, "lon0": 10.0, "lat_step": 0.1, "lon_step": 0.04, "t0": 0.0, "dt": 7200.0}
    folder = scratch(spark, "layers")
    write_layers(rows.withColumns({k: F.lit(v) for k, v in place.items()}), folder, side=G.BLOCK)
    return folder


def from_layers(rows: DataFrame) -> DataFrame:
    k = c("k") * 2 + F.when(c("file").startswith("odd"), 1).otherwise(0)
    return rows.select(*[x.cast("long").alias(name) for name, x in (("i", c("i")), ("j", c("j")), ("k", k))], "code", F.round("value", 6).alias("value"))


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid written as binary layers and read back, nodes without a value among them."""
    return from_layers(read_layers(spark, layer_folder(spark, sf_dir)))


def layer_block_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of the files' layers from its own ranges, two of its steps."""
    return from_layers(read_layers(spark, layer_folder(spark, sf_dir)).where("bi = 0 and bj = 1 and k between 1 and 2"))


def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block's bytes begin and how many they are, in the order of step and block."""
    blocks = layer_serialize(spark, sf_dir).select("bi", "bj", "k", F.floor(F.length("bytes") / 2).cast("long").alias("length"))
    order = Window.partitionBy("k").orderBy("bi", "bj").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def label_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best labels of each state by score, of equal scores those with less to go."""
    rows = positions(spark, sf_dir).select("event_id", (c("user_id") % 50).alias("state"), F.floor(c("tws") * 10).alias("score"), c("k").alias("to_go"))
    best = Window.partitionBy("state").orderBy("score", "to_go", "event_id")
    return rows.withColumn("place", F.row_number().over(best)).where("place <= 4").select("state", "event_id", "place")


def verify_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that lack, or lie further from what is expected than the tolerance."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 10 != 0, 63.3 + c("s_suppkey") % 7 / 1000).alias("parallel"), (15.0 + c("s_suppkey") % 5 / 500).alias("meridian"))
    known = F.array(*[F.struct(F.lit(n).alias("attribute"), c(n).alias("found"), F.lit(x).alias("expected")) for n, x in (("parallel", 63.3), ("meridian", 15.0))])
    rows = rows.select("s_suppkey", F.explode(known).alias("a")).select("s_suppkey", "a.*")
    return rows.where("found IS NULL OR abs(found - expected) > 0.0045").select("s_suppkey", "attribute", F.round("found", 6).alias("found"))


QUERIES = {f.__name__: f for f in (
    cert_accept, shared_cert_accept, field_presence, missing_field_flags, harbour_approachable, course_to_steer, perturbation_plan, display_flags, flag_label, lattice_points, slice_block, regular_values,
    layer_serialize, layer_deserialize, layer_files, layer_block_read, block_ranges, label_insert, verify_attrs)}

_CERTS = """
    SELECT o_orderkey AS tile, o_custkey AS package, ['current', 'current-coastal'][o_orderkey % 2 + 1] AS field, o_orderkey % 7 <> 0 AS present, o_orderkey % 9 <> 0 AS whole, o_orderkey % 5 = 0 AS clipped,
           CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 31)::DOUBLE / 20 - 0.1::DOUBLE END AS error, o_orderkey % 3 AS kind, o_orderkey * 7 % 5 AS member, o_orderkey * 11 % 4 <> 0 AS ok, o_orderkey * 977 % 40000 AS age_s
    FROM orders"""
_PRESENCE = f"""
    WITH e AS (SELECT *, ['wind', 'current', 'waves'][kind + 1] AS name FROM ({_CERTS})),
    known AS (SELECT DISTINCT package, f AS field FROM e, (SELECT unnest(['wind', 'current', 'waves']) AS f)),
    first AS (SELECT package, name AS field, min_by(age_s, tile) AS age_s, min_by(ok, tile) AS ok FROM e WHERE member = 0 GROUP BY package, name),
    presence AS (
        SELECT package, field, first.age_s IS NOT NULL AS present, first.age_s AS age_s, first.age_s > 21600 AS stale, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'reduced' END AS source
        FROM known LEFT JOIN first USING (package, field))"""


def _steer() -> str:
    out = "WITH s0 AS (SELECT event_id, u / 4 AS u, v / 4 AS v, tws + 3 AS tws, b, {0} AS target, {0} AS heading, true AS corrected FROM ({1}))".format(N360.format("a"), POSITIONS)
    for i in range(1, TURNS + 1):
        out += f""",
        t{i} AS (SELECT *, abs((b - heading + 540) % 360 - 180) AS twa, u * cos(radians(target)) - v * sin(radians(target)) AS cross_ FROM s{i - 1}),
        p{i} AS (SELECT *, 8.5 * (1 - exp(-least(tws, 25) / 9)) * (CASE WHEN twa < 32 THEN 0 WHEN twa <= 100 THEN 0.55 + 0.45 * (twa - 32) / 68 ELSE 1 - 0.25 * (twa - 100) / 80 END) AS bsp FROM t{i}),
        f{i} AS (SELECT *, CASE WHEN bsp > 0.05 THEN -cross_ / bsp END AS sine FROM p{i}),
        s{i} AS (
            SELECT event_id, u, v, tws, b, target, CASE WHEN corrected AND coalesce(abs(sine) <= 1, false) THEN {N360.format('target + degrees(asin(greatest(-1, least(1, sine))))')} ELSE target END AS heading,
                   corrected AND coalesce(abs(sine) <= 1, false) AS corrected FROM f{i})"""
    return out + f" SELECT event_id, round(CASE WHEN u = 0 AND v = 0 THEN target ELSE heading END::DOUBLE, 4) AS heading, (u = 0 AND v = 0) OR corrected AS corrected FROM s{TURNS}"


_BYTES = f"SELECT i // 32 AS bi, j // 32 AS bj, k, string_agg(printf('%02x', code), '' ORDER BY i, j) AS bytes FROM ({CODED}) GROUP BY ALL"
_FILES = f"""
    WITH n AS (SELECT * FROM ({CODED})), g AS (SELECT i, j, k FROM (SELECT unnest(range(0, (SELECT max(i) + 1 FROM n))) AS i), (SELECT unnest(range(0, 50)) AS j), (SELECT unnest(range(0, 8)) AS k))
    SELECT i, j, k, coalesce(code, 255) AS code, round(CASE WHEN code <> 255 THEN low + code * scale END, 6) AS value FROM g LEFT JOIN n USING (i, j, k)"""

ORACLE_SQL = {
    "cert_accept": f"SELECT tile, CASE WHEN NOT present OR error IS NULL THEN 'no-certificate' WHEN clipped THEN 'clipping' WHEN error > 1 THEN 'implausible' ELSE 'accepted' END AS verdict FROM ({_CERTS})",
    "shared_cert_accept": f"""
        SELECT tile, field, CASE WHEN NOT present THEN 'no-certificate' WHEN NOT whole THEN 'incomplete' WHEN clipped THEN 'clipping' WHEN field = 'current' AND (error IS NULL OR error < 0) THEN 'no-error'
                                 WHEN field = 'current' AND error > 1 THEN 'implausible' ELSE 'accepted' END AS verdict FROM ({_CERTS})""",
    "field_presence": f"{_PRESENCE} SELECT * FROM presence",
    "missing_field_flags": f"{_PRESENCE} SELECT package, 'mangler-' || field AS flag FROM presence WHERE NOT present AND NOT (field = 'waves' AND package % 2 = 0)",
    "harbour_approachable": f"""
        SELECT event_id, CASE WHEN k = 2 THEN 'no-weather' WHEN user_id % 5 <> 0 AND hs > 3 THEN 'waves' WHEN abs((b - {N360.format('a')} + 540) % 360 - 180) <= 60 AND tws > 14 - k::DOUBLE / 10 THEN 'onshore' ELSE 'ok' END AS verdict
        FROM ({POSITIONS})""",
    "course_to_steer": _steer(),
    "perturbation_plan": f"""
        SELECT departure, unnest(['as-is', 'slow', 'fast', 'less-current', 'more-current']) AS variant, 0::BIGINT AS member FROM (SELECT DISTINCT departure FROM ({MEMBERS}))
        UNION ALL SELECT departure, 'worst-member', member FROM (SELECT *, row_number() OVER (PARTITION BY departure ORDER BY duration_s DESC, member DESC) AS r FROM ({MEMBERS}) WHERE kind = 'feasible') WHERE r = 1""",
    "display_flags": f"SELECT route, string_agg(CAST(code AS VARCHAR), ',' ORDER BY seq, code) AS codes FROM (SELECT route, c4 % 7 AS code, min(seq) AS seq FROM ({STEPS}) GROUP BY ALL) GROUP BY route",
    "flag_label": """
        SELECT s_suppkey, coalesce(n_name, 'kode ' || s_nationkey) AS label, CASE WHEN n_regionkey = 1 THEN 'info' ELSE 'warning' END AS severity
        FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = s_nationkey""",
    "lattice_points": f"""
        WITH a AS (SELECT box, south, west, east, unnest(range(0, greatest(1, CAST(ceil((north - south) / 0.02::DOUBLE - 0.000001::DOUBLE) AS BIGINT)))) AS i FROM ({BOXES})),
        b AS (SELECT box, south, west, i, unnest(range(0, greatest(1, CAST(ceil((east - west) / 0.03::DOUBLE - 0.000001::DOUBLE) AS BIGINT)))) AS j FROM a)
        SELECT box, i, j, round(south + (i + 0.5::DOUBLE) * 0.02::DOUBLE, 6) AS lat, round(west + (j + 0.5::DOUBLE) * 0.03::DOUBLE, 6) AS lon FROM b WHERE (i + j + box) % 3 <> 0""",
    "slice_block": f"""
        SELECT n_nationkey, i - n_nationkey % 3 AS i, j - n_nationkey % 7 * 5 AS j, round(v, 6) AS v FROM nation JOIN ({NODES})
          ON k = 0 AND i BETWEEN n_nationkey % 3 AND n_nationkey % 3 + 2 AND j BETWEEN n_nationkey % 7 * 5 AND n_nationkey % 7 * 5 + 4""",
    "regular_values": f"""
        SELECT cell, step, round(v * 3600 / 1852, 6) AS kn FROM (SELECT cell, step, CASE WHEN cell % 11 <> 0 THEN cell * 7 % 500 END AS source, CASE WHEN step <> 4 THEN (step * 3 + 1) % 8 END AS t
            FROM (SELECT unnest(range(0, 300)) AS cell), (SELECT unnest(range(0, 6)) AS step)) LEFT JOIN ({NODES}) ON i * 50 + j = source AND k = t""",
    "layer_serialize": _BYTES,
    "layer_files": _FILES,
    "layer_block_read": f"SELECT * FROM ({_FILES}) WHERE i < 32 AND j >= 32 AND k // 2 BETWEEN 1 AND 2",
    "layer_deserialize": f"SELECT i // 32 AS bi, j // 32 AS bj, k, CAST(row_number() OVER (PARTITION BY i // 32, j // 32, k ORDER BY i, j) - 1 AS INTEGER) AS place, code FROM ({CODED})",
    "block_ranges": f"""
        SELECT bi, bj, k, length, CAST(coalesce(sum(length) OVER (PARTITION BY k ORDER BY bi, bj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT bi, bj, k, len(bytes) // 2 AS length FROM ({_BYTES}))""",
    "label_insert": f"""
        SELECT state, event_id, CAST(place AS INTEGER) AS place FROM (
            SELECT event_id, user_id % 50 AS state, row_number() OVER (PARTITION BY user_id % 50 ORDER BY floor(tws * 10), k, event_id) AS place FROM ({POSITIONS})) WHERE place <= 4""",
    "verify_attrs": """
        SELECT s_suppkey, attribute, round(found, 6) AS found FROM (
            SELECT s_suppkey, 'parallel' AS attribute, CASE WHEN s_suppkey % 10 <> 0 THEN 63.3::DOUBLE + (s_suppkey % 7)::DOUBLE / 1000 END AS found, 63.3::DOUBLE AS expected FROM supplier
            UNION ALL SELECT s_suppkey, 'meridian', 15 + (s_suppkey % 5)::DOUBLE / 500, 15 FROM supplier)
        WHERE found IS NULL OR abs(found - expected) > 0.0045""",
}
