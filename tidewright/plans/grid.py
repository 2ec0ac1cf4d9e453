"""Queries of the quantised grid and of forecast ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import angles as A
from tidewright.functions import seaway as S
from tidewright.operators import grid as G
from tidewright.operators import spatial as P
from tidewright.plans.proxies import BOXES, MEMBERS, NODES, POSITIONS, boxes, members, nodes, positions, table

c = F.col
AXES = {"i": "fi", "j": "fj", "k": "fk"}
COLUMNS, STEPS = 50, 8
REACH_NM = 12.0


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = c("event_id"), c("user_id")
    return table(spark, sf_dir, "events").select("event_id", (u * 37 % 390 / 10).alias("fi"), (e * 91 % 491 / 10).alias("fj"), (e * 13 % 71 / 10).alias("fk"))


def quant_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parameters(nodes(spark, sf_dir)).select("bi", "bj", "k", F.round("offset", 6).alias("low"), F.round("scale", 9).alias("scale"))


def quant_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.coded(nodes(spark, sf_dir))
    return rows.select("i", "j", "k", "code", G.encode(c("v"), c("offset"), c("scale"), 8, "up").alias("up"), G.encode(c("v"), c("offset"), c("scale"), 8, "down").alias("down"))


def quant_encode_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coded(nodes(spark, sf_dir), 10).select("i", "j", "k", "code")


def quant_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read back, and whether each lies within half a step."""
    rows = G.coded(nodes(spark, sf_dir)).withColumn("back", G.decode(c("code"), c("offset"), c("scale")))
    return rows.select("i", "j", "k", F.round("back", 6).alias("back"), (F.abs(c("back") - c("v")) <= c("scale") / 2 + 1e-9).alias("within"))


def quant_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).withColumn("d", F.when(c("k") == 4, None).otherwise(c("a") + c("tws")))
    rows = rows.select("event_id", "d", G.encode_angle(c("d")).alias("code"), G.encode_angle(c("d"), 10).alias("fine"))
    return rows.select("event_id", "code", "fine", F.round(G.decode_angle(c("code")), 6).alias("back"), F.round(G.decode_angle(c("fine"), 10), 6).alias("fine_back"))


def quant_raw_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", G.to_raw(c("event_id") % 1023).alias("raw"), G.to_compact(G.to_raw(c("event_id") % 1023)).alias("compact"))


def quant_clip_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that parameters fixed beforehand clip."""
    low, scale = F.lit(9.5), F.lit(0.01)
    off = F.abs(G.decode(G.encode(c("v"), low, scale), low, scale) - c("v"))
    return nodes(spark, sf_dir).withColumn("error", off).where(c("error") > 0.01 + 1e-9).select("i", "j", "k", F.round("error", 6).alias("error"))


def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's nodes and its place among all nodes: whole rows of blocks come first, then blocks to the left."""
    rows = nodes(spark, sf_dir).where("k = 0").withColumns({"bi": F.floor(c("i") / G.BLOCK), "bj": F.floor(c("j") / G.BLOCK)})
    size = rows.groupBy("bi", "bj").agg(F.count("*").alias("n"), F.countDistinct("i").alias("height"))
    return size.select("bi", "bj", "n", (c("bi") * G.BLOCK * COLUMNS + c("bj") * G.BLOCK * c("height")).alias("start"))


def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = block_layout(spark, sf_dir)
    rows = nodes(spark, sf_dir).withColumns({"bi": F.floor(c("i") / G.BLOCK), "bj": F.floor(c("j") / G.BLOCK)})
    width = F.least(F.lit(G.BLOCK), COLUMNS - c("bj") * G.BLOCK)
    index = (c("start") + (c("i") % G.BLOCK) * width + c("j") % G.BLOCK) * STEPS + c("k")
    return rows.join(starts, ["bi", "bj"]).select("i", "j", "k", index.alias("place"))


def decode_error_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two channels, and of both together."""
    bounds = G.parameters(nodes(spark, sf_dir)).agg(F.max(c("scale") / 2).alias("u"), F.max("scale").alias("v"))
    return bounds.select(F.round("u", 9).alias("u"), F.round("v", 9).alias("v"), F.round(F.hypot("u", "v"), 9).alias("both"))


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.delta(G.coded(nodes(spark, sf_dir))).select("i", "j", "k", "delta")


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undelta(G.delta(G.coded(nodes(spark, sf_dir))).drop("code")).select("i", "j", "k", "code")


def predict_med2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.neighbours(G.coded(nodes(spark, sf_dir)))
    return rows.select("i", "j", "k", F.pmod(c("code") - G.median_edge(), F.lit(256)).alias("residual"))


def predictors_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a code by step of the codes themselves and of what three predictors leave."""
    rows = G.delta(G.neighbours(G.coded(nodes(spark, sf_dir))))
    kinds = {"none": c("code"), "temporal": c("delta"), "left": F.pmod(c("code") - c("left"), F.lit(256)), "med2d": F.pmod(c("code") - G.median_edge(), F.lit(256))}
    rows = rows.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), x.alias("code")) for n, x in kinds.items()])).alias("r")).select("k", "r.*")
    return G.entropy(rows, ["k", "predictor"]).select("k", "predictor", F.round("bits", 6).alias("bits"))


def grid_lookup_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.lookup(places(spark, sf_dir), nodes(spark, sf_dir), AXES, "event_id", {"v": c("v")})
    return found.select("event_id", F.round("v", 6).alias("v"))


def grid_lookup_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.radians(c("v") * 37)
    found = G.lookup(places(spark, sf_dir), nodes(spark, sf_dir), AXES, "event_id", {"s": F.sin(angle), "t": F.cos(angle)})
    return found.select("event_id", F.round(A.norm360(F.degrees(F.atan2("s", "t"))), 5).alias("degrees"))


def grid_lookup_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components are interpolated, and only then turned into speed and direction."""
    found = G.lookup(places(spark, sf_dir), nodes(spark, sf_dir), AXES, "event_id", {"u": c("v") - 10, "w": c("j") / 7 - c("v") / 3})
    return found.select("event_id", F.round(F.hypot("u", "w"), 6).alias("kn"), F.round(S.wind_from(c("u"), c("w")), 5).alias("from_deg"))


def coastal_mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coastal if any corner that counts is, or is missing; time plays no part."""
    flat = {"i": "fi", "j": "fj"}
    mask = nodes(spark, sf_dir).where("k = 0").select("i", "j", F.coalesce(c("v") > 14, F.lit(True)).alias("coastal"))
    met = G.corners(places(spark, sf_dir).select("event_id", *flat.values()), flat).join(mask, ["i", "j"], "left")
    return met.groupBy("event_id").agg(F.max(F.coalesce("coastal", F.lit(True))).alias("coastal"))


def decode_all_at_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.coded(nodes(spark, sf_dir).where("k = 3"))
    return rows.select("i", "j", F.round(G.decode(c("code"), c("offset"), c("scale")), 6).alias("v"))


def observed_max_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("k").agg(F.round(F.max(F.hypot(c("v"), c("v") - c("j") / 5)), 6).alias("kn"))


def age_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.greatest(F.lit(0), c("event_id") * 97 % 40_000 - 2000)
    return table(spark, sf_dir, "events").select("event_id", age.alias("age_s"), (age > 21_600).alias("stale"))


def budget_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("n_nationkey")
    raw = (n + 1) * 1000 * 2 * 30 * (49 + n % 3) * F.when(n % 2 == 0, 1).otherwise(2)
    return table(spark, sf_dir, "nation").select("n_nationkey", raw.cast("long").alias("raw_bytes"), F.floor(raw * 0.5).alias("packed_bytes"))


def _raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c("event_id")
    value = F.when(e % 11 == 0, float("nan")).when(e % 7 == 0, 9.969209968386869e36).when(e % 5 == 0, c("tws") * 20).otherwise(c("tws"))
    return positions(spark, sf_dir).select("event_id", (e % 30).alias("member"), value.alias("raw"))


def _cause(raw):
    return F.when(F.isnan(raw), "nonFinite").when(raw.cast("float") == F.lit(9.969209968386869e36).cast("float"), "fill").when(F.abs(raw) > 150, "implausible")


def fill_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_values(spark, sf_dir).withColumn("cause", _cause(c("raw")))
    return rows.select("event_id", "cause", F.round(F.when(c("cause").isNull(), c("raw")), 6).alias("value"))


def member_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member goes when more than half of its values are missing."""
    missing = F.count_if(c("beat_share") > 0.45) / F.count("*")
    rows = members(spark, sf_dir).groupBy("departure").agg(missing.alias("missing"))
    return rows.select("departure", F.round("missing", 6).alias("missing"), (c("missing") > 0.5).alias("excluded"))


def sea_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("i", "j").agg(F.min(c("v").isNotNull()).alias("sea"))


def unpack_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(c("event_id") % 9 == 0, -32767).otherwise(c("event_id") * 37 % 6000 - 3000)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(raw != -32767, raw * 0.001 * 3600 / 1852), 6).alias("kn"))


def cell_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of each node to its neighbours, of which there are four at most."""
    rows = nodes(spark, sf_dir).where("k = 0").select("i", "j", (57 + c("i") / 10 + c("j") / 500).alias("lat"), (10 + c("j") / 5).alias("lon"))
    near = rows.select(F.explode(F.array(*[F.struct((c("i") + di).alias("i"), (c("j") + dj).alias("j"), c("lat").alias("lat2"), c("lon").alias("lon2")) for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("n")).select("n.*")
    gap = A.distance_m(c("lat"), c("lon"), c("lat2"), c("lon2"))
    return rows.join(near, ["i", "j"]).groupBy("i", "j").agg(F.round(F.avg(gap) / 1000, 6).alias("km"))


def match_time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each whole minute the row at that second, else a second before, else after; of rows at the same second the first."""
    rows = positions(spark, sf_dir).select("user_id", "event_id", (F.floor(c("t") / 60) * 60).alias("step"), (c("event_id") % 3 - 1).alias("slip"))
    times = rows.select("user_id", "event_id", (c("step") + c("slip")).alias("at"))
    offers = times.select("user_id", F.explode(F.array(*[F.struct((c("at") + d).alias("step"), F.struct(F.lit(r).alias("r"), c("event_id").alias("event_id")).alias("o")) for r, d in ((0, 0), (1, 1), (2, -1))])).alias("x")).select("user_id", "x.*")
    best = offers.groupBy("user_id", "step").agg(F.min("o").alias("o"))
    return rows.select("user_id", "step").distinct().join(best, ["user_id", "step"], "left").select("user_id", "step", c("o.event_id").alias("source"))


def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("event_id", F.floor(c("lon") / 0.5).alias("x"), F.floor(c("lat") / 0.25).alias("y"))


def tiles_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tiles(boxes(spark, sf_dir), 0.25, 0.25).select("box", "x", "y")


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 by 32 nodes, fewer at the ends."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (c("n_nationkey") * 7 + 5).alias("rows"), (c("n_nationkey") * 3 + 40).alias("columns"))
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0), c("rows") - 1, F.lit(32)))).withColumn("q", F.explode(F.sequence(F.lit(0), c("columns") - 1, F.lit(32))))
    return rows.select("n_nationkey", "r", "q", F.least(F.lit(32), c("rows") - c("r")).alias("height"), F.least(F.lit(32), c("columns") - c("q")).alias("width"))


def coastal_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    nm = F.when(c("k") == 2, None).otherwise(c("tws"))
    return positions(spark, sf_dir).select("event_id", F.when(nm > 20, "open").otherwise("coastal").alias("zone"))


def regrid_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest node at sea of each node of a regular grid, within reach; ties to the lower index."""
    native = boxes(spark, sf_dir).where("box % 3 <> 0").select(c("box").alias("source"), ((c("south") + c("north")) / 2).alias("lat2"), ((c("west") + c("east")) / 2).alias("lon2"))
    cells = spark.range(0, 441).select(c("id").alias("node"), (57.5 + F.floor(c("id") / 21) / 10).alias("lat"), (10 + c("id") % 21 / 10).alias("lon"))
    found = P.nearest(cells, native, "node", "source", REACH_NM)
    return found.select("node", "source", F.round("nm", 6).alias("nm"))


QUERIES = {f.__name__: f for f in (
    quant_params, quant_encode, quant_encode_10, quant_decode, quant_angle, quant_raw_compact, quant_clip_detect, block_layout, sample_index, decode_error_bound, delta_encode, delta_decode, predict_med2d,
    predictors_entropy, grid_lookup_scalar, grid_lookup_angle, grid_lookup_wind, coastal_mask_lookup, decode_all_at_step, observed_max_speed, age_at, budget_estimate, fill_mask, member_assess, sea_mask,
    unpack_int16, cell_size, match_time_steps, tile_of_point, tiles_overlapping, block_split, coastal_zone, regrid_nn)}


def _code(levels: int, mode: str = "nearest") -> str:
    x = "((v - low) / scale)"
    number = {"nearest": f"floor({x} + 0.5)", "up": f"ceil({x})", "down": f"floor({x})"}[mode]
    compact = f"CAST(least({levels}, greatest(0, {number})) AS BIGINT)"
    return f"CAST(CASE WHEN v IS NULL THEN 255 WHEN scale = 0 THEN 0 WHEN {compact} >= 255 THEN {compact} + 1 ELSE {compact} END AS INTEGER)"


def _blocks(levels: int = 254) -> str:
    return f"SELECT *, min(v) OVER b AS low, (max(v) OVER b - min(v) OVER b) / {levels} AS scale FROM ({NODES}) WINDOW b AS (PARTITION BY i // 32, j // 32, k)"


CODED = f"SELECT *, {_code(254)} AS code FROM ({_blocks()})"
NEAR = f"""
    SELECT x.*, coalesce(l.code, 0) AS left_, coalesce(a.code, 0) AS above, coalesce(d.code, 0) AS corner, coalesce(p.code, 0) AS before
    FROM coded x LEFT JOIN coded l ON l.i = x.i AND l.j = x.j - 1 AND l.k = x.k LEFT JOIN coded a ON a.i = x.i - 1 AND a.j = x.j AND a.k = x.k
         LEFT JOIN coded d ON d.i = x.i - 1 AND d.j = x.j - 1 AND d.k = x.k LEFT JOIN coded p ON p.i = x.i AND p.j = x.j AND p.k = x.k - 1"""
MED = "CASE WHEN corner >= greatest(left_, above) THEN least(left_, above) WHEN corner <= least(left_, above) THEN greatest(left_, above) ELSE left_ + above - corner END"
PLACES = "SELECT event_id, (user_id * 37 % 390)::DOUBLE / 10 AS fi, (event_id * 91 % 491)::DOUBLE / 10 AS fj, (event_id * 13 % 71)::DOUBLE / 10 AS fk FROM events"
_W = "(CASE {s} WHEN 0 THEN 1 - ({f} - floor({f})) ELSE {f} - floor({f}) END)"
CORNERS = f"""
    SELECT * FROM (SELECT event_id, CAST(floor(fi) AS BIGINT) + a AS i, CAST(floor(fj) AS BIGINT) + b AS j, CAST(floor(fk) AS BIGINT) + d AS k,
           {_W.format(s='a', f='fi')} * {_W.format(s='b', f='fj')} * {_W.format(s='d', f='fk')} AS w
    FROM ({PLACES}), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d)) WHERE w > 0"""
MET = f"SELECT c.event_id, c.w, n.v, c.j FROM ({CORNERS}) c LEFT JOIN ({NODES}) n ON n.i = c.i AND n.j = c.j AND n.k = c.k"
_KM = "2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(power(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians(y.lon - x.lon) / 2), 2))))"
_NM = _KM.replace("6371.0", "3440.065")
_SPEED = "sqrt(v * v + power(v - j::DOUBLE / 5, 2))"

ORACLE_SQL = {
    "quant_params": f"SELECT i // 32 AS bi, j // 32 AS bj, k, round(min(v), 6) AS low, round((max(v) - min(v)) / 254, 9) AS scale FROM ({NODES}) GROUP BY ALL",
    "quant_encode": f"SELECT i, j, k, {_code(254)} AS code, {_code(254, 'up')} AS up, {_code(254, 'down')} AS down FROM ({_blocks()})",
    "quant_encode_10": f"SELECT i, j, k, {_code(1022)} AS code FROM ({_blocks(1022)})",
    "quant_decode": f"SELECT i, j, k, round(CASE WHEN code <> 255 THEN low + code * scale END, 6) AS back, CASE WHEN code <> 255 THEN true END AS within FROM ({CODED})",
    "quant_angle": f"""
        SELECT event_id, code, fine, round(CASE WHEN code <> 255 THEN code * 360.0::DOUBLE / 255 END, 6) AS back, round(CASE WHEN fine <> 255 THEN (CASE WHEN fine > 255 THEN fine - 1 ELSE fine END) * 360.0::DOUBLE / 1023 END, 6) AS fine_back
        FROM (SELECT event_id, CAST(CASE WHEN d IS NULL THEN 255 ELSE x END AS INTEGER) AS code, CAST(CASE WHEN d IS NULL THEN 255 WHEN y >= 255 THEN y + 1 ELSE y END AS INTEGER) AS fine
              FROM (SELECT *, CAST(floor(((d % 360) + 360) % 360 / (360.0::DOUBLE / 255) + 0.5) AS BIGINT) % 255 AS x, CAST(floor(((d % 360) + 360) % 360 / (360.0::DOUBLE / 1023) + 0.5) AS BIGINT) % 1023 AS y
                    FROM (SELECT event_id, CASE WHEN k = 4 THEN NULL ELSE a + tws END AS d FROM ({POSITIONS}))))""",
    "quant_raw_compact": "SELECT event_id, event_id % 1023 + CASE WHEN event_id % 1023 >= 255 THEN 1 ELSE 0 END AS raw, event_id % 1023 AS compact FROM events",
    "quant_clip_detect": f"SELECT i, j, k, round(error, 6) AS error FROM (SELECT *, abs(9.5::DOUBLE + least(254, greatest(0, floor((v - 9.5::DOUBLE) / 0.01::DOUBLE + 0.5))) * 0.01::DOUBLE - v) AS error FROM ({NODES})) WHERE error > 0.01::DOUBLE + 1e-9",
    "block_layout": f"SELECT bi, bj, n, CAST(coalesce(sum(n) OVER (ORDER BY bi, bj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT i // 32 AS bi, j // 32 AS bj, count(*) AS n FROM ({NODES}) WHERE k = 0 GROUP BY ALL)",
    "sample_index": f"SELECT i, j, k, row_number() OVER (ORDER BY i // 32, j // 32, i, j, k) - 1 AS place FROM ({NODES})",
    "decode_error_bound": f"SELECT round(max(scale / 2), 9) AS u, round(max(scale), 9) AS v, round(sqrt(power(max(scale / 2), 2) + power(max(scale), 2)), 9) AS both FROM ({_blocks()})",
    "delta_encode": f"SELECT i, j, k, CAST((code - coalesce(lag(code) OVER (PARTITION BY i, j ORDER BY k), 0) + 256) % 256 AS INTEGER) AS delta FROM ({CODED})",
    "delta_decode": f"SELECT i, j, k, code FROM ({CODED})",
    "predict_med2d": f"WITH coded AS ({CODED}) SELECT i, j, k, CAST((code - ({MED}) + 512) % 256 AS INTEGER) AS residual FROM ({NEAR})",
    "predictors_entropy": f"""
        WITH coded AS ({CODED}), near AS ({NEAR}), rows AS (
            SELECT k, 'none' AS predictor, code FROM near UNION ALL SELECT k, 'temporal', (code - before + 256) % 256 FROM near
            UNION ALL SELECT k, 'left', (code - left_ + 256) % 256 FROM near UNION ALL SELECT k, 'med2d', (code - ({MED}) + 512) % 256 FROM near),
        shares AS (SELECT k, predictor, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY k, predictor) AS p FROM rows GROUP BY k, predictor, code)
        SELECT k, predictor, round(sum(-p * log2(p)), 6) AS bits FROM shares GROUP BY k, predictor""",
    "grid_lookup_scalar": f"SELECT event_id, round(CASE WHEN count(v) = count(*) THEN sum(w * v) END, 6) AS v FROM ({MET}) GROUP BY event_id",
    "grid_lookup_angle": f"""
        SELECT event_id, round((degrees(atan2(s, t)) % 360 + 360) % 360, 5) AS degrees
        FROM (SELECT event_id, CASE WHEN count(v) = count(*) THEN sum(w * sin(radians(v * 37))) END AS s, CASE WHEN count(v) = count(*) THEN sum(w * cos(radians(v * 37))) END AS t FROM ({MET}) GROUP BY event_id)""",
    "grid_lookup_wind": f"""
        SELECT event_id, round(sqrt(a * a + b * b), 6) AS kn, round(CASE WHEN a = 0 AND b = 0 THEN 180 ELSE (degrees(atan2(-a, -b)) % 360 + 360) % 360 END, 5) AS from_deg
        FROM (SELECT event_id, CASE WHEN count(v) = count(*) THEN sum(w * (v - 10)) END AS a, CASE WHEN count(v) = count(*) THEN sum(w * (j::DOUBLE / 7 - v / 3)) END AS b FROM ({MET}) GROUP BY event_id)""",
    "coastal_mask_lookup": f"""
        SELECT event_id, bool_or(coalesce(v > 14, true)) AS coastal FROM (SELECT DISTINCT event_id, i, j FROM ({CORNERS})) LEFT JOIN (SELECT i, j, v FROM ({NODES}) WHERE k = 0) USING (i, j) GROUP BY event_id""",
    "decode_all_at_step": f"SELECT i, j, round(CASE WHEN code <> 255 THEN low + code * scale END, 6) AS v FROM ({CODED}) WHERE k = 3",
    "observed_max_speed": f"SELECT k, round(max({_SPEED}), 6) AS kn FROM ({NODES}) GROUP BY k",
    "age_at": "SELECT event_id, greatest(0, event_id * 97 % 40000 - 2000) AS age_s, event_id * 97 % 40000 - 2000 > 21600 AS stale FROM events",
    "budget_estimate": "SELECT n_nationkey, CAST(raw AS BIGINT) AS raw_bytes, CAST(floor(raw * 0.5) AS BIGINT) AS packed_bytes FROM (SELECT n_nationkey, (n_nationkey + 1)::BIGINT * 60000 * (49 + n_nationkey % 3) * (1 + n_nationkey % 2) AS raw FROM nation)",
    "fill_mask": f"""
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nonFinite' WHEN event_id % 7 = 0 THEN 'fill' WHEN event_id % 5 = 0 AND tws * 20 > 150 THEN 'implausible' END AS cause,
               CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR (event_id % 5 = 0 AND tws * 20 > 150) THEN NULL WHEN event_id % 5 = 0 THEN round(tws * 20, 6) ELSE round(tws, 6) END AS value FROM ({POSITIONS})""",
    "member_assess": f"SELECT departure, round(m, 6) AS missing, m > 0.5 AS excluded FROM (SELECT departure, count(*) FILTER (beat_share > 0.45::DOUBLE)::DOUBLE / count(*) AS m FROM ({MEMBERS}) GROUP BY departure)",
    "sea_mask": f"SELECT i, j, bool_and(v IS NOT NULL) AS sea FROM ({NODES}) GROUP BY i, j",
    "unpack_int16": "SELECT event_id, round(CASE WHEN event_id % 9 <> 0 THEN (event_id * 37 % 6000 - 3000) * 0.001::DOUBLE * 3600 / 1852 END, 6) AS kn FROM events",
    "cell_size": f"""
        WITH g AS (SELECT i, j, 57 + i::DOUBLE / 10 + j::DOUBLE / 500 AS lat, 10 + j::DOUBLE / 5 AS lon FROM ({NODES}) WHERE k = 0)
        SELECT x.i, x.j, round(avg({_KM}), 6) AS km FROM g x JOIN g y ON abs(x.i - y.i) + abs(x.j - y.j) = 1 AND y.i BETWEEN x.i - 1 AND x.i + 1 GROUP BY x.i, x.j""",
    "match_time_steps": f"""
        WITH p AS (SELECT user_id, event_id, t // 60 * 60 AS step, t // 60 * 60 + event_id % 3 - 1 AS sec FROM ({POSITIONS})), f AS (SELECT user_id, sec, min(event_id) AS e FROM p GROUP BY user_id, sec)
        SELECT s.user_id, s.step, coalesce(a.e, b.e, d.e) AS source FROM (SELECT DISTINCT user_id, step FROM p) s
        LEFT JOIN f a ON a.user_id = s.user_id AND a.sec = s.step LEFT JOIN f b ON b.user_id = s.user_id AND b.sec = s.step - 1 LEFT JOIN f d ON d.user_id = s.user_id AND d.sec = s.step + 1""",
    "tile_of_point": f"SELECT event_id, CAST(floor(lon / 0.5) AS BIGINT) AS x, CAST(floor(lat / 0.25) AS BIGINT) AS y FROM ({POSITIONS})",
    "tiles_overlapping": f"""
        SELECT box, x, y FROM ({BOXES}), (SELECT unnest(range(30, 60)) AS x), (SELECT unnest(range(220, 250)) AS y)
        WHERE x BETWEEN floor(west / 0.25) AND floor(east / 0.25) AND y BETWEEN floor(south / 0.25) AND floor(north / 0.25)""",
    "block_split": """
        SELECT n_nationkey, r, q, CAST(least(32, n_nationkey * 7 + 5 - r) AS INTEGER) AS height, CAST(least(32, n_nationkey * 3 + 40 - q) AS INTEGER) AS width
        FROM nation, (SELECT unnest([0, 32, 64, 96, 128, 160]::INTEGER[]) AS r), (SELECT unnest([0, 32, 64, 96]::INTEGER[]) AS q) WHERE r < n_nationkey * 7 + 5 AND q < n_nationkey * 3 + 40""",
    "coastal_zone": f"SELECT event_id, CASE WHEN k <> 2 AND tws > 20 THEN 'open' ELSE 'coastal' END AS zone FROM ({POSITIONS})",
    "regrid_nn": f"""
        WITH x AS (SELECT id AS node, 57.5::DOUBLE + (id // 21)::DOUBLE / 10 AS lat, 10 + (id % 21)::DOUBLE / 10 AS lon FROM (SELECT unnest(range(0, 441)) AS id)),
        y AS (SELECT box AS source, (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM ({BOXES}) WHERE box % 3 <> 0)
        SELECT node, source, round(nm, 6) AS nm FROM (SELECT node, source, nm, row_number() OVER (PARTITION BY node ORDER BY round(nm, 9), source) AS r FROM (SELECT node, source, {_NM} AS nm FROM x, y) WHERE nm <= 12) WHERE r = 1""",
}
