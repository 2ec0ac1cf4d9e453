"""Passage rules, charts, evaluation and streams on small frames with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import passage as V
from tidewright.operators import charts as C
from tidewright.operators import evaluation as E
from tidewright.streaming.running import run_to_end, running_summaries

c = F.col


def one(spark, **columns):
    return spark.range(1).select(*[x.alias(name) for name, x in columns.items()]).first()


def test_limits_and_bands(spark):
    def limit(tws, band, hs):
        return V.hard_limit(F.lit(tws), F.lit(band), F.lit(hs).cast("double"), 15.0, 2.0)

    row = one(spark, calm=limit(15.0, 0.0, None), band=limit(14.6, 0.5, 1.0), waves=limit(10.0, 0.0, 2.01), both=limit(16.0, 0.0, 9.0), field=V.guard_band(F.lit(-0.1), F.lit(0.7)), own=V.guard_band(F.lit(0.0), F.lit(0.7)))
    assert tuple(row) == ("ok", "tws", "hs", "tws", 0.7, 0.0)


def test_kinematics(spark):
    def step(heading, tws, u, v, below=2.0, motor=5.0, hs=None):
        args = [F.lit(x).cast("double") for x in (60.0, 10.0, heading, 180.0, tws, hs, None, u, v)]
        return F.struct(*[x.alias(n) for n, x in V.kinematics(*args, 3600, below, motor).items()])

    row = one(spark, head=step(180, 10, 0, 0), drift=step(180, 10, 5, 0), still=step(180, 0, 0, 0, 2.0, 0.0), against=step(180, 10, 0, 5), beam=step(90, 10, None, None, hs=1.0))
    assert row["head"].motor and row["head"].bsp == 5.0 and row["head"].next_lat == pytest.approx(60 - 5 / 60)
    assert row["drift"].sog == pytest.approx(math.hypot(5, 5)) and row["drift"].course == pytest.approx(135)
    assert row["still"].sog is None and row["still"].next_lat is None and row["against"].sog is None  # a current that holds the boat
    assert row["beam"].twa == 90 and not row["beam"].motor and row["beam"].next_lon > 10


def test_bounds(spark):
    def reach(bound, vmax, slack=None, margin=None):
        return V.reach_nm(*[F.lit(x).cast("double") for x in (bound, vmax, slack, margin)])

    row = one(spark, plain=reach(3600, 10), own=reach(3600, 10, 1.0, 0.0), none=reach(None, 10), still=reach(3600, 0), near=V.field_bound_nm(F.lit(1.0), 0.05, 60.0), far=V.field_bound_nm(F.lit(100.0), 0.05, 60.0))
    assert row.plain == pytest.approx(1.09 * 10 * 1.25) and row.own == 10 and row.none is None and row.still is None and row.near == 0
    assert row.far == pytest.approx(100 / math.sqrt(4 - 2 * math.sqrt(2)) - 2 * math.hypot(3, 1.5))
    gates = one(spark, a=V.depth_gate(F.lit(None).cast("double"), F.lit(3.0), F.lit(2.0)), b=V.depth_gate(F.lit(5.0), F.lit(1.0), F.lit(2.0)), c=V.depth_gate(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(2.0)))
    assert tuple(gates) == ("ok", "shallow", "missing")


AREAS = "box long, south double, north double, west double, east double, kind string, depth double, quality string"


def test_point_verdicts(spark):
    def area(box, lon, kind, depth=None, quality=None, width=0.1):
        return (box, 58.0, 58.1, lon, lon + width, kind, depth, quality)

    areas = [
        area(1, 10.0, "dry"), area(2, 10.2, "shoal"), area(3, 10.4, "shoal", 9.0), area(4, 10.6, "band", 4.0), area(5, 10.8, "fairway"), area(6, 11.0, "quality", None, "B"), area(7, 11.0, "guard"),
        area(8, 11.2, "quality", None, "C"), area(9, 10.8, "air", 3.0), area(10, 11.4, "band", 20.0), area(11, 11.6, "season"), area(12, 11.8, "quality", None, "A1"),
    ]
    points = spark.createDataFrame([(i, 58.05, 10.05 + i * 0.2) for i in range(11)], "p long, lat double, lon double")
    found = {r.p: (r.trust, r.reasons) for r in C.point_verdicts(points, spark.createDataFrame(areas, AREAS), "p", {"depth": 4.0, "air": 6.0}, 0.1).collect()}
    far = "utenfor-farled-lav-tetthet"
    assert found == {
        0: ("no-go", ["torrfall"]), 1: ("no-go", ["skjaer-buffer"]), 2: ("usikkert", [far]), 3: ("no-go", ["grunnere-enn-sikkerhetskontur"]), 4: ("usikkert", ["for-lav-luftspenn"]),
        5: ("usikkert", ["usikker-sondering-i-baand"]), 6: ("usikkert", ["lav-datakvalitet"]), 7: ("usikkert", [far]), 8: ("usikkert", [far, "vernesone-aktiv"]), 9: ("trygt", []), 10: ("usikkert", [far]),
    }
    # without a band that is deep enough there is no contour, so no band blocks
    shallow = spark.createDataFrame([area(1, 10.6, "band", 3.0)], AREAS)
    assert C.point_verdicts(points.where("p = 3"), shallow, "p", {"depth": 4.0, "air": 6.0}, 0.1).first().trust == "usikkert"


def test_chords_and_rings(spark):
    def square(box, x, y, size):
        ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
        return (box, y, y + size, x, x + size, ring)

    rings = spark.createDataFrame([square(1, 10.0, 58.0, 1.0), square(2, 11.0, 58.0, 1.0), square(3, 20.0, 58.0, 0.1)], "box long, south double, north double, west double, east double, ring array<struct<x:double,y:double>>")
    chords = [(1, 58.5, 10.2, 58.5, 10.8), (2, 58.5, 10.5, 58.5, 11.5), (3, 57.0, 9.0, 57.0, 9.5), (4, 57.9, 10.5, 58.2, 10.5), (5, 58.5, 9.0, 58.5, 13.0)]
    rows = spark.createDataFrame(chords, "k long, lat double, lon double, lat2 double, lon2 double")
    assert {tuple(r) for r in C.segments_hit(rows, rings, "k", 0.5).collect()} == {(1, 1), (2, 1), (2, 2), (4, 1), (5, 1), (5, 2)}
    # the second has both ends within, but crosses the edge where the rings adjoin
    assert {r.k for r in C.segments_within(rows, rings, "k", 0.5).collect()} == {1}


def test_tiles_along(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 3.5), (2, 0.5, 0.5, 2.5, 2.5), (3, 0.2, 0.2, 0.2, 0.2), (4, 0.9, 0.5, 1.1, 2.5)], "k long, lat double, lon double, lat2 double, lon2 double")
    found = {}
    for r in C.along_tiles(rows, "k", 1.0, 1.0).collect():
        found.setdefault(r.k, set()).add((r.x, r.y))
    # a chord through the corners passes only the tiles on the diagonal
    assert found == {1: {(0, 0), (1, 0), (2, 0), (3, 0)}, 2: {(0, 0), (1, 1), (2, 2)}, 3: {(0, 0)}, 4: {(0, 0), (1, 0), (1, 1), (2, 1)}}


def test_evaluation_and_positions(spark):
    steps = spark.createDataFrame([(1, s, s * 600, 58.0 + s, 10.0) for s in range(4)] + [(2, 0, 0, 50.0, 5.0)], "route long, seq long, t_s long, lat double, lon double")
    found = {r.route: tuple(r)[1:] for r in E.first_rejections(steps, [("noWeather", c("t_s") > 1500), ("point", c("lat") >= 60)]).collect()}
    assert found == {1: (2, "point", 1200, True), 2: (1, None, 0, False)}
    asked = spark.createDataFrame([(1, -5), (1, 0), (1, 900), (1, 1800), (1, 9999), (2, 77), (3, 1)], "route long, at_s long")
    assert {(r.route, r.at_s): r.lat for r in E.position_at(steps, asked).collect()} == {(1, -5): 58.0, (1, 0): 58.0, (1, 900): 59.5, (1, 1800): 61.0, (1, 9999): 61.0, (2, 77): 50.0}


def test_running_summaries(spark, tmp_path):
    schema, kinds = "departure long, kind string, daylight boolean", ["infeasible"] * 4 + ["feasible"] * 3 + ["error", "inconclusive", "infeasible"]
    for n, kind in enumerate(kinds):
        spark.createDataFrame([(1, kind, True), (2, "feasible", n % 2 == 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    found = {r.departure: tuple(r)[1:] for r in run_to_end(running_summaries(stream, 10), f"{tmp_path}/out").collect()}
    assert found == {1: (3, 5, 1, 1, 3, "rod/andel"), 2: (10, 0, 0, 0, 5, "gul/tid")}
    assert len(list((tmp_path / "out" / "batches").iterdir())) > 2
    warned = [r.certificate for r in spark.read.parquet(f"{tmp_path}/out/batches/*").where("departure = 1").orderBy("batch").collect()]
    assert warned == sorted(warned, key=lambda x: x is not None)  # once given, never taken back


def test_front_of_hot_keys(spark):
    """Dealt into parts, a key has the same front."""
    import random

    from tidewright.operators.routes import front

    rng = random.Random(2)
    rows = [(i % 3, rng.randrange(30), rng.randrange(30), rng.randrange(30)) for i in range(240)] + [(9, 1, 1, 1), (9, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "k long, a long, b long, c long")
    expect = sorted(r for r in rows if not any(o[0] == r[0] and o != r and all(x <= y for x, y in zip(o[1:], r[1:], strict=True)) for o in rows))
    for most in (10_000, 7):
        assert sorted(tuple(r) for r in front(frame, "k", ["a", "b", "c"], most).collect()) == expect
