"""Things alike are looked at once: results stay those of every single one."""

import math

from pyspark.sql import functions as F

from tidewright.functions import sun
from tidewright.functions.angles import point_segment_nm
from tidewright.operators import charts as C
from tidewright.operators import corridors as K
from tidewright.operators import grid as G
from tidewright.operators import overlay as O
from tidewright.operators import rings as R
from tidewright.operators import spatial as P
from tidewright.plans import voyage
from tidewright.plans.charting import once
from tidewright.plans.proxies import positions

RING = "array(struct(0.0D AS x, 0.0D AS y), struct(1.0D AS x, 0.0D AS y), struct(1.0D AS x, 1.0D AS y), struct(0.0D AS x, 1.0D AS y))"


def squares(spark, n):
    """n rings at each of two places, the second one 3 to the east."""
    move = F.transform("ring", lambda p: F.struct((p["x"] + F.col("id") % 2 * 3).alias("x"), p["y"].alias("y")))
    return spark.range(n * 2).withColumn("ring", F.expr(RING)).select(F.col("id").alias("box"), move.alias("ring"))


def test_flags_of_segments_come_from_every_copy_of_a_ring(spark):
    rows = [(1, 0.5, 0.5, 0.6, 0.6), (2, 0.5, -1.0, 0.5, 2.0), (3, 5.0, 5.0, 6.0, 6.0), (4, 0.5, 3.5, 5.0, 3.5), (5, 5.0, 3.5, 0.5, 3.5), (6, 0.5, 0.5, 0.6, 0.6)]
    segments = spark.createDataFrame(rows, "leg int, lat double, lon double, lat2 double, lon2 double")
    flags = {"west": F.col("box") == 18, "east": F.col("box") == 19}
    found = C.segments_flagged(segments, squares(spark, 10), "leg", 0.7, flags)
    assert sorted(map(tuple, found.collect())) == [(1, True, False), (2, True, False), (3, False, False), (4, False, True), (5, False, True), (6, True, False)]
    hit = C.segments_hit(segments, squares(spark, 10), "leg", 0.7).groupBy("leg").count()
    assert sorted(map(tuple, hit.collect())) == [(1, 10), (2, 10), (4, 10), (5, 10), (6, 10)]


def test_points_in_rings_alike_meet_every_copy(spark):
    rings = squares(spark, 10).selectExpr("*", "ring[0].y AS south", "ring[2].y AS north", "ring[0].x AS west", "ring[1].x AS east")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 0.5, 3.5), (4, 9.0, 9.0), (5, None, 0.5)], "id int, lat double, lon double")
    shapes = P.alike(rings, ["south", "north", "west", "east", "ring"], "box")
    assert sorted((r.box, sorted(r.copies)) for r in shapes.collect()) == [(0, list(range(0, 20, 2))), (1, list(range(1, 20, 2)))]
    found = P.contained(points.select("lat", "lon").distinct(), shapes, 0.7)
    assert found.count() == 2  # of places and shapes, not of points and rings
    pairs = P.at_places(points, found, ["copies"]).select("id", F.explode("copies").alias("box"))
    assert sorted(map(tuple, pairs.collect())) == sorted((i, b) for i, odd in ((1, 0), (2, 0), (3, 1)) for b in range(odd, 20, 2))
    inner = spark.createDataFrame([(1, 0.5, 0.5, 0.6, 0.6), (2, 0.5, 0.5, 0.5, 3.5), (3, 0.5, 0.5, 5.0, 0.5)], "k int, lat double, lon double, lat2 double, lon2 double")
    assert [tuple(r) for r in C.segments_within(inner, rings, "k", 0.7).collect()] == [(1,)]


def test_areas_of_the_same_bounds_add_up(spark):
    kinds = [(1, "band", None, "U"), (4, "band", 6.5, "U"), (2, "band", 4.5, "U"), (3, "quality", None, "A1"), (5, "air", 5.0, "U"), (6, "band", 9.5, "U")]
    areas = spark.createDataFrame([(b, 0.0, 1.0, 0.0, 1.0, *k) for b, *k in kinds], "box int, south double, north double, west double, east double, kind string, depth double, quality string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (3, None, 0.5)], "id int, lat double, lon double")
    chords = points.where("lat is not null").selectExpr("*", "lat + 0.1D AS lat2", "lon AS lon2")
    need = {"depth": 4.0, "air": 6.0}
    shallow, outside = ("no-go", ["grunnere-enn-sikkerhetskontur", "for-lav-luftspenn"]), ("usikkert", ["utenfor-farled-lav-tetthet"])
    found = {r.id: (r.trust, r.reasons) for r in C.point_verdicts(points, areas, "id", need, 0.7).collect()}
    assert found == {1: shallow, 2: shallow, 3: outside}
    assert {r.id: (r.trust, r.reasons) for r in C.segment_verdicts(chords, areas, "id", need, 0.7).collect()} == {1: shallow, 2: shallow}


def test_nearest_of_sources_at_one_place_is_the_least(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id int, lat double, lon double")
    sources = spark.createDataFrame([(9, 0.1, 0.0), (7, 0.1, 0.0), (8, -0.1, 0.0), (3, 0.15, 0.0)], "s int, lat2 double, lon2 double")
    assert sorted((r.id, r.s) for r in P.nearest(points, sources, "id", "s", 12.0).collect()) == [(1, 7), (2, 7)]


def test_nodes_are_never_broadcast(spark, capsys):
    nodes = spark.createDataFrame([(i, j, k, float(i + j + k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)], "i long, j long, k long, v double")
    found = G.lookup(spark.createDataFrame([(1, 0.5, 0.5, 0.0)], "q int, fi double, fj double, fk double"), nodes, {"i": "fi", "j": "fj", "k": "fk"}, "q", {"v": F.col("v")})
    assert [tuple(r) for r in found.collect()] == [(1, 1.0)]
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_distances_have_the_last_digit_of_a_root_of_squares(spark):
    rows = [(i, (i * 37 % 200) / 100, (i * 91 % 200) / 100) for i in range(500)]
    frame = spark.createDataFrame(rows, "i int, y double, x double").withColumn("nm", point_segment_nm(F.col("y"), F.col("x"), *[F.lit(0.0)] * 5))
    for _, y, x, nm in frame.collect():
        assert nm == math.sqrt((x * 60) * (x * 60) + (y * 60) * (y * 60))


def test_alerts_come_for_every_copy_of_a_ring(spark):
    steps = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 0.5, 0.6), (2, 0, 9.0, 9.0)], "route int, seq int, lat double, lon double")
    assert sorted((r.route, r.box, r.nm) for r in K.alerts_near(steps, squares(spark, 3), "box", 0.1).collect()) == [(1, 0, 0.0), (1, 2, 0.0), (1, 4, 0.0)]


def test_rings_are_looked_through_whole_for_crossings(spark, monkeypatch):
    bow = "array(struct(0.0D AS x, 0.0D AS y), struct(1.0D AS x, 1.0D AS y), struct(1.0D AS x, 0.0D AS y), struct(0.0D AS x, 1.0D AS y))"
    rings = squares(spark, 2).unionByName(spark.range(1).selectExpr("9L AS box", f"{bow} AS ring"))
    edges = R.ring_edges(rings, ["box"])
    assert [r.box for r in O.kinks(edges, ["box"]).collect()] == [9]
    monkeypatch.setattr(O, "WHOLE", 3)  # all are long ones, dealt to tiles
    assert [r.box for r in O.kinks(edges, ["box"]).collect()] == [9]


def test_areas_with_one_ring_are_laid_out_once(spark):
    rings = squares(spark, 4).selectExpr("box AS area", "ring", "0 AS chart")
    assert sorted(r.area for r in once(rings, ["chart"]).collect()) == [0, 1]


def test_sun_of_a_batch_is_the_sun_of_each(spark):
    rows = spark.range(40).selectExpr("CAST(id * 4 - 75 AS DOUBLE) AS lat", "CAST(id * 7 % 360 - 180 AS DOUBLE) AS lon", "1704067200 + id * 9 * 86400 AS day")
    for r in sun.with_events(rows).withColumn("one", sun.events(F.col("lat"), F.col("lon"), F.col("day"))).collect():
        assert r.e.polar == r.one.polar and (r.e.sunrise is None) == (r.one.sunrise is None)
        assert r.e.sunrise is None or (abs(r.e.sunrise - r.one.sunrise) < 1e-3 and abs(r.e.sunset - r.one.sunset) < 1e-3)


def test_chords_meet_areas_alike_once(spark, monkeypatch):
    kinds = [(1, "fairway", None, "U"), (2, "quality", None, "D"), (3, "air", 5.0, "U"), (4, "season", None, "U"), (5, "band", 6.5, "U"), (6, "shoal", None, "U")]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    areas = spark.createDataFrame([(b + n * 10, k, d, q, ring if b < 6 else [(x + 3, y) for x, y in ring]) for b, k, d, q in kinds for n in range(3)], "box long, kind string, depth double, quality string, ring array<struct<x: double, y: double>>")
    rows = [(1, 0.5, 0.5, 0.6, 0.6), (2, 0.5, 0.5, 0.6, 0.6), (3, 0.5, 0.5, 0.5, 2.0), (4, 5.0, 5.0, 5.0, 6.0), (5, 0.5, 2.5, 0.5, 4.5), (6, 0.5, 0.5, None, None)]
    chords = spark.createDataFrame(rows, "id int, lat double, lon double, lat2 double, lon2 double")
    seen, plain = [], C.edges_crossed
    monkeypatch.setattr(C, "edges_crossed", lambda ways, index, *rest: seen.append((ways.count(), index.where("ax is not null").select("box").distinct().count())) or plain(ways, index, *rest))
    found = {r.id: (r.trust, r.reasons) for r in C.chart_chords(chords, areas, "id", {"depth": 4.0, "air": 6.0}, R.Tiles(0.7)).collect()}
    low, shallow = ["for-lav-luftspenn", "vernesone-aktiv"], "grunnere-enn-sikkerhetskontur"
    assert found == {1: ("no-go", [shallow, *low]), 2: ("no-go", [shallow, *low]), 3: ("no-go", [shallow, *low]), 4: ("usikkert", ["utenfor-farled-lav-tetthet"]), 5: ("no-go", ["skjaer-buffer"]), 6: ("no-go", [shallow, *low])}
    assert seen == [(5, 2)]  # chords and areas unlike


def test_routes_through_the_same_places_are_met_once(spark, monkeypatch):
    rows = [(r, i, lat, lon) for r, way in ((1, [(0.5, 0.5), (0.5, 0.6)]), (2, [(0.5, 0.6), (0.5, 0.5)]), (3, [(0.5, 1.04), (0.5, 1.06)]), (4, [(9.0, 9.0)])) for r in (r, r + 10, r + 20) for i, (lat, lon) in enumerate(way)]
    steps = spark.createDataFrame(rows, "route int, seq int, lat double, lon double")
    seen, plain = [], K.stretches
    monkeypatch.setattr(K, "stretches", lambda steps, *rest: seen.append(steps.select("route").distinct().count()) or plain(steps, *rest))
    found = K.alerts_near(steps, squares(spark, 3), "box", 0.1).collect()
    assert seen == [4]
    assert sorted((r.route, r.box) for r in found) == sorted((r + n, b) for r in (1, 2, 3) for n in (0, 10, 20) for b in (0, 2, 4))
    assert all((r.nm == 0) == (r.route % 10 < 3) for r in found) and len({r.nm for r in found if r.route % 10 == 3}) == 1


def test_masked_segments_come_by_place(spark):
    sf = "/root/testdata/sf0.001"
    order = {}
    for r in voyage.rect_mask_segments(spark, sf).select("event_id", F.spark_partition_id().alias("task")).collect():
        order.setdefault(r.task, []).append(r.event_id)
    place = {r.event_id: (r.lat, r.lon) for r in positions(spark, sf).select("event_id", "lat", "lon").collect()}
    assert order and all([place[e] for e in events] == sorted(place[e] for e in events) for events in order.values())
