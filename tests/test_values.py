"""Values worked out by hand, and operators that SQL does not express against a plainer way."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewright.functions import angles, seaway, sun, texts
from tidewright.operators import grid, routes


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_angles(spark):
    at = [F.lit(x) for x in (59.182, 10.855, 57.72, 10.58)]
    nm, course = one(spark, angles.distance_nm(*at), angles.bearing(*at))
    assert nm == pytest.approx(88.203, abs=5e-3) and course == pytest.approx(185.738, abs=1e-3)
    assert one(spark, angles.angle_between(F.lit(10.0), F.lit(350.0)), angles.angle_between(F.lit(0.0), F.lit(180.0)), angles.norm360(F.lit(-10.0)), angles.norm180(F.lit(190.0))) == (20, 180, 350, -170)


def test_tacks_and_codes(spark):
    assert one(spark, seaway.tack_penalty(F.lit(45.0), F.lit(315.0), F.lit(1), F.lit(-1))) == (90,)
    raw = [grid.to_raw(F.lit(x)) for x in (254, 255, 1022)]
    assert one(spark, *raw) == (254, 256, 1023)
    u, v = one(spark, seaway.wind_u(F.lit(10.0), F.lit(90.0)), seaway.wind_v(F.lit(10.0), F.lit(0.0)))
    assert (u, v) == (pytest.approx(-10), pytest.approx(-10))


def test_sun(spark):
    """At an equinox the day lasts a little over twelve hours; the sun stands at the horizon when it rises; the poles have days and nights."""
    equinox, winter = 1774008000, 1797854400
    at = (F.lit(59.0), F.lit(10.0))
    e = sun.events(*at, F.lit(equinox).cast("long"))
    rise, set_, up = one(spark, e["sunrise"], e["sunset"], sun.altitude(*at, e["sunrise"]))
    assert 12 * 3600 <= set_ - rise <= 12.5 * 3600 and up == pytest.approx(-0.833, abs=0.01)
    poles = [sun.events(F.lit(lat), F.lit(10.0), F.lit(winter).cast("long"))["polar"] for lat in (80.0, -80.0)]
    assert one(spark, *poles) == ("night", "day")


def test_fnv(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    words = ["", "a", "Ærø", "the quick brown fox"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", texts.fnv1a64(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in found} == {w: plain(w) for w in words}


def test_empty_and_missing(spark):
    steps = spark.createDataFrame([], "route long, seq long, t_s long, lat double, lon double, flags int")
    assert routes.legs(steps).count() == 0 and routes.totals(steps, {"motor": 1, "night": 2}).count() == 0
    nodes = spark.createDataFrame([(0, 0, 0, None), (0, 1, 0, 5.0)], "i long, j long, k long, v double")
    assert {(r.j, r.code) for r in grid.coded(nodes).collect()} == {(0, 255), (1, 0)}
    asked = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (2, 0.0, 0.5, 0.0), (3, 9.0, 0.0, 0.0)], "q long, fi double, fj double, fk double")
    found = grid.lookup(asked, nodes, {"i": "fi", "j": "fj", "k": "fk"}, "q", {"v": F.col("v")})
    assert {r.q: r.v for r in found.collect()} == {1: 5.0, 2: None, 3: None}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_daylight_within_of_every_event(spark, tmp_path):
    """Every event has a row, and the answer is that of a scan of the days before, in and after its span by the sun's events."""
    from datetime import datetime, timedelta

    from tidewright.plans import proxies, scalars

    rows = [(i, i * 7, "x", float(i), datetime(2024, 6, 1) + timedelta(hours=37 * i, minutes=13 * i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_id: r.any_light for r in scalars.daylight_any_in_window(spark, str(tmp_path)).collect()}
    day, margin = 86400, 3600
    spans = proxies.positions(spark, str(tmp_path)).select("event_id", (F.col("lat") + F.col("k")).alias("lat"), "lon", "t", (F.col("t") + F.col("k") * 3600).alias("until"))
    steps = spans.select("*", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1, 2)])).alias("step")).withColumn("at", F.col("t") + F.col("step") * day)
    expect = {i: False for i in range(40)}
    for r in steps.where("at <= until + 86400").withColumn("e", sun.events(F.col("lat"), F.col("lon"), F.col("at"))).collect():
        if r.e.polar == "day":
            expect[r.event_id] = True
        elif r.e.polar == "none":
            low, high = r.e.sunrise + margin, r.e.sunset - margin
            expect[r.event_id] |= low <= high and low <= r.until and high >= r.t
    assert found == expect and set(expect.values()) == {True, False}


def test_ranks_over_many_ranges(spark):
    """Departures are ranked without one task that holds them all."""
    from tidewright.operators import ensemble

    rows = [(d, d % 7 != 3, d * 13 % 5 + 20, None if d % 11 == 0 else d * 37 % 101, (d * 17 % 10) / 10, None if d % 5 else d) for d in range(3000)]
    summaries = spark.createDataFrame(rows, "departure long, complete boolean, n_f long, p90_s long, share double, control_s long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four ranges, not one
    try:
        found = ensemble.rank_departures(summaries)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.rdd.glom().filter(len).count() > 1

    def key(row):
        d, complete, n_f, p90, share, control = row
        late, bucket = 2**62 if p90 is None else p90, 2 if not complete else 0 if n_f >= 22 else 1
        by_time = late if bucket == 0 else math.inf if bucket == 1 else 2**62 if control is None else control
        return bucket, by_time, -share, late, d

    assert [r.departure for r in found.orderBy("rank").collect()] == [r[0] for r in sorted(rows, key=key)]
    assert sorted(r.rank for r in found.collect()) == list(range(1, 3001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert ensemble.rank_departures(summaries.limit(0)).count() == 0
