"""The GML source on a small document."""

from pyspark.sql import functions as F

from tidewright.sources import gml

DOCUMENT = """<?xml version="1.0"?><gml:FeatureCollection xmlns:gml="g" xmlns:app="a">
<gml:featureMember><app:Dybde gml:id="d1"><app:dybde uom="m">5.5</app:dybde><app:omrade><gml:Polygon>
<gml:exterior><gml:LinearRing><gml:posList>58 10 58 11 59 11 58 10</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList srsDimension="2">58.1 10.1
 58.1 10.2 x 3 9</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></app:omrade></app:Dybde></gml:featureMember>
<gml:featureMember><app:Dybde gml:id="d2"><app:dybde>none</app:dybde><app:pos><gml:Point><gml:pos>60.5 5.25</gml:pos></gml:Point></app:pos></app:Dybde></gml:featureMember>
<gml:featureMember><app:Other gml:id="o"><app:dybde>1</app:dybde></app:Other></gml:featureMember></gml:FeatureCollection>"""


def test_features(spark, tmp_path):
    (tmp_path / "a.gml").write_text(DOCUMENT)
    (tmp_path / "b.gml").write_text(DOCUMENT.replace("d1", "d3").replace("d2", "d4"))
    found = {r.id: r for r in gml.features(spark, str(tmp_path), "app:Dybde", {"dybde": "double", "kilde": "string"}).collect()}
    assert set(found) == {"d1", "d2", "d3", "d4"}
    ring, hole = ([tuple(p) for p in x] for x in found["d1"].rings)
    assert ring == [(10.0, 58.0), (11.0, 58.0), (11.0, 59.0), (10.0, 58.0)] and hole == [(10.1, 58.1), (10.2, 58.1)]
    assert found["d1"].closed == [True, False] and found["d1"].dybde == 5.5
    assert [[tuple(p) for p in x] for x in found["d4"].rings] == [[(5.25, 60.5)]] and found["d2"].dybde is None


def test_odd_positions(spark):
    rows = spark.createDataFrame([("",), (None,), ("1",), (" 1  2\t3 ",), ("a b 1 2",)], "t string")
    assert [[tuple(p) for p in r.p] for r in rows.select(F.coalesce(gml.positions(F.col("t")), F.array().cast("array<struct<x:double,y:double>>")).alias("p")).collect()] == [[], [], [], [(2.0, 1.0)], [(2.0, 1.0)]]


def test_forecasts(spark):
    import json

    from tidewright.sources.forecast import forecasts

    def body(entries, place=(10.5, 58.25), **meta):
        rows = [{"time": t, "data": {"instant": {"details": {"sea_surface_wave_height": h, "sea_surface_wave_from_direction": 90}}}} for t, h in entries]
        return json.dumps({"geometry": {"coordinates": list(place)}, "properties": {"meta": meta, "timeseries": rows}})

    rising = body([("2026-01-01T00:00:00Z", 1.5), ("2026-01-01T02:00:00Z", None), ("2026-01-01T01:00:00Z", 9.0), ("2026-01-01T02:00:00Z", 9.0), ("2026-01-01T03:00:00Z", 2)])
    cases = [
        ("rising", rising), ("bare", '{"properties":{"timeseries":[{"time":"2026-01-01T00:00:00Z"}]}}'), ("none", body([])), ("land", body([("2026-01-01T00:00:00Z", 1.0)], error="no data at the given location")),
        ("moment", body([("noon", 1.0)])), ("series", '{"properties":{}}'), ("text", "not a document"), ("null", None), ("empty", ""),
    ]
    found = {r.key: r for r in forecasts(spark.createDataFrame(cases, "key string, body string"), "key").collect()}
    assert {k: r.status for k, r in found.items()} == {"rising": "ok", "bare": "ok", "none": "no-data", "land": "no-data", "moment": "failed", "series": "failed", "text": "failed", "null": "failed", "empty": "failed"}
    start = 1767225600
    assert [(t.epoch_s - start, t.hs) for t in found["rising"].times] == [(0, 1.5), (7200, None), (10800, 2.0)] and (found["rising"].source_lat, found["rising"].source_lon) == (58.25, 10.5)
    assert [(t.hs, t.from_deg) for t in found["bare"].times] == [(None, None)] and found["bare"].source_lat is None
    assert all(found[k].times == [] for k in ("none", "land", "moment", "null"))
    assert forecasts(spark.createDataFrame([], "key string, body string"), "key").count() == 0
