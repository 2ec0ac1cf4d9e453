"""Binary layers: the frame's bytes, round trips, pushed-down blocks and what a failed write leaves."""

import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import grid as G
from tidewright.sources import layers as L


def frame(rows=5, columns=7, side=3, steps=2, bits=8, delta=0, kind=0):
    return L.Frame(bits, 0, kind, delta, 57.0, 10.0, 0.1, 0.2, rows, columns, side, 1000.0, 3600.0, steps)


def test_header_and_lengths():
    f = frame()
    assert L.HEADER.size == 72 and f.blocks == (2, 3) and f.shape(1, 2) == (2, 1)
    assert f.length == 72 + 16 * 2 * 6 + 5 * 7 * 2 and frame(bits=10).length - f.length == 5 * 7 * 2
    with pytest.raises(ValueError, match="mark"):
        L.Frame.read(b"XXXX" + bytes(68))


@pytest.mark.parametrize(("bits", "delta", "kind"), [(8, 0, 0), (8, 1, 0), (10, 0, 0), (8, 0, 1)])
def test_frames_round_trip(bits, delta, kind):
    rng = np.random.default_rng(bits + delta)
    f = frame(bits=bits, delta=delta, kind=kind)
    codes = rng.integers(0, 2**bits, (5, 7, 2))
    scale, offset = rng.uniform(0, 1, (2, 3, 2)), rng.uniform(-5, 5, (2, 3, 2))
    data = L.frame_bytes(f, codes, scale, offset)
    assert len(data) == f.length and L.Frame.read(data[:72]) == f
    for bi in range(2):
        for bj in range(3):
            index, part = (data[at : at + n] for at, n in f.ranges(bi, bj))
            raw, value = L.block_of(f, bi, bj, index, part)
            own = codes[bi * 3 : bi * 3 + 3, bj * 3 : bj * 3 + 3]
            assert (raw == own).all() and (np.isnan(value) == (own == 255)).all()
            compact = np.where(own > 255, own - 1, own)
            expect = compact * 360 / (2**bits - 1) if kind else offset[bi, bj] + compact * scale[bi, bj]
            assert np.allclose(value[own != 255], expect[own != 255])
    two = io.BytesIO(data + data)
    two.size = lambda: len(data) * 2
    assert [(n, at) for n, at, _ in L.frames(two)] == [(0, 0), (1, f.length)]
    with pytest.raises(ValueError, match="eight"):
        L.frame_bytes(frame(bits=10, delta=1), codes, scale, offset)


def coded(spark, layers=("a", "b")):
    rng = random.Random(1)
    rows = [(i, j, k, None if rng.random() < 0.1 else rng.uniform(0, 30)) for i in range(40) for j in range(70) for k in range(3)]
    nodes = G.coded(spark.createDataFrame(rows, "i long, j long, k long, v double"))
    place = {"lat0": 57.0, "lon0": 10.0, "lat_step": 0.1, "lon_step": 0.2, "t0": 0.0, "dt": 3600.0}
    return nodes.withColumn("layer", F.explode(F.array(*map(F.lit, layers)))).withColumns({k: F.lit(v) for k, v in place.items()})


@pytest.mark.parametrize("delta", [False, True])
def test_written_layers_read_back(spark, tmp_path, delta):
    rows = coded(spark).checkpoint() if spark.sparkContext.getCheckpointDir() else coded(spark)
    L.write_layers(rows, str(tmp_path / "p"), delta=delta)
    back = L.read_layers(spark, str(tmp_path / "p"))
    assert back.select("file").distinct().count() == 2
    want = {(r.i, r.j, r.k): (r.code, r.offset + r.code * r.scale if r.code != 255 else None) for r in rows.where("layer = 'a'").collect()}
    got = {(r.i, r.j, r.k): (r.code, r.value) for r in back.where("file like 'a-%'").collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and (got[x][1] == pytest.approx(want[x][1]) if want[x][1] is not None else got[x][1] is None) for x in want)


def test_a_filter_on_a_block_reads_its_ranges_alone(spark, tmp_path):
    L.write_layers(coded(spark, ("a",)), str(tmp_path / "p"))
    asked = L.read_layers(spark, str(tmp_path / "p")).where("bi = 1 and bj in (0, 2) and k >= 1 and code < 200")
    whole = L.read_layers(spark, str(tmp_path / "p")).collect()
    assert sorted(map(tuple, asked.collect()), key=str) == sorted((tuple(r) for r in whole if r.bi == 1 and r.bj in (0, 2) and r.k >= 1 and r.code < 200), key=str)
    reader = L.LayerReader(str(tmp_path / "p"))
    left = list(reader.pushFilters([L.EqualTo(("bi",), 1), L.In(("bj",), (0, 2)), L.GreaterThan(("k",), 1), L.LessThan(("code",), 200)]))
    (part,) = reader.partitions()
    assert part.blocks == [(1, 0), (1, 2)] and left == [L.LessThan(("code",), 200)]
    (name,) = {x.file for x in reader.partitions()}
    f = L.Frame(*part.frame)
    data = bytearray(open(tmp_path / "p" / name, "rb").read())
    for bi in range(2):  # what is not asked for may be anything
        for bj in range(3):
            if (bi, bj) not in part.blocks:
                at, n = f.ranges(bi, bj)[1]
                data[at : at + n] = bytes(n)
    open(tmp_path / "p" / name, "wb").write(data)
    assert sum(len(x) for x in reader.read(part)) == 8 * (32 + 6)


def test_only_what_was_committed_is_read(spark, tmp_path):
    path = str(tmp_path / "p")
    assert L.read_layers(spark, path).count() == 0
    L.write_layers(coded(spark, ("a",)), path)
    os.mkdir(tmp_path / "q")
    (tmp_path / "p" / "half-0.mwl").write_bytes(b"MWL1")  # what a task that died has left
    broken = coded(spark, ("b", "c")).withColumn("k", F.when((F.col("layer") == "c") & (F.col("i") == 3), F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        L.write_layers(broken, path)
    names = {r.file[0] for r in L.read_layers(spark, path).select("file").distinct().collect()}
    assert names == {"a"}
    L.write_layers(coded(spark, ("d",)), path)
    assert {r.file[0] for r in L.read_layers(spark, path).select("file").distinct().collect()} == {"a", "d"}
    L.write_layers(coded(spark, ("e",)), path, mode="overwrite")
    assert {r.file[0] for r in L.read_layers(spark, path).select("file").distinct().collect()} == {"e"}


@pytest.mark.parametrize("delta", [False, True])
def test_a_large_layer_is_written_in_parts(spark, tmp_path, monkeypatch, delta):
    rows = coded(spark, ("a",)).withColumn("i", F.when(F.col("i") < 32, F.col("i")).otherwise(F.col("i") + 64))  # two rows of blocks without nodes
    L.write_layers(rows, str(tmp_path / "p"), delta=delta)
    monkeypatch.setattr(L, "PART", 32 * 70 * 3)
    L.write_layers(rows, str(tmp_path / "q"), delta=delta)
    whole, parts = (L.read_layers(spark, str(tmp_path / x)) for x in "pq")
    assert whole.select("file").distinct().count() == 1 and parts.select("file").distinct().count() == 4
    assert sorted(map(tuple, whole.drop("file").collect()), key=str) == sorted(map(tuple, parts.drop("file").collect()), key=str)
    assert whole.count() == 104 * 70 * 3 and whole.where("bi in (1, 2) and code <> 255").count() == 0
    asked = "bi in (2, 3) and bj = 1 and k = 2"
    assert sorted(map(tuple, whole.where(asked).drop("file").collect()), key=str) == sorted(map(tuple, parts.where(asked).drop("file").collect()), key=str)
    frames = sorted((x.first, x.frame) for x in L.LayerReader(str(tmp_path / "q")).partitions())
    assert [(first, L.Frame(*f).rows, round(L.Frame(*f).lat0, 9)) for first, f in frames] == [(0, 32, 57.0), (1, 32, 60.2), (2, 32, 63.4), (3, 8, 66.6)]
    assert all(L.Frame(*f).rows * L.Frame(*f).columns * L.Frame(*f).steps <= L.PART for _, f in frames)
