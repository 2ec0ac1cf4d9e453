"""Quantised layers in binary files, as a data source of Spark's: format("layers"), option("path", folder).

A file holds frames one after the other. A frame is a header, the scale and offset of each block and step, and the codes block by block, of each
node in row order all its steps. So a block's parameters and codes are two ranges of the file, and a reader seeks to the blocks that are asked for:
filters on file, frame, bi and bj choose ranges, one on k chooses steps of what was read. A frame coded as differences in time is read the same
way, as its differences run along a node's own steps.

Writing takes rows dealt by layer and part (see write_layers). A part is some whole rows of blocks of a layer and a file of its own, a smaller layer at its
own place. Each task writes its parts under names of its own, and the commit puts them into the folder's manifest with their first row of blocks;
readers go by it. What a task that failed or ran twice has left is in no manifest; an aborted write takes its files away.
"""

from __future__ import annotations

import json
import operator
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: The mark and the header of a frame: bits, rounding, kind and differences; place, steps in degrees, nodes, nodes of a block's side, first step, seconds a step, steps.
MAGIC, HEADER = b"MWL1", struct.Struct("<4sBBBBddddIIIddI")
ROUNDINGS, KINDS, SENTINEL = ["nearest", "up", "down"], ["linear", "angle"], 255
MANIFEST = "_layers.json"
#: Blocks that one task reads at most.
BLOCKS = 64
#: Nodes of a part at most, unless one row of blocks has more. A task holds the codes of one part.
PART = 1 << 19
SCHEMA = "file string, frame int, bi int, bj int, i int, j int, k int, code int, value double"
ROWS = "layer string, i long, j long, k long, code int, scale double, offset double, lat0 double, lon0 double, lat_step double, lon_step double, t0 double, dt double"


class Frame(NamedTuple):
    """A frame's header."""

    bits: int
    rounding: int
    kind: int
    delta: int
    lat0: float
    lon0: float
    lat_step: float
    lon_step: float
    rows: int
    columns: int
    side: int
    t0: float
    dt: float
    steps: int

    @staticmethod
    def read(data: bytes) -> Frame:
        magic, *rest = HEADER.unpack(data)
        if magic != MAGIC:
            raise ValueError(f"{magic!r} isn't the mark of a layer")
        return Frame(*rest)

    @property
    def width(self) -> int:
        return 1 if self.bits <= 8 else 2

    @property
    def blocks(self) -> tuple[int, int]:
        return -(-self.rows // self.side), -(-self.columns // self.side)

    def shape(self, bi: int, bj: int) -> tuple[int, int]:
        """Rows and columns of a block; those at the end are cut off."""
        return min(self.side, self.rows - bi * self.side), min(self.side, self.columns - bj * self.side)

    def ranges(self, bi: int, bj: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """(begin, bytes) of a block's parameters and of its codes, from the frame's begin. Blocks before it fill whole bands of rows, and in its own band whole columns."""
        high, wide = self.shape(bi, bj)
        down, across = self.blocks
        before = bi * self.side * self.columns + high * bj * self.side
        index, codes = HEADER.size, HEADER.size + 16 * self.steps * down * across
        return (index + 16 * self.steps * (bi * across + bj), 16 * self.steps), (codes + before * self.steps * self.width, high * wide * self.steps * self.width)

    @property
    def length(self) -> int:
        down, across = self.blocks
        return HEADER.size + 16 * self.steps * down * across + self.rows * self.columns * self.steps * self.width


def frame_bytes(frame: Frame, codes: np.ndarray, scale: np.ndarray, offset: np.ndarray) -> bytes:
    """codes: (row, column, step); scale and offset: (block row, block column, step)."""
    if frame.delta and frame.bits > 8:
        raise ValueError("only codes of eight bits are written as differences")
    down, across = frame.blocks
    index = np.stack([scale, offset], axis=3).astype("<f8").tobytes()
    parts = (codes[bi * frame.side : (bi + 1) * frame.side, bj * frame.side : (bj + 1) * frame.side] for bi in range(down) for bj in range(across))
    if frame.delta:
        parts = (np.diff(x.astype(np.int64), axis=2, prepend=0) % 256 for x in parts)
    return HEADER.pack(MAGIC, *frame) + index + b"".join(np.ascontiguousarray(x).astype(f"<u{frame.width}").tobytes() for x in parts)


def block_of(frame: Frame, bi: int, bj: int, index: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, values), each (row, column, step), of a block's two ranges; NaN where there is no value."""
    high, wide = frame.shape(bi, bj)
    raw = np.frombuffer(codes, f"<u{frame.width}").reshape(high, wide, frame.steps).astype(np.int32)
    if frame.delta:
        raw = np.cumsum(raw, axis=2) % 256
    scale, offset = np.frombuffer(index, "<f8").reshape(frame.steps, 2).T
    compact = np.where(raw > SENTINEL, raw - 1, raw)
    value = compact * (360 / (2**frame.bits - 1)) if frame.kind else offset + compact * scale
    return raw, np.where(raw == SENTINEL, np.nan, value)


def filesystem(folder: str):
    """(file system, folder in it) for a path or a URI that Arrow knows."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    return store, root.rstrip("/")


def listed(store, root: str) -> dict[str, int]:
    """The files of the manifest, and which row of blocks each begins with. A list, as folders written before have it, is of whole layers."""
    from pyarrow import fs

    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return {}
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        names = json.loads(file.read())
    return names if isinstance(names, dict) else dict.fromkeys(names, 0)


def frames(file) -> Iterator[tuple[int, int, Frame]]:
    """(number, begin, header) of a file's frames; each header tells how long its frame is, so no more than headers are read."""
    at = number = 0
    while at < file.size():
        file.seek(at)
        frame = Frame.read(file.read(HEADER.size))
        yield number, at, frame
        at, number = at + frame.length, number + 1


@dataclass
class Blocks(InputPartition):
    file: str
    number: int
    begin: int
    frame: tuple
    first: int
    blocks: list[tuple[int, int]]


COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


class LayerReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in COMPARE and f.attribute in (("file",), ("frame",), ("bi",), ("bj",), ("k",)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def fits(self, **known) -> bool:
        return all(COMPARE[kind](known[name], value) for name, kind, value in self.filters if name in known)

    def partitions(self) -> list[Blocks]:
        store, root = filesystem(self.path)
        out = []
        for name, first in listed(store, root).items():
            if not self.fits(file=name):
                continue
            with store.open_input_file(f"{root}/{name}") as file:
                for number, begin, frame in frames(file):
                    down, across = frame.blocks
                    asked = [(bi, bj) for bi in range(first, first + down) for bj in range(across) if self.fits(frame=number, bi=bi, bj=bj)]
                    out += [Blocks(name, number, begin, tuple(frame), first, asked[lo : lo + BLOCKS]) for lo in range(0, len(asked), BLOCKS)]
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark says that there are no partitions
            return
        store, root = filesystem(self.path)
        frame = Frame(*partition.frame)
        steps = np.array([k for k in range(frame.steps) if self.fits(k=k)], np.int64)
        with store.open_input_file(f"{root}/{partition.file}") as file:
            for bi, bj in partition.blocks:
                index, codes = (file.read_at(n, partition.begin + at) for at, n in frame.ranges(bi - partition.first, bj))
                raw, value = (x[:, :, steps] for x in block_of(frame, bi - partition.first, bj, index, codes))
                i, j, k = (x.ravel() for x in np.meshgrid(np.arange(raw.shape[0]) + bi * frame.side, np.arange(raw.shape[1]) + bj * frame.side, steps, indexing="ij"))
                n, flat = len(i), value.ravel()
                same = [pa.array(np.full(n, x, np.int32)) for x in (partition.number, bi, bj)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * n, pa.string()), *same, *(pa.array(x.astype(np.int32)) for x in (i, j, k, raw.ravel())), pa.array(flat, mask=np.isnan(flat))],
                    names=["file", "frame", "bi", "bj", "i", "j", "k", "code", "value"],
                )


class Part:
    """A part of a layer that is being written: its codes, and the scale and offset of each block and step."""

    def __init__(self, layer: str | None, first: int, frame: Frame) -> None:
        self.layer, self.first, self.frame = layer, first, frame
        self.codes = np.full((frame.rows, frame.columns, frame.steps), SENTINEL, f"<u{frame.width}")
        self.index = {name: np.zeros((*frame.blocks, frame.steps)) for name in ("scale", "offset")}

    def put(self, rows: pa.RecordBatch) -> None:
        i, j, k = (rows.column(x).to_numpy() for x in "ijk")
        self.codes[i, j, k] = rows.column("code").to_numpy()
        for name, values in self.index.items():
            values[i // self.frame.side, j // self.frame.side, k] = np.nan_to_num(rows.column(name).to_numpy(zero_copy_only=False).astype(np.float64))


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, int]


class LayerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, side: int, delta: bool, overwrite: bool) -> None:
        self.path, self.bits, self.side, self.delta, self.overwrite = path, bits, side, delta, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """The task's parts, which come sorted, each behind a row with its frame; one is held at a time, and of its rows one batch."""
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files, part = {}, None

        def finish() -> None:
            if part:
                name = f"{part.layer}-{uuid.uuid4().hex[:12]}.mwl"
                files[name] = part.first // self.side
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(frame_bytes(part.frame, part.codes, part.index["scale"], part.index["offset"]))

        for batch in iterator:
            heads = np.flatnonzero(batch.column("frame").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for n, (lo, hi) in enumerate(zip([0, *heads], [*heads, batch.num_rows], strict=True)):
                if n:
                    finish()
                    first, *shape = batch.column("frame")[lo].as_py().values()
                    part, lo = Part(batch.column("layer")[lo].as_py(), first, self.frame(*shape)), lo + 1
                if hi > lo:
                    part.put(batch.slice(lo, hi - lo))
        finish()
        return Written(files)

    def frame(self, rows: int, columns: int, steps: int, lat0: float, lon0: float, lat_step: float, lon_step: float, t0: float, dt: float) -> Frame:
        return Frame(self.bits, 0, 0, int(self.delta), lat0, lon0, lat_step, lon_step, rows, columns, self.side, t0, dt, steps)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        names = {} if self.overwrite else listed(store, root)
        for m in messages:
            names |= m.files if m else {}
        part = f"{root}/.{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(names, sort_keys=True).encode())
        store.move(part, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for name in (x for m in messages if m for x in m.files):
            store.delete_file(f"{root}/{name}")


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LayerWriter:
        return LayerWriter(self.options["path"], int(self.options.get("bits", 8)), int(self.options.get("side", 32)), self.options.get("delta", "false") == "true", overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source and its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayerSource)
    return spark


def write_layers(rows: DataFrame, folder: str, bits: int = 8, side: int = 32, delta: bool = False, mode: str = "append") -> None:
    """Writes the layers of rows (see ROWS). A layer of PART nodes or fewer is a file, a larger one is cut between rows of blocks into parts, a file each; so a
    task holds a part's codes, however large the layer. Parts without nodes are written too, as the grid reaches from 0 to the last row, column and step."""
    registered(rows.sparkSession)
    rows = rows.selectExpr(*[f"cast({x.rsplit(' ', 1)[0]} as {x.rsplit(' ', 1)[1]}) as {x.rsplit(' ', 1)[0]}" for x in ROWS.split(", ")])
    place = [F.first(x).alias(x) for x in ("lat0", "lon0", "lat_step", "lon_step", "t0", "dt")]  # each alone: a struct of them would sort all rows
    layers = rows.groupBy(F.col("layer").alias("name")).agg(*[(F.max(x) + 1).cast("int").alias(n) for x, n in (("i", "rows"), ("j", "columns"), ("k", "steps"))], *place)
    layers = layers.withColumn("high", side * F.greatest(F.lit(1), F.floor(PART / (F.lit(side) * F.col("columns").cast("long") * F.col("steps")))))  # rows of a part
    first = (F.col("part") * F.col("high")).alias("first")
    frame = F.struct(first, F.least(F.col("high"), F.col("rows") - first).alias("rows"), "columns", "steps", (F.col("lat0") + first * F.col("lat_step")).alias("lat0"), "lon0", "lat_step", "lon_step", "t0", "dt")
    heads = layers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.col("high"))))).select(F.col("name").alias("layer"), "part", frame.alias("frame"))
    cells = rows.join(F.broadcast(layers.select("name", "high")), F.col("layer").eqNullSafe(F.col("name")))  # a row a layer, fewer than the manifest has
    cells = cells.select("layer", F.floor(F.col("i") / F.col("high")).alias("part"), *[x.cast("int").alias(n) for n, x in (("i", F.col("i") % F.col("high")), ("j", F.col("j")), ("k", F.col("k")))], "code", "scale", "offset")
    dealt = cells.unionByName(heads, allowMissingColumns=True).repartition("layer", "part").sortWithinPartitions("layer", "part", F.col("frame").isNull())
    dealt.write.format("layers").mode(mode).options(path=folder, bits=bits, side=side, delta=str(delta).lower()).save()


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    return registered(spark).read.format("layers").option("path", folder).load()
