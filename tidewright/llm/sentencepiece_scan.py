"""Operator 4, SentencePiece encoding and decoding with a max-plus scan over giant documents.

Documents of up to GIANT characters go through the library as they are. A longer one is cut into chunks that spread over the
cluster: each chunk yields the transfer matrix between its boundary states (piece_lattice.py), the matrices of a document combine
by (max, +) into the states of its best path at every boundary, and each chunk is then traced back on its own. The matrices are small whatever
the text, and combine associatively: runs of FAN chunks are composed first, then runs of runs, so no task sees a document's chunks all at once.
Results are the library's own ids. A chunk's ids are decoded where they are made: no piece and no character's bytes run over a chunk's end, so the
texts of the chunks one after the other are the text of the ids.

Cases: null and empty texts have no ids and decode to an empty text; special strings in texts are text; null ids and repeated rows are rows like others;
an empty table gives no rows; the columns named in `keep` come along, other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidewright.llm.common import cut, small_batches
from tidewright.llm.piece_lattice import MARK, START, Chunk, boundary_states, compose, loaded

GIANT = 32_768
CHUNK = 8192
FAN = 64
#: Rows that a worker encodes or decodes at once.
ROWS = 128
CHUNKS_PER_TASK = 48
CHUNKS = StructType([StructField("row", StringType()), StructField("chunk", LongType()), *(StructField(x, StringType()) for x in ("before", "own", "after")), StructField("last", BooleanType())])


def _small(tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(tokenizer).model
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                ids = [model.encode(t or "", num_threads=1) for t in batch.column(batch.num_columns - 1).to_pylist()]
                texts = pa.array([model.decode(x) if x else "" for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), texts], names=[*batch.schema.names[:-1], "ids", "decoded_"])

    return encode


def _cut(chunk: int, longest: int):
    """Rows of giant documents, numbered by their task, and their chunks; the first chunk brings the kept columns."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                row, whole = f"{part}-{n}", MARK + text.replace(" ", MARK)
                n += 1
                for at in range(0, len(whole), 64 * chunk):
                    places = range(at, min(len(whole), at + 64 * chunk), chunk)
                    kept = [x.take(pa.array([i if p == 0 else None for p in places], pa.int64())) for x in batch.columns[:-1]]
                    out = [[row] * len(places), [p // chunk for p in places], [whole[max(0, p - longest) : p] for p in places], [whole[p : p + chunk] for p in places], [whole[p + chunk : p + chunk + longest] for p in places], [p + chunk >= len(whole) for p in places]]
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], names=[*batch.schema.names[:-1], *CHUNKS.names])

    return chunks


def _transfers(tokenizer: str):
    def transfers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = loaded(tokenizer)
        for frame in frames:
            found = [Chunk(lattice, x.before, x.own, x.after, x.chunk == 0, x.last).transfer() for x in frame.itertuples()]
            yield pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "matrix": [pickle.dumps(t) for t in found]})

    return transfers


def _composed(fan: int):
    """A run of neighbours as one."""

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        total = None
        for data in rows["matrix"]:
            total = pickle.loads(data) if total is None else compose(total, pickle.loads(data))
        return pd.DataFrame({"row": rows["row"].iloc[:1], "chunk": rows["chunk"].iloc[:1] // fan, "matrix": [pickle.dumps(total)]})

    return composed


def _states(run: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The states at the boundaries inside a run, from the states at its ends."""
    run = run.sort_values("chunk")
    come, go = (pickle.loads(ends[c].iloc[0]) for c in ("come", "go"))
    states = boundary_states([pickle.loads(x) for x in run["matrix"]], come, go)
    return pd.DataFrame({"row": run["row"], "chunk": run["chunk"], "come": [pickle.dumps(s) for s in states[:-1]], "go": [pickle.dumps(s) for s in states[1:]]})


def _scan(transfers: DataFrame, fan: int) -> DataFrame:
    """(row, chunk, come, go): up the tree of runs by composing, and down again with the states at the ends."""
    levels, schema, longest = [transfers], "row string, chunk long, matrix binary", (transfers.agg(F.max("chunk")).first()[0] or 0) + 1
    while longest > fan:
        up = levels[-1].withColumn("to", F.floor(F.col("chunk") / fan)).groupBy("row", "to").applyInPandas(_composed(fan), schema)
        levels.append(cut(up, "transfers"))
        longest = -(-longest // fan)
    start = F.lit(pickle.dumps(START))
    ends = levels[-1].select("row").distinct().select("row", F.lit(0).cast("long").alias("to"), start.alias("come"), start.alias("go"))
    for level in levels[::-1]:
        runs = level.withColumn("to", F.floor(F.col("chunk") / fan))
        found = runs.groupBy("row", "to").cogroup(ends.groupBy("row", "to")).applyInPandas(_states, "row string, chunk long, come binary, go binary")
        ends = found.withColumnRenamed("chunk", "to")
    return ends.withColumnRenamed("to", "chunk")


def _traced(tokenizer: str):
    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = loaded(tokenizer)
        for frame in frames:
            ids = [Chunk(lattice, x.before, x.own, x.after, x.chunk == 0, x.last).backtrace(pickle.loads(x.come), pickle.loads(x.go)) for x in frame.itertuples()]
            # the model puts a mark before a text, which is no part of it
            texts = [lattice.text(x, lattice.names)[chunk == 0 :] for x, chunk in zip(ids, frame["chunk"], strict=True)]
            yield pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "ids": ids, "decoded_": texts})

    return traced


def encode(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The columns of `keep`, ids array<int> of every row, and decoded_, the text those give. tokenizer: the path of a byte-pair .model file, the same on every machine."""
    small_batches(docs.sparkSession, 2)
    longest = loaded(tokenizer).longest
    if chunk < longest:
        raise ValueError("a chunk must hold the longest piece")
    kept = [f"keep{i}_" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)], F.col(text_col).alias("text_"))
    fields = [StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    is_giant = F.coalesce(F.char_length("text_") > giant, F.lit(False))
    small = rows.where(~is_giant).mapInArrow(_small(tokenizer), StructType([*fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded_", StringType())]))
    chunks = cut(rows.where(is_giant).mapInArrow(_cut(chunk, longest), StructType([*fields, *CHUNKS.fields])), "chunks")
    n = max(1, min(10_000, chunks.count() // CHUNKS_PER_TASK))
    spread = chunks.drop(*kept).repartition(n, "row", "chunk")
    transfers = cut(spread.mapInPandas(_transfers(tokenizer), "row string, chunk long, matrix binary"), "transfers")
    states = cut(_scan(transfers, fan), "states")
    traced = cut(chunks.drop(*kept).join(states, ["row", "chunk"]).mapInPandas(_traced(tokenizer), "row string, chunk long, ids array<int>, decoded_ string"), "traced")
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ids", "decoded_")))
    whole = traced.groupBy("row").agg(parts.alias("parts")).select("row", F.flatten("parts.ids").alias("ids"), F.array_join("parts.decoded_", "").alias("decoded_"))
    large = chunks.where("chunk = 0").select("row", *kept).join(whole, "row").select(*kept, "ids", "decoded_")
    return small.unionByName(large).toDF(*keep, "ids", "decoded_")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """The rows with decoded_, the text that the library makes of their ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(tokenizer).model
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                texts = [model.decode(x.values.to_numpy().tolist()) if x.is_valid and len(x.values) else "" for x in batch.column(batch.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_"])

    return encoded.mapInArrow(decoded, StructType([*encoded.schema.fields, StructField("decoded_", StringType())]))
