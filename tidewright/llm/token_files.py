"""Operator 8, token ids in bit-packed binary files.

Documents are sorted by id over range partitions; each partition becomes one file. A file packs its ids at the fixed width that the
largest id of the vocabulary needs, in blocks of equally many ids. A file begins with its header:

    8 bytes "TWPACK1\\n", then 6 little-endian int64: width, ids per block, ids, documents, blocks, 0;
    the documents' ids and whether they are null (int64 each), the first id of each document and the end (int64),
    the offset of each block and the end (int64), and the blocks' bytes.

Block i holds ids i * per_block and on; any id is found from the offsets without reading what comes before it, and numpy unpacks
whole blocks at a time. A task writes under a name of its attempt and renames at the end, so that a retried or doubled task leaves one
whole file. The manifest, a table beside the files, lists them in order.

Cases: a null text is an empty one and holds only the end id; null document ids come first; rows that repeat an id stand one after
the other, by text; an empty table gives no files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches
from tidewright.llm.pretokens import Remembered, loaded, packed

MAGIC = b"TWPACK1\n"
PER_BLOCK = 8192
MANIFEST = "part int, file string, n_ids long, n_docs long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def file_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, width: int, per_block: int = PER_BLOCK) -> Iterator[bytes]:
    """The header, then block after block."""
    n_blocks = -(-len(ids) // per_block)
    lengths = [(min(per_block, len(ids) - i * per_block) * width + 7) // 8 for i in range(n_blocks)]
    yield MAGIC + np.array([width, per_block, len(ids), len(doc_ids), n_blocks, 0], "<i8").tobytes()
    yield np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "<i8").tobytes()
    yield np.r_[0, np.cumsum(sizes)].astype("<i8").tobytes() + np.r_[0, np.cumsum(lengths)].astype("<i8").tobytes()
    for i in range(n_blocks):
        yield pack(ids[i * per_block : (i + 1) * per_block], width)


class TokenFile:
    """Random access to one file. file: anything with seek and read."""

    def __init__(self, file) -> None:
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a packed token file")
        self.width, self.per_block, self.n_ids, n_docs, n_blocks, _ = np.frombuffer(file.read(48), "<i8").tolist()
        self.doc_ids, null = np.frombuffer(file.read(16 * n_docs), "<i8").reshape(2, n_docs)
        self.doc_is_null = null.astype(bool)
        self.starts = np.frombuffer(file.read(8 * n_docs + 8), "<i8")
        self.blocks = np.frombuffer(file.read(8 * n_blocks + 8), "<i8")
        self.body = 56 + 24 * n_docs + 8 + 8 * n_blocks + 8

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file, from the blocks that hold them."""
        if hi <= lo:
            return np.empty(0, np.uint32)
        first, last = lo // self.per_block, (hi - 1) // self.per_block
        self.file.seek(self.body + int(self.blocks[first]))
        data = self.file.read(int(self.blocks[last + 1] - self.blocks[first]))
        base = first * self.per_block
        if self.per_block * self.width % 8 == 0:  # whole bytes to a block: the blocks join without gaps
            return unpack(data, min(self.n_ids, (last + 1) * self.per_block) - base, self.width)[lo - base : hi - base]
        parts = [unpack(data[self.blocks[b] - self.blocks[first] : self.blocks[b + 1] - self.blocks[first]], min(self.per_block, self.n_ids - b * self.per_block), self.width) for b in range(first, last + 1)]
        return np.concatenate(parts)[lo - base : hi - base]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))


def filesystem(folder: str):
    """(file system, folder in it) for a path or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, n_files: int, per_block: int = PER_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and the manifest; the manifest (part, file, n_ids, n_docs), read back."""

    small_batches(docs.sparkSession)

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        words, doc_ids, sizes, chunks = Remembered(tokenizer, packed), [], [], []
        width, end = max(1, int(max(words.pre.size - 1, end_id)).bit_length()), np.array([end_id], "<u4").tobytes()
        for frame in frames:
            doc_ids += [None if null else int(x) for x, null in zip(frame["id_"], frame["id_"].isna(), strict=True)]
            for text in frame["text_"].fillna(""):
                data = b"".join([*words.of(words.pre.pretokens(text)), end])
                sizes.append(len(data) // 4)
                chunks.append(np.frombuffer(data, "<u4").astype("<u2") if width <= 16 else np.frombuffer(data, "<u4"))
        if not doc_ids:
            return
        store, root = filesystem(folder)
        name, ids = f"part-{task.partitionId():06d}.ids", np.concatenate(chunks)
        del chunks
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None) as out:
            for data in file_bytes(doc_ids, sizes, ids, width, per_block):
                out.write(data)
        store.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
        yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "n_ids": [len(ids)], "n_docs": [len(doc_ids)]})

    rows = docs.selectExpr(f"cast({id_col} as long) as id_", f"{text_col} as text_", f"xxhash64({text_col}) as h_")
    dealt = rows.repartitionByRange(n_files, F.col("id_").asc_nulls_first(), "h_").sortWithinPartitions(F.col("id_").asc_nulls_first(), "h_", "text_").select("id_", "text_")
    dealt.mapInPandas(written, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all files before it."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for frame in frames:
            for name, before in zip(frame["file"], frame["before"], strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    packed_file = TokenFile(file)
                    n = len(packed_file.doc_ids)
                    for lo in range(0, n, 512):
                        hi = min(n, lo + 512)
                        starts = packed_file.starts[lo : hi + 1]
                        ids = packed_file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        at = starts - starts[0]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
                        doc_ids = pd.array(packed_file.doc_ids[lo:hi], dtype="Int64")
                        doc_ids[packed_file.doc_is_null[lo:hi]] = pd.NA
                        yield pd.DataFrame({"doc_id": doc_ids, "start": before + starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crc})

    # one row a file, so that a single task sums them up
    files = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before"))
    return files.repartition(max(1, manifest.count()), "file").mapInPandas(read, ROWS)


def vocabulary_size(tokenizer: str) -> int:
    return loaded(tokenizer).size


def file_count(spark: SparkSession, input_bytes: int, per_file: int = 24 << 20) -> int:
    """As many files as keep each about per_file bytes of stored text, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-input_bytes // per_file))
