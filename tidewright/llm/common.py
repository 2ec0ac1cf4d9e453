"""Small helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and there is one machine (tests)."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="checkpoints-"))
    return base or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: the lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_HELD: dict = {}


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task: one such thing at a time, so that those of operators that follow each other don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Batches that go to Python stop at so many megabytes, so that long texts don't pile up in a worker; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(megabytes << 20))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to clash with no column of the frame."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
