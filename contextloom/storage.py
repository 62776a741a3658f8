"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())  # folders made in each, innermost last


def root_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, as in tests."""
    base = spark.conf.get(CHECKPOINTS, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINTS} to a folder that driver and executors share")
        base = "file:///tmp/contextloom-checkpoints"
    return base.rstrip("/")


def base_dir(spark: SparkSession) -> str:
    """The application's folder there."""
    return f"{root_dir(spark)}/loom-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in it."""
    return f"{base_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    A written table keeps its columns prunable, which a checkpointed RDD does not. The folder stays until ``release``,
    the end of the ``scratch`` around it, or ``clear``.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if _open.get():
        _open.get()[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[attr-defined]
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # type: ignore[attr-defined]


def release(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``cut`` returned and nothing reads any more."""
    for df in frames:
        if path := df.__dict__.pop("_written_to", None):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has cut; frames that still read such tables fail from then on."""
    remove(spark, base_dir(spark))


class Kept:
    """What outlives a ``scratch``."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def keep(self, *frames: DataFrame) -> None:
        self.paths.update(p for df in frames if (p := df.__dict__.get("_written_to")))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Kept]:
    """Tables cut inside are deleted at the end, except those kept: these belong to the scratch around, if any.

    What other threads cut meanwhile isn't touched: each has scratches of its own.
    """
    made: list[str] = []
    kept = Kept()
    around = _open.set((*_open.get(), made))
    try:
        yield kept
    finally:
        _open.reset(around)
        for path in made:
            if path not in kept.paths:
                remove(spark, path)
        if _open.get():
            _open.get()[-1].extend(p for p in made if p in kept.paths)
