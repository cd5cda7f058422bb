"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a session on one machine may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master or "").startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Stored:
    """A table written as Parquet into the shared folder and read again, which cuts its lineage.

    It survives lost executors as a checkpoint does, takes a fraction of the room,
    is read by columns, and can be removed as soon as nothing reads it any more.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/quire-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """A stored table that stays, as what is returned lazily reads it."""
    return Stored(df).df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items of at most ``most`` in all, or one larger item."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
