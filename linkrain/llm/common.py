"""What the operators of this subpackage share: shared-folder checkpoints, Arrow batches, table paths."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and there is one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder of checkpoint() and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that a binary column of a slice holds about most_bytes (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(column(batch, name)):
        n = len(n.as_buffer()) if n.is_valid else 0
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(name: str = "text"):
    """A text column as UTF-8 bytes, null kept."""
    return F.col(name).cast("binary").alias(name)
