"""Helpers shared by the operators: tables, the shared folder, bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vigil.session import delete_on_exit, ensure_checkpoint_dir

# Bytes of text one Python step handles at a time.  A single longer text is
# a step of its own, so texts are always processed whole.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no later plan reads."""
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def wider(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the columns of ``ddl`` behind it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], text: str,
          limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of about ``limit`` bytes of ``text``."""
    for rb in batches:
        n = rb.num_rows
        lens = pa.compute.fill_null(pa.compute.binary_length(rb.column(text)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i in range(n):
            if size and size + lens[i] > limit:
                yield rb.slice(start, i - start)
                start, size = i, 0
            size += int(lens[i])
        if start < n:
            yield rb.slice(start, n - start)
