"""Typed batch sources for security logs, labelled sets and alert topics.

Readers never infer schemas: the typed schema is given, so the scan reads
only the projected columns and filters are pushed into parquet/ORC readers.
A broker topic or search index is only another ``fmt`` (its connector jar
must be on the classpath); the same functions read a JSON/parquet folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schema import LABELLED_CLEAN, LABELLED_NOISY, RAW_EVENT
from vigil.sources import topic

CORRUPT = "_corrupt_record"


def canonical_logs(df: DataFrame) -> DataFrame:
    """Raw events → typed rows: ISO text times parsed (bad text → NULL,
    microseconds kept), hour of day derived, missing optional fields NULL."""
    out = df
    if dict(df.dtypes).get("timestamp") == "string":
        out = out.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz"))
    if "hour_of_day" not in out.columns:
        out = out.withColumn("hour_of_day", F.hour("timestamp").cast("int"))
    return out


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
              options: dict | None = None) -> DataFrame:
    """Batch scan of the log store into a typed frame."""
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt in ("json", "csv"):
        reader = reader.schema(schema or RAW_EVENT)
        if fmt == "csv":
            reader = reader.option("header", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    return canonical_logs(reader.load(path))


def read_logs_capped(df: DataFrame, n: int | None = None) -> DataFrame:
    """Match-all scan; capped at ``n`` rows in a stable (time, id) order if
    the caller gives ``n``."""
    order = [c for c in ("timestamp", "event_id") if c in df.columns]
    return df if n is None else df.orderBy(*order).limit(n)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_first_existing(spark: SparkSession, paths: Iterable[str], schema: T.StructType = LABELLED_CLEAN
                        ) -> DataFrame | None:
    """S3: the first CSV path that exists (Hadoop FS check), else None."""
    for p in paths:
        if path_exists(spark, p):
            return spark.read.csv(p, header=True, schema=schema)
    return None


def read_labelled_csv(spark: SparkSession, path: str, noisy: bool = True) -> DataFrame:
    """Labelled data set (features + ``is_threat``), typed."""
    return spark.read.csv(path, header=True, schema=LABELLED_NOISY if noisy else LABELLED_CLEAN)


def decode_json(df: DataFrame, col: str = "value", schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Bytes → UTF-8 → record, PERMISSIVE; undecodable rows keep their
    text in ``_corrupt_record`` (and NULL fields) instead of failing the job."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    text = F.col(col).cast("string")
    parsed = F.from_json(text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return df.select(parsed.alias("r")).select("r.*")


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T4: (good rows, quarantined rows)."""
    bad = F.col(CORRUPT).isNotNull()
    return decoded.filter(~bad).drop(CORRUPT), decoded.filter(bad).select(CORRUPT)


def read_topic_batch(spark: SparkSession, path: str, n: int | None = None, fmt: str = "json",
                     options: dict | None = None, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Bounded read of a topic from its earliest message.

    ``fmt='segments'`` reads a folder of offset-named segments (``topic``):
    ``n`` messages in arrival order open only the segments that hold them.
    ``fmt='kafka'`` reads the broker (earliest → latest offsets); otherwise
    ``path`` is a folder of JSON messages in order of file and position, and a
    cap has to sort them (the investigation reads at most 500 messages, the
    report reads all)."""
    if fmt == "segments":
        topic.register(spark)
        reader = spark.read.format("segments").option("path", path).options(**(options or {}))
        raw = (reader if n is None else reader.option("limit", n)).load()
        return canonical_logs(decode_json(raw, "value", schema).drop(CORRUPT))
    if fmt == "kafka":
        raw = (spark.read.format("kafka").options(**(options or {}))
               .option("startingOffsets", "earliest").option("endingOffsets", "latest").load())
        order = [F.col("partition"), F.col("offset")]
        df = raw.select(*order, F.from_json(F.col("value").cast("string"), schema).alias("r")) \
                .select("partition", "offset", "r.*")
    else:
        df = (spark.read.schema(schema).json(path)
                   .withColumn("_file", F.input_file_name())
                   .withColumn("_pos", F.monotonically_increasing_id()))
        order = [F.col("_file"), F.col("_pos")]
    if n is not None:
        df = df.orderBy(*order).limit(n)
    return canonical_logs(df)


def first_non_empty(*sources: Callable[[], DataFrame]) -> tuple[int, DataFrame] | None:
    """Try lazy sources in order; the first that builds without error and
    has at least one row wins (``isEmpty`` reads one row, not the source)."""
    for i, make in enumerate(sources):
        try:
            df = make()
            if df is not None and not df.isEmpty():
                return i, df
        except Exception:  # noqa: BLE001 - a failing source falls through to the next
            continue
    return None


def register_view(df: DataFrame, name: str = "security_logs") -> DataFrame:
    """S11."""
    df.createOrReplaceTempView(name)
    return df


def from_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Literal rows (tests, case tables)."""
    return spark.createDataFrame(rows, schema)
