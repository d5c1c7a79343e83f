"""Event streams in windows: a file source, a watermark, and an append sink that a batch reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions.lineage import shared_dir


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files; ``files`` of them a trigger at most."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a stream, with the time of each event as a timestamp."""
    return table_stream(spark, f"{sf_dir}/events.parquet", files).withColumn("ts", F.col("ts").cast("timestamp"))


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of a stream's own in the shared one: output and checkpoint lie side by side."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PARTITIONS = "spark.sql.shuffle.partitions"


def run_to_end(stream: DataFrame, root: str, keys: int | None = None) -> DataFrame:
    """All that the stream holds now, appended below ``root`` and read back. Called again with the same ``root``, it goes on where it stopped.

    Every partition of a state is a store of its own on disk, empty or not; a stream of few ``keys`` has no more of them than keys."""
    spark = stream.sparkSession
    before = spark.conf.get(PARTITIONS)
    if keys is not None:
        spark.conf.set(PARTITIONS, str(min(int(before), keys)))
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PARTITIONS, before)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """``run_to_end`` in a new folder."""
    return run_to_end(stream, new_root(stream.sparkSession, name))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """(start, event_type, n) of windows that the watermark has passed: a window is given once, when no event can change it any more."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, width: str, step: str, late: str) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return g.select(F.col("w.start").alias("start"), "n", "first_event")


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of runs of a key's events less than ``gap`` apart, each given once the watermark has passed its end."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, late: str) -> DataFrame:
    """Each event id once, however often it is sent within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
