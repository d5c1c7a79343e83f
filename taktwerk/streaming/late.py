"""Late rows to a side table, and the replay of a table as files that arrive one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(df: DataFrame, arrival: str, root: str, first: int, last: int) -> str:
    """``df`` written below ``root`` as one file for each ``arrival`` from ``first`` to ``last``, in that order; a stream of the folder meets them so.

    A file is what one trigger takes: choose the number of arrivals with the size of the table."""
    for a in range(first, last + 1):
        df.where(F.col(arrival) == a).drop(arrival).coalesce(1).write.mode("append").parquet(root)
    return root


def split_late(stream: DataFrame, t: str, delay_s: float, root: str) -> DataFrame:
    """Every row of the stream with ``batch`` and ``late``: late rows are those more than ``delay_s`` behind the latest time of the batches before theirs.

    Spark's own watermark drops such rows without a trace; here they are kept beside the others. Each batch is written to folders of its number,
    which a repeated batch overwrites, and its latest time likewise, so a restart after a failure neither loses nor doubles a row.
    Rows without a time are late from the second batch on. Works for any number of batches; the driver holds one number of each.
    """
    spark = stream.sparkSession
    marks = f"{root}/marks"

    def write(rows: DataFrame, batch: int) -> None:
        before = None
        if batch > 0:
            before = rows.sparkSession.read.schema("mark double, batch long").parquet(marks).where(F.col("batch") < batch).agg(F.max("mark")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.col(t) < before - delay_s, F.lit(True))
        rows.withColumn("late", late).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        rows.agg(F.max(t).cast("double").alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
