"""Operator 1, sharding: a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by seeded hashes.
Pass two runs a Fisher-Yates shuffle over each bucket. The buckets in order, each in
its shuffled order, form one global permutation; shard k takes the k-th equal slice of it,
so that shard row counts are at most one apart (the law ``rows``).

Whole records are scattered, shuffled and written: a shard is a folder of files, one for each bucket that it has
rows of, whose names in order and rows in order are its slots in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, own, read_table, text_or_empty

SHARDS, SEED, BUCKET_BYTES = 8, 20_240_607, 4 << 20


def shuffle_shards(df: DataFrame, n_shards: int, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, row_bytes: Column | None = None) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``row_bytes`` estimates a record's size; the default is the length of its strings and
    16 bytes for every other column. A bucket holds about ``bucket_bytes``. A record's bucket
    is a seeded hash of its place in the scan, not of a key: equal rows, and a key that holds
    a third of the table, spread as evenly as all others. Each bucket is a Spark partition of its own and
    the permutation is seeded by bucket, so a lost task rebuilds the same order. The input
    should be a table scan (or stored table), whose row places do not change when tasks are rerun.

    Nulls, repeated rows and any columns pass through unchanged; an empty table gives an
    empty result; existing columns named shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    if row_bytes is None:
        row_bytes = sum((F.coalesce(F.octet_length(df[c]), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes), F.lit(16))
    total, rows = df.agg(F.sum(row_bytes).cast("long"), F.count(F.lit(1))).first()
    if not rows:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    buckets = max(1, math.ceil(total / bucket_bytes))
    place, bucket, record, at = own("place"), own("bucket"), own("record"), own("at")
    # Pass one: scatter.
    scattered = (
        df.select(F.struct(F.monotonically_increasing_id().alias(place), *[F.col(f"`{c}`") for c in df.columns]).alias(record))
        .withColumn(bucket, F.pmod(F.xxhash64(F.col(f"{record}.{place}"), F.lit(seed)), F.lit(buckets)).cast("int"))
        .repartitionById(buckets, F.col(bucket))
    )
    # Pass two: one bucket in memory, its order first made canonical, then shuffled.
    shuffled = (
        scattered.groupBy(bucket)
        .agg(F.collect_list(record).alias(record))
        .select(bucket, F.posexplode(F.shuffle(F.sort_array(record), F.lit(seed))).alias(at, record))
    )
    # Bucket sizes are hashes of places alone, so they are counted without moving the records again.
    counts = df.select(F.monotonically_increasing_id().alias(place)).groupBy(F.pmod(F.xxhash64(place, F.lit(seed)), F.lit(buckets)).cast("int").alias(bucket)).count()
    start = own("start")
    offsets = counts.select(bucket, (F.sum("count").over(Window.orderBy(bucket)) - F.col("count")).alias(start))
    # Offsets have a row for each bucket, so records stay in theirs.
    out = shuffled.join(F.broadcast(offsets), bucket).withColumn(own("index"), F.col(start) + F.col(at))
    out = out.withColumn("shard", F.expr(f"cast({own('index')} * {n_shards} div {rows} as int)"))
    out = out.withColumn("slot", F.expr(f"{own('index')} - (shard * {rows} + {n_shards - 1}) div {n_shards}"))
    return out.select(*[F.col(record)[c].alias(c) for c in df.columns], "shard", "slot")


def write_shards(df: DataFrame, n_shards: int, scratch: Scratch, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffles whole rows into shards, writes them to the shared folder and gives them as read back, with ``shard`` and ``slot``.

    Shard k is the folder ``shard=k``. A file holds rows of one bucket, in the order of their slots.
    """
    path = scratch.path("shards")
    out = shuffle_shards(df, n_shards, seed=seed, bucket_bytes=bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = df.sparkSession.read.schema(out.schema).parquet(path)
    back._tw_path = path  # type: ignore[attr-defined]
    return back


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of shards 0 to 7 under the law ``rows``, as the written shards hold it; null text has size 1 and the crc of nothing."""
    written = write_shards(read_table(spark, sf_dir, "documents"), SHARDS, Scratch(spark, "sharding"))
    text = text_or_empty(F.col("text"))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    return written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
