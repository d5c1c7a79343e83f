"""An append-only ledger in a folder: hash chains that go on from their stored heads, and a manifest that says what is whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
ENTRIES = "batch long, chain long, entry_id long, body string, prev_hash string, entry_hash string"
HEADS = "batch long, chain long, head_id long, head_hash string"
MANIFEST = "batch long, n_entries long, n_chains long, digest string"


def _read(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    """All batches of a part; none where the folder is not there yet."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{part}/batch=*").select(*[f.split()[0] for f in schema.split(", ")])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _digest(entries: DataFrame) -> DataFrame:
    """(batch, n_entries, n_chains, digest): the digest is the sum of the entries' hashes cut to 60 bits, so order and partitioning do not matter."""
    cut = F.conv(F.substring("entry_hash", 1, 15), 16, 10).cast("decimal(38,0)")
    return entries.groupBy("batch").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("chain").alias("n_chains"), F.sum(cut).cast("string").alias("digest"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(batch, n_entries, n_chains, digest) of the batches that were written to the end."""
    return _read(spark, root, "manifest", MANIFEST)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(batch, chain, entry_id, body, prev_hash, entry_hash) of whole batches; a batch that broke off has no manifest and is not seen."""
    return _read(spark, root, "entries", ENTRIES).join(F.broadcast(manifest(spark, root).select("batch")), "batch", "left_semi")


def append(spark: SparkSession, root: str, batch: int, rows: DataFrame, order: str) -> None:
    """Writes ``rows`` (chain, ``order``, body) as entries after what their chains hold, numbered from 1 within a chain.

    An entry's SHA-256 covers the hash before it and its own body. Chains are read from their heads alone, so an append costs what it adds, one row a chain, not what the
    ledger holds. Each part goes to a folder of its batch and replaces what is there; the manifest comes last. So a batch that broke off is written again under its number, and one
    that is whole is left as it is. A batch below the last whole one is refused, as later entries rest on it. Ties of ``order`` go by body; null chains are a chain; a null body counts as empty. A chain's rows of one batch are folded in one task: batches are to be cut so that they fit.
    """
    last = manifest(spark, root).agg(F.max("batch")).first()[0]
    if last == batch:
        return
    if last is not None and batch < last:
        raise ValueError(f"batch {batch} is older than {last}, which is whole")
    heads = _read(spark, root, "heads", HEADS).where(F.col("batch") < batch).join(F.broadcast(manifest(spark, root).select("batch")), "batch", "left_semi")
    heads = heads.groupBy(F.col("chain").alias("__chain")).agg(F.max_by(F.struct("head_id", "head_hash"), "batch").alias("__head"))
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("body", F.lit("")).alias("body"))))
    new = rows.groupBy(F.col("chain").cast("long").alias("chain")).agg(items.alias("items"))
    new = new.join(heads, F.col("chain").eqNullSafe(F.col("__chain")), "left")
    start_id, start = F.coalesce("__head.head_id", F.lit(0).cast("long")), F.coalesce("__head.head_hash", F.lit(GENESIS))
    step = lambda acc, x: F.array_append(acc, F.sha2(F.concat(F.element_at(acc, -1), x["body"]), 256))
    new = new.select("chain", start_id.alias("start_id"), "items", F.aggregate("items", F.array(start), step).alias("hashes"))
    d = new.select("chain", "start_id", "hashes", F.posexplode("items").alias("i", "item"))
    d = d.select("chain", (F.col("start_id") + F.col("i") + 1).alias("entry_id"), "item.body", F.col("hashes")[F.col("i")].alias("prev_hash"), F.col("hashes")[F.col("i") + 1].alias("entry_hash"))
    where = lambda part: f"{root}/{part}/batch={batch}"
    number = F.lit(batch).cast("long").alias("batch")
    d.select(number, "*").write.mode("overwrite").parquet(where("entries"))
    stored = spark.read.schema(ENTRIES).parquet(where("entries"))
    ends = stored.groupBy("chain").agg(F.max("entry_id").alias("head_id"), F.max_by("entry_hash", "entry_id").alias("head_hash"))
    ends.select(number, "*").write.mode("overwrite").parquet(where("heads"))
    _digest(stored).coalesce(1).write.mode("overwrite").parquet(where("manifest"))


def verify_batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch, status): whole; torn (entries without a manifest); altered (number or digest of the entries differ from the manifest's, or its entries are gone)."""
    have = _digest(_read(spark, root, "entries", ENTRIES))
    said = manifest(spark, root).toDF("batch", "said_entries", "said_chains", "said_digest")
    same = (F.col("n_entries") == F.col("said_entries")) & (F.col("n_chains") == F.col("said_chains")) & (F.col("digest") == F.col("said_digest"))
    status = F.when(F.col("said_entries").isNull(), "torn").when(F.coalesce(same, F.lit(False)), "whole").otherwise("altered")
    return have.join(said, "batch", "full").select("batch", status.alias("status"))


def verify_chains(ledger: DataFrame) -> DataFrame:
    """(chain, n, first_break): the first entry that does not name the hash before it, whose number does not follow, or whose own hash is not that of its content; null where the chain holds.

    Each entry is checked against its stored predecessor, so nothing is folded."""
    w = Window.partitionBy("chain").orderBy("entry_id")
    linked = (F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)) == F.col("prev_hash")) & (F.coalesce(F.lag("entry_id").over(w), F.lit(0)) + 1 == F.col("entry_id"))
    intact = F.sha2(F.concat("prev_hash", "body"), 256) == F.col("entry_hash")
    d = ledger.withColumn("__ok", F.coalesce(linked & intact, F.lit(False)))
    return d.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("__ok"), F.col("entry_id"))).alias("first_break"))
