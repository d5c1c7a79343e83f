"""Shared pieces of the training-data operators: words, hashes and tables kept in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def own(name: str) -> str:
    """A column name that cannot meet one of the input's."""
    return f"__tw_{name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run uses one of its own; a cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that later steps start from files instead of a long lineage.

    A lost executor costs nothing that is stored here. ``drop`` removes tables that
    no later plan reads; what a returned DataFrame still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def store(self, df: DataFrame, name: str, buckets: tuple[int, str] | None = None) -> DataFrame:
        """``df`` as written. With ``buckets`` (number, column) it is a bucketed table: a join or co-group by the column does not shuffle it."""
        path = self.path(name)
        if buckets is None:
            df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            table = f"tw_{uuid.uuid4().hex}"
            df.write.bucketBy(*buckets).sortBy(buckets[1]).option("path", path).saveAsTable(table, format="parquet")
            out = self.spark.table(table)
            out._tw_table = table  # type: ignore[attr-defined]
        out._tw_path = path  # type: ignore[attr-defined]
        return out

    def release(self) -> None:
        """Lets Spark remove the shuffle files of steps whose results are stored: it does so once their plans are garbage.

        Python's references reach the JVM a moment after they are dropped, so the first collection frees nothing of the last step."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            if table := getattr(t, "_tw_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path := getattr(t, "_tw_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run: a zip of it, served by the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "taktwerk_workers.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
