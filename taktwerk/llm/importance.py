"""Operator 13: resampling of documents towards a target by importance, with tries of words local to a partition.

First pass: each task inserts the runs of 1 to ``longest`` words of its texts into a trie of words. A node holds how often its run was met
and the CRC of the run's bytes, carried on from its parent's; where a trie has grown to ``TRIE_NODES`` nodes its counts go to their buckets
and a new one begins, so a task holds one trie of bounded size and one number a bucket. Bucket totals are summed by Spark: their number is
a parameter, whatever the data. Second pass: nodes of a new trie get the gain of their bucket when first met, and a document's weight is
the sum of the gains on its paths. Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

Ranks are dealt by range of (score, id): parts are numbered within themselves and shifted by the sizes of those before them.

Defined cases: a null text has no words; a document without features weighs 0. A null doc_id counts as "" in the hash and comes before the
others in ties. Repeated rows are drawn as rows of their own. Empty tables give gains from the prior alone, and no rows where there are no
documents. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, read_table, ship, text_or_empty

#: A word: letters and digits of ASCII and whatever lies beyond ASCII.
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Nodes at which a task empties its trie.
TRIE_NODES = 500_000
BUCKETS = 10_000


def words_in(text: str) -> list[str]:
    """The words of a text, A to Z in lower case."""
    return _TOKEN.findall(text.translate(_LOWER))


class Trie:
    """Runs of words. ``children[node]`` leads from a run to its longer ones; node 0 is the empty run."""

    def __init__(self) -> None:
        self.children: list[dict[str, int] | None] = [{}]
        self.crc = [0]
        self.value: list[float] = [0]

    def grow(self, node: int, word: str, value: Callable[[int], float]) -> int:
        """A new node for a run's continuation: its CRC goes on from its parent's, its first value comes from ``value``."""
        below = self.children[node]
        if below is None:
            below = self.children[node] = {}
        new = below[word] = len(self.crc)
        crc = zlib.crc32((" " + word if node else word).encode(), self.crc[node])
        self.children.append(None)
        self.crc.append(crc)
        self.value.append(value(crc))
        return new

    def __len__(self) -> int:
        return len(self.crc)

    def walk(self, words: list[str], longest: int, value: Callable[[int], float]) -> list[int]:
        """The node of every run of ``words``, each as often as it occurs."""
        children, first, out = self.children, self.children[0], []
        for i, word in enumerate(words):
            node = first.get(word)
            if node is None:
                node = self.grow(0, word, value)
            out.append(node)
            for later in words[i + 1 : i + longest] if longest > 1 else ():
                below = children[node]
                found = below.get(later) if below is not None else None
                node = self.grow(node, later, value) if found is None else found
                out.append(node)
        return out


def bucket_totals(texts: DataFrame, *, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (one column, text) fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie()

        def empty() -> None:
            if len(trie) > 1:
                np.add.at(totals, np.array(trie.crc[1:], np.int64) % buckets, np.array(trie.value[1:], np.int64))

        for b in batches:
            for text in b.column(0):
                seen = trie.value
                for node in trie.walk(words_in(text.as_py()), longest, lambda crc: 0):
                    seen[node] += 1
                if len(trie) >= TRIE_NODES:
                    empty()
                    trie = Trie()
        empty()
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(totals[met], pa.int64())], names=["bucket", "n"])

    ship(texts.sparkSession)
    parts = texts.select(text_or_empty(F.col("text").cast("string")).alias("text")).mapInArrow(count, "bucket long, n long")
    totals = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        totals[r["bucket"]] = r["n"]
    return totals


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the raw texts, both with one more in each bucket."""
    k, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_raw + k) / ((float(s) + 1) * (all_target + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, *, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.tolist()
        buckets, trie = len(gain), Trie()

        def of(crc: int) -> int:
            return gain[crc % buckets]

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_in(text.as_py())
                nodes = trie.walk(words, longest, of)
                weight = sum(map(trie.value.__getitem__, nodes))
                rows.append((doc_id, len(words), len(nodes), weight, weight + noise(doc_id, seed)))
                if len(trie) >= TRIE_NODES:
                    trie = Trie()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, scratch: Scratch, *, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``weighed`` with ``rank``: the best ``percent`` of a hundred documents of ``least_words`` or more, the others null.

    The rows are numbers only. They are dealt once by range of (score, id) and written with their part, so that the parts' sizes and the numbers within them speak of the same rows.
    """
    spark = weighed.sparkSession
    weighed = scratch.store(weighed, "weighed")  # the range is sampled before it is dealt: texts are weighed once
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    # Rows that are equal in both are dealt by their place in the input, so that no id, however often it occurs, fills a part.
    dealt = weighed.withColumn("fits", F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "tie").withColumn("part", F.spark_partition_id())
    kept = scratch.store(dealt, "dealt")
    sizes = kept.where("fits").groupBy("part").agg(F.count("*").alias("n"))  # as many rows as parts
    firsts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    place = F.col("first") + inside
    ranked = kept.where("fits").join(F.broadcast(firsts), "part").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= F.floor(F.col("all") * percent / 100), F.col("place")).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(kept.where("NOT fits").withColumn("rank", F.lit(None).cast("long")).select(*names))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, *, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, towards the words of ``target`` (a column text)."""
    gains = gains_of(bucket_totals(docs, longest=longest, buckets=buckets), bucket_totals(target, longest=longest, buckets=buckets))
    return draw(weigh(docs, gains, longest=longest, seed=seed), scratch, percent=percent, least_words=least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of ``benchmark``."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Scratch(spark, "importance"))


#: CRC-32 in SQL: the table of 256 words by eight steps each, then a fold over the bytes of each distinct word.
OP13_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
counts AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM dw UNION ALL SELECT w, 0, 1 FROM bw) GROUP BY w),
hashed AS (
  SELECT w, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(octet_length(encode(w)) AS BIGINT)), lambda i: CAST('0x' || hex(encode(w))[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda a, x: xor(a >> 8, crc_table.steps[xor(a & 255, x) + 1]))) % 10000 AS bucket FROM counts, crc_table
), totals AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
sums AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM totals),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(x.t AS DOUBLE) + 1) * (a.s + 10000) / ((CAST(x.s AS DOUBLE) + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM totals x, sums a),
weights AS (SELECT r, sum(gain) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)
), placed AS (
  SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (n >= 20) OVER () AS fits FROM scored
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN place <= fits * 10 // 100 THEN place END AS BIGINT) AS rank FROM placed
"""
