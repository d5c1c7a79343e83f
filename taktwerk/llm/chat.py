"""Operator 4, chat formatting by cumulative-snapshot collapse.

A chat log often stores a conversation again after every turn. A rolling hash of the turns so far identifies the
conversations that are a prefix of a longer one; an anti-join keeps the maximal ones, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import own, read_table

#: Turns a block: the unit in which positions and prefix hashes are summed, and the size of a rendered part.
BLOCK = 256
TURN_FORMAT = "<|im_start|>%s\n%s<|im_end|>\n"


def _turn_hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def positions(df: DataFrame) -> DataFrame:
    """Distinct turns of each conversation with their position ``pos`` from 1, in the order of turn, role and text.

    Two steps, so that a conversation that holds much of the table is not ordered in one task:
    rows within a block of turn numbers, and blocks within the conversation by their counts.
    """
    block = own("block")
    turns = df.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn(block, F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / BLOCK))
    counts = turns.groupBy("conv_id", block).count()
    earlier = F.sum("count").over(Window.partitionBy("conv_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", block, F.coalesce(earlier, F.lit(0)).alias(own("before")))
    order = Window.partitionBy("conv_id", block).orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    return turns.withColumn(own("rank"), F.row_number().over(order)).join(counts, ["conv_id", block]).select("conv_id", "role", "text", (F.col(own("before")) + F.col(own("rank"))).alias("pos"))


def maximal_conversations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with positions, conversations kept): (conv_id, n_turns, copies), one row for each maximal conversation.

    The hash of a prefix is the exclusive or of 64-bit hashes of its (position, role, text), twice with different seeds, so
    128 bits identify it; it rolls, and its blocks add up in any order. A conversation goes if its whole hash is that of a proper
    prefix of another; of equal conversations the smallest conv_id stays and counts them in ``copies``.

    Rows without conv_id belong to no conversation and give nothing. Exactly repeated rows count once; null turns come
    first; null roles and texts are values of their own. Empty tables give empty results.
    """
    turns = positions(df)
    part = F.floor((F.col("pos") - 1) / BLOCK)
    turns = turns.withColumns({"part": part, own("a"): _turn_hash(11, "pos", "role", "text"), own("b"): _turn_hash(23, "pos", "role", "text")})
    blocks = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(own("a")).alias("a"), F.bit_xor(own("b")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    back = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "part", *[F.coalesce(F.bit_xor(x).over(back), F.lit(0).cast("long")).alias(own(f"{x}0")) for x in "ab"])
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rolled = turns.select("conv_id", "part", "pos", *[F.coalesce(F.bit_xor(own(x)).over(inside), F.lit(0).cast("long")).alias(x) for x in "ab"]).join(before, ["conv_id", "part"])
    # The turns before one at position p > 1 are a proper prefix of p - 1 turns.
    prefixes = rolled.where("pos > 1").select((F.col("pos") - 1).alias("n_turns"), *[F.col(x).bitwiseXOR(F.col(own(f"{x}0"))).alias(x) for x in "ab"]).distinct()
    single = whole.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return turns.select("conv_id", "part", "pos", "role", "text"), single.join(prefixes, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as text, in parts of ``BLOCK`` turns (conv_id, part, n_turns, copies, text).

    A null role is written as unknown, a null text as empty."""
    line = F.format_string(TURN_FORMAT, F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    lines = turns.withColumn(own("line"), line).join(kept, "conv_id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", own("line")))), lambda x: x[own("line")]), "")
    return lines.groupBy("conv_id", "part", "n_turns", "copies").agg(text.alias("text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation of ``conversations``, rendered."""
    return render(*maximal_conversations(read_table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM turns),
convs AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS l FROM placed GROUP BY conv_id),
single AS (SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM convs GROUP BY l, n_turns),
kept AS (SELECT conv_id, n_turns, copies FROM single s WHERE NOT EXISTS (
  SELECT 1 FROM convs c WHERE c.n_turns > s.n_turns AND c.l[1] = s.l[1] AND list_slice(c.l, 1, s.n_turns) = s.l))
SELECT k.conv_id, CAST((pos - 1) // 256 AS BIGINT) AS part, k.n_turns, k.copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept k JOIN placed p ON p.conv_id = k.conv_id GROUP BY ALL
"""
