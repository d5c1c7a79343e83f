"""Operator 5, mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from water filling over the sources. A source's target is met by complete epochs first;
the rest is a weighted sample: every document draws an exponential key, divided by its quality weight,
and the documents of smallest key are taken while the prefix sum of their sizes stays by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import GAP_CHARS, Scratch, n_words, own, read_table, text_or_empty

SEED, MAX_EPOCHS, BUCKET_ROWS, WEIGHTS = "mix-1", 3, 4096, (1, 2, 3)
LEAST_WEIGHT = 0.25
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: falls with the share of symbols among a text's characters (none: 0.25)."""
    text = text_or_empty(text)
    chars = F.length(F.translate(text, GAP_CHARS, ""))
    symbols = chars - F.length(F.translate(text, GAP_CHARS + SYMBOLS, ""))
    return F.when(chars > 0, F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * symbols / chars)).otherwise(F.lit(LEAST_WEIGHT))


def exponential_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of seed and document: the same in every run."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_or_empty(text)), "UTF-8"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / quality_weight(text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn. The total is shared by weight; a source
    stops at ``cap`` times its size and its excess is shared anew. This has a closed form: in the order of
    cap / weight the sources that stop are a prefix. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    w, top, total = own("w"), own("cap"), own("total")
    df = sizes.select("source", "source_size", weight.alias(w), (F.col("source_size") * cap).alias(top))
    rest = Window.orderBy(F.col(top) / F.col(w), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = Window.orderBy(F.col(top) / F.col(w), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({total: F.sum("source_size").over(everything) * share, own("left"): F.sum(w).over(rest), own("used"): F.coalesce(F.sum(top).over(done), F.lit(0))})
    # A source stops if its cap is at most the level times its weight, were it the first not to stop.
    free = F.col(top) * F.col(own("left")) > F.col(w) * (F.col(total) - F.col(own("used")))
    first = F.min(F.when(free, F.struct((F.col(top) / F.col(w)).alias("at"), F.col("source").isNull().alias("last"), "source", own("used"), own("left")))).over(everything)
    df = df.withColumn(own("first"), first).withColumn(own("free"), free)
    level = own("first")
    target = F.when(F.col(own("free")), F.col(w) * (F.col(total) - F.col(f"{level}.{own('used')}")) / F.col(f"{level}.{own('left')}")).otherwise(F.col(top))
    return df.select("source", "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, *, size: Column, key: Column, scratch: Scratch, cap: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``words`` (its size), ``source_size``, ``target`` (of its source), ``epochs`` and ``extra``.

    The mix takes a document ``epochs`` times whole, and ``extra`` words of it once more. Complete epochs are the whole
    part of target / source size. The rest is the weighted sample: in the order of the keys documents give all
    their words, the one that crosses the budget as many as are left.

    No window runs over a source: the keys of a source are cut into buckets of about ``bucket_rows`` rows,
    whose sizes are prefix-summed; only the bucket that holds the budget is sorted. That gives one threshold a source,
    with which the last pass decides each row where it stands; documents are never shuffled.

    Null sources are one source, the last. Null or empty texts have size 0 and give nothing. Rows equal in id and
    key share the words that they give. An empty table gives an empty result. Input columns of the names that are added
    here are replaced; others pass through.
    """
    k, v, b, s, n, e, rest, before = (own(x) for x in ("key", "words", "bucket", "source", "rows", "epochs", "rest", "before"))
    record, src, ids = own("record"), own("src"), own("id")  # the columns travel as one, so that none can meet those added here
    kept = [c for c in df.columns if c not in ("words", "source_size", "target", "epochs", "extra")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(record), F.col("source").alias(src), F.coalesce("doc_id", F.lit(-(1 << 63))).alias(ids), size.alias(v), key.alias(k))
    keyed = scratch.store(rows.select(F.col(src).alias(s), F.col(ids).alias("doc_id"), v, k), "keys")
    sizes = keyed.groupBy(s).agg(F.sum(v).alias("source_size"), F.count(F.lit(1)).alias(n))
    plan = targets(sizes.select(F.col(s).alias("source"), "source_size"), cap=cap)
    plan = plan.join(sizes.select(s, n), F.col("source").eqNullSafe(F.col(s))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.round(F.col("target") / F.col("source_size"), 12)))).otherwise(0).cast("long")
    plan = plan.withColumn(e, epochs).withColumn(rest, F.floor(F.col("target") - F.col(e) * F.col("source_size") + 0.5).cast("long"))
    plan = scratch.store(plan, "plan")
    # 1 - exp(-key * least weight) rises with the key and lies in (0, 1): its equal slices are the buckets.
    slices = F.greatest(F.lit(1), F.ceil(F.col(n) / bucket_rows))
    placed = keyed.join(plan.select(F.col(s).alias(own("s")), n, rest), F.col(s).eqNullSafe(F.col(own("s")))).drop(own("s"))
    placed = placed.withColumn(b, F.least(F.floor((1 - F.exp(-F.col(k) * LEAST_WEIGHT)) * slices), slices - 1).cast("long"))
    summed = placed.groupBy(s, rest, b).agg(F.sum(v).alias(own("sum")))
    earlier = F.sum(own("sum")).over(Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    edge = summed.withColumn(before, F.coalesce(earlier, F.lit(0))).where((F.col(before) < F.col(rest)) & (F.col(before) + F.col(own("sum")) >= F.col(rest)))
    edge = edge.select(F.col(s).alias(own("s")), F.col(b).alias(own("b")), before)
    same = F.col(s).eqNullSafe(F.col(own("s")))
    at_edge = placed.join(edge, same & (F.col(b) == F.col(own("b")))).drop(own("s"), own("b"))
    equal = at_edge.groupBy(s, rest, before, k, "doc_id").agg(F.sum(v).alias(v))
    upto = F.coalesce(F.sum(v).over(Window.partitionBy(s).orderBy(k, "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = equal.withColumn(own("left"), F.col(rest) - F.col(before) - upto).where(F.col(own("left")) > 0)
    last = taken.groupBy(s).agg(F.max(F.struct(k, "doc_id", F.col(v).alias("sum"), F.col(own("left")).alias("left"))).alias(own("last")))
    limits = scratch.store(plan.join(last.select(F.col(s).alias(own("s")), own("last")), same, "left").drop(own("s")), "limits")
    out = rows.join(limits, F.col(src).eqNullSafe(F.col(s)))
    here, end, at = F.struct(F.col(k).alias(k), F.col(ids).alias("doc_id")), F.col(own("last")), F.col(f"{own('last')}.left")
    limit = F.struct(end[k].alias(k), end["doc_id"].alias("doc_id"))
    extra = F.when((F.col(rest) <= 0) | end.isNull(), 0).when(here < limit, F.col(v)).when(here == limit, F.least(F.col(v), F.floor(F.col(v) * at / end["sum"]))).otherwise(0)
    return out.select(*[F.col(f"{record}.`{c}`").alias(c) for c in kept], F.col(v).alias("words"), "source_size", "target", F.col(e).alias("epochs"), extra.cast("long").alias("extra"))


def mixed_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents of the mix, each as often as it is taken; one taken in part counts if that is half of it or more."""
    text, count, whole = F.col("text"), own("count"), own("record")
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    mixed = mix(packed, size=n_words(text), key=exponential_key(F.col("doc_id"), text), scratch=scratch)
    times = F.col("epochs") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("words")), 1).otherwise(0)
    return mixed.withColumn(count, times).where(F.col(count) > 0).withColumn(count, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).select(f"{whole}.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: its size, its source's size and target, and the words taken of it."""
    scratch, text = Scratch(spark, "mix"), F.col("text")
    # The texts are read once; all else needs their sizes and keys alone.
    sized = read_table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text).alias("size"), exponential_key(F.col("doc_id"), text).alias("key"))
    mixed = mix(scratch.store(sized, "sized"), size=F.col("size"), key=F.col("key"), scratch=scratch)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("words") + F.col("extra")).alias("taken"))
