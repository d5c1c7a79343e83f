"""Text against a vocabulary: failure descriptions to codes by an inverted index of tokens, and numbers of an answer against its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled

#: What a match of one word and of three or more is worth, and the least score of a proposal.
MASS_BASE, MASS_SHARE, MASS_WORDS, LEAST = 0.55, 0.45, 3, 0.40
UNMAPPED = "UNMAPPED"
#: More than what rounding adds to a score.
ROUNDING = 1e-6
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: words of a to z in lower case, without a plural s or the ending ing. Null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.transform(words, _stem))


def _stem(w: Column) -> Column:
    shorter = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.when((F.length(w) > 4) & F.endswith(w, F.lit("ing")), shorter(3)).when((F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), shorter(1)).otherwise(w)


def phrase_index(phrases: DataFrame) -> DataFrame:
    """(token, code, phrase, idf, whole) of (code, phrase): which phrases a token is in, how much it narrows the codes down, and its phrase's sum of that.

    A code's own name, underscores as spaces, is a phrase of it."""
    own = phrases.select("code", F.translate(F.col("code").cast("string"), "_", " ").alias("phrase"))
    every = phrases.select("code", "phrase").unionByName(own).where("code IS NOT NULL").distinct().withColumn("token", F.explode(tokens(F.col("phrase"))))
    n = phrases.agg(F.countDistinct("code").alias("n_codes"))
    idf = every.groupBy("token").agg(F.countDistinct("code").alias("d")).crossJoin(F.broadcast(n)).select("token", F.ln(1 + F.greatest(F.col("n_codes"), F.lit(1)) / F.col("d")).alias("idf"))
    each = every.join(idf, "token")
    whole = each.groupBy("code", "phrase").agg(F.sum("idf").alias("whole"), F.count(F.lit(1)).alias("n_tokens"))
    return each.join(whole, ["code", "phrase"]).select("token", "code", "phrase", "idf", "whole", "n_tokens")


def rare_tokens(index: DataFrame, least: float) -> DataFrame:
    """(token, code, phrase, whole) of an index: of each phrase the tokens without one of which no text scores ``least``, as all others together weigh too little."""
    upto = F.sum("idf").over(Window.partitionBy("code", "phrase").orderBy("idf", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    needed = (least - ROUNDING) / (MASS_BASE + MASS_SHARE) * F.col("whole")
    return index.withColumn("__upto", upto).where(F.col("__upto") >= needed).select("token", "code", "phrase", "whole")


def propose_codes(texts: DataFrame, key: str, phrases: DataFrame, vocabulary: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, code, score) of (key, text): the best code of each text, or UNMAPPED where none scores ``least``.

    A phrase's score is the share of its weight that the text covers, times a mass that grows with the number of words met. A text is one row with the
    numbers of its known tokens; it meets the phrases of which it has a rare token and is scored in that row, so no pair is shuffled. The phrases are
    the vocabulary of a plant: tasks hold them whole. Codes that are not in
    ``vocabulary`` (code) are never proposed. Ties go to the first code. Rows with one key count as one text.
    """
    known = phrases.join(vocabulary.select("code").distinct(), "code", "left_semi")
    index = settled(phrase_index(known))
    words = settled(index.select("token").distinct().withColumn("word", F.monotonically_increasing_id()))
    lists = index.join(words, "token").groupBy("code", "phrase").agg(F.collect_list("word").alias("words"), F.collect_list(F.struct("word", "idf")).alias("weights"))
    firsts = rare_tokens(index, least).join(words, "token").join(lists, ["code", "phrase"]).select("word", "code", "whole", F.col("words").alias("of"), "weights")
    held = texts.select(key, F.explode(tokens(F.col("text"))).alias("token")).join(F.broadcast(words), "token").groupBy(key).agg(F.collect_set("word").alias("held"))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  A value that is read several times, worked out once a row.
    pairs = held.select(key, "held", F.explode("held").alias("word")).join(F.broadcast(firsts), "word").select(key, "code", "whole", "weights", once(F.array_intersect("held", "of")).alias("both"))
    got = F.aggregate(F.filter("weights", lambda e: F.array_contains("both", e["word"])), F.lit(0.0), lambda acc, e: acc + e["idf"])
    score = F.round(got / F.col("whole") * (MASS_BASE + MASS_SHARE * F.least(F.lit(1.0), F.size("both") / MASS_WORDS)), 9)
    best = pairs.select(key, F.col("code").alias("__c"), once(score).alias("score")).where(F.col("score") >= least)
    best = best.groupBy(key).agg(F.min_by("__c", F.struct(-F.col("score"), F.col("__c"))).alias("code"), F.max("score").alias("score"))
    out = texts.select(key).distinct().join(best, key, "left")
    return out.select(key, F.coalesce(F.col("code").cast("string"), F.lit(UNMAPPED)).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"))


def ungrounded(answers: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number): numbers that an answer (keys, text) names and none of its evidence lines (keys, text) does. Both sides are cut into numbers, which meet by key and value."""
    cut = lambda d: d.select(*keys, F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({NUMBER})"), 1)).alias("number")).distinct()
    return cut(answers).join(cut(evidence), [*keys, "number"], "left_anti")


def guarded(answers: DataFrame, evidence: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """``answers`` with ``grounded`` and ``n_flagged``; an answer with a number from nowhere is replaced by ``fallback``."""
    flagged = ungrounded(answers, evidence, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_flagged"))
    d = answers.join(flagged, keys, "left").withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))
    return d.withColumns({"grounded": F.col("n_flagged") == 0, "text": F.when(F.col("n_flagged") == 0, F.col("text")).otherwise(fallback)})
