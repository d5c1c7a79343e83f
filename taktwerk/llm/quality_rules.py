"""Operator 7, quality rules, line first.

Every line is held against rules on its punctuation, its likeness to navigation and its boilerplate phrases. Lines that
fail go; a document that loses too much of its text with them is rejected. Whole-text figures come first and reject
very short and very repetitive texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import GAP_CHARS, own, read_table, text_or_empty, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: A document is rejected if the lines that pass hold less than this share of its words' characters.
LEAST_KEPT = 0.5
#: Fixed phrases of boilerplate lines.
BOILERPLATE = (
    "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "all rights reserved",
    "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter",
    "click here to", "lorem ipsum", "share on facebook", "follow us on",
)


def n_repeat_words(words: str) -> str:
    """SQL for the words in three-word windows that occur twice or more, of the array that ``words`` names.

    Windows are compared by 64-bit hash. Most texts have no such window: a set of the hashes tells, and only the others sort.
    Each array is bound to a lambda variable once, so that none is computed again for each element.
    """
    marked = "transform(g, (x, i) -> named_struct('h', x, 'p', i))"
    twice = "filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h))"
    places = f"transform(array(sort_array({marked})), s -> sort_array(transform({twice}, x -> x.p)))[0]"
    covered = f"transform(array({places}), p -> aggregate(transform(p, (x, i) -> if(i < size(p) - 1, least(3, p[i + 1] - x), 3)), 0, (a, x) -> a + x))[0]"
    grams = "transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))"
    counted = f"transform(array({grams}), g -> if(size(array_distinct(g)) = size(g), 0, {covered}))[0]"
    return f"if(size({words}) < 3, 0, transform(array(transform({words}, x -> xxhash64(x))), h -> {counted})[0])"


def line_passes(line: Column) -> Column:
    """Whether a line with a word passes all rules.

    Punctuation: among its words at most 30 % end in two or more marks or in a symbol, and it holds at most 10 % symbols.
    Navigation: fewer than 3 bars, bullets or arrows between its words, or a word to more than 8 characters of text around them.
    Boilerplate: none of the fixed phrases, in a line of under 30 words.
    Repetition: of ten words or more, at least a fifth are different.
    """
    lower = F.lower(line)
    chars = F.length(line)
    symbols = chars - F.length(F.translate(line, SYMBOLS, ""))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    noisy = F.regexp_count(line, F.lit(r"(?:[!?]{2,}|[#*$%&<>]+[.,;:!?]*)(?=[\x20\x09-\x0D]|$)"))
    bars = F.regexp_count(line, F.lit(r"[\x20\x09](?:\||»|>|•|·)[\x20\x09]"))
    phrase = lower.rlike("|".join(BOILERPLATE)) & (words < 30)
    different = F.size(F.array_distinct(F.split(line, r"[\x20\x09-\x0D]+")))
    return (noisy * 10 <= words * 3) & (symbols * 10 <= chars) & ((bars < 3) | (bars * 6 < words)) & ~phrase & ((words < 10) | (different * 5 >= words))


def with_quality(df: DataFrame) -> DataFrame:
    """``df`` with the base figures, ``base_failed``, ``cleaned`` (the text's lines that pass) and ``kept``.

    Null and empty texts have no words and fail; repeated rows are judged each; extra columns pass through, but
    those of the names that are added here are replaced.
    """
    text, w, lines, good = text_or_empty(F.col("text")), own("w"), own("lines"), own("good")
    df = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")
    cols = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumns({w: words_of(F.col("text")), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumn(good, F.filter(lines, line_passes))
    dense = lambda x: F.length(F.translate(x, GAP_CHARS, ""))
    df = df.select(
        *cols,
        F.size(w).cast("long").alias("n_words"),
        dense(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(n_repeat_words(w)).cast("long").alias("n_repeat_words"),
        F.array_join(good, "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (dense(F.col("cleaned")) >= LEAST_KEPT * F.col("word_chars")))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns; text holds the lines that pass and n_chars (if there) its length."""
    whole = own("record")  # the columns travel as one, so that none can meet those added here
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    record = F.col(whole).withField("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        record = record.withField("n_chars", F.length("cleaned").cast(docs.schema["n_chars"].dataType))
    return with_quality(packed).where("kept").select(record.alias(whole)).select(f"{whole}.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
