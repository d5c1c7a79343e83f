"""Operator 12: toxicity by bags of subwords, averaged into a linear softmax and trained jointly with it in numpy.

A word is the mean of the vectors of its character n-grams (hashed, with marks at both ends), so a misspelling that training never met
shares most of its vectors with the word it comes from. A passage of ``WINDOW`` words is the mean of its words; words that a shorter text
lacks count as zero vectors. A document's score is that of its worst passage, so that a long text does not water down an insult; the
gradient of a training step goes to that passage alone. As the model is linear after the mean, a trained word is one number, and scoring a
text is a sliding mean over them.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` a class, by hash of the id, texts of at most ``SAMPLE_CHARS``
characters); its size does not depend on the data. Every whole text is scored.

Defined cases: a null text is empty; empty texts have no words and get the score of a passage without words. A null doc_id counts as "" for the fold.
Repeated rows give repeated results; labels that contradict each other for one id count as toxic; null labels teach nothing. If a class has
no labelled row (an empty table too), every score is the share of toxic labels, 0 without any. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import read_table, ship, text_or_empty

#: Rows of each class that the sample holds at most, and the characters of its longest text.
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 12_000
WINDOW = 5
BUCKET_BITS, DIM, SHORTEST, LONGEST = 18, 12, 3, 6
STEPS, BATCH, RATE, SHRINK = 900, 64, 1.0, 1e-4
#: The share of texts that training meets with a slip in every word (else a passage without one would be the worst), and the slips of each word that it knows.
MISSPELT, SLIPS = 0.3, 3
#: The share of words that a step sees of a text: the strongest insult is hidden now and then, so that weaker ones are learnt too.
SHOWN = 0.85
#: A longer run without a break is cut, so that a text without spaces has passages too.
WORD_CHARS = 40
#: Words whose values a task keeps at most.
CACHE_WORDS = 400_000

#: Letters and digits, joined by the signs that stand for letters in masked words.
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!#]+[^\W_]+)*")
_LOOKALIKE = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}
_PRIME, _MIX = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    """The lower-cased words of a text; a word that follows itself counts once."""
    out = [w for w, _ in groupby(_TOKEN.findall(text.lower()))]
    if len(text) > WORD_CHARS and any(len(w) > WORD_CHARS for w in out):
        out = [w[i : i + WORD_CHARS] for w in out for i in range(0, len(w), WORD_CHARS)]
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every n-gram of every marked word, and of each whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(chars))  # characters from here to the end of the word
    buckets, owners = [], []

    def add(codes: np.ndarray, of: np.ndarray, kind: int) -> None:
        mixed = (codes + np.uint64(kind)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        buckets.append(((mixed * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(of)

    code = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        shifted = chars[n - 1 :]
        code = code[: len(shifted)] * _PRIME + shifted
        if n >= SHORTEST:
            inside = left[: len(code)] >= n
            add(code[inside], owner[: len(code)][inside], n)
    powers = np.cumprod(np.full(int(sizes.max()), _PRIME, np.uint64))
    whole = np.add.reduceat(chars * powers[(sizes[owner] - left)], ends - sizes)
    add(whole, np.arange(len(words)), 0)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """One value a bucket: a word's value is their mean, a passage's the mean of its words, its odds ``exp(value + bias)``."""

    values: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        buckets, owners = subwords(words)
        n = np.bincount(owners, minlength=len(words))
        return np.bincount(owners, self.values[buckets], minlength=len(words)) / np.maximum(n, 1)


def worst_passage(values: np.ndarray) -> tuple[int, float]:
    """Where the passage of the highest mean begins, and that mean."""
    if len(values) <= WINDOW:
        return 0, float(values.sum()) / WINDOW
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
    at = int(means.argmax())
    return at, float(means[at])


def _misspell(word: str, rng: np.random.Generator) -> str:
    """One slip: a letter left out, doubled, swapped with the next, or written as a digit that looks like it."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + _LOOKALIKE.get(word[i], word[i]) + word[i + 1 :]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], toxic: np.ndarray, toxic_share: float, *, seed: int = 12, steps: int = STEPS) -> Model:
    """Embeddings and softmax from labelled texts of both classes, by Adagrad steps on batches of half of either class.

    Batches are balanced; the bias is moved to ``toxic_share`` at the end. Each step, some texts of either class are met with slips.
    """
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_in(t)], np.int64) for t in texts]
    vocabulary = list(index) or [""]
    both = vocabulary + [_misspell(w, rng) for _ in range(SLIPS) for w in vocabulary]
    buckets, counts = [], []
    for i in range(0, len(both), 20_000):
        some = both[i : i + 20_000]
        of, owners = subwords(some)
        buckets.append(of[np.argsort(owners, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owners, minlength=len(some)))
    buckets, starts = np.concatenate(buckets), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = starts[words + 1] - starts[words]
        return buckets[np.repeat(starts[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    weights, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_w, seen_b = np.full((1 << BUCKET_BITS, DIM), 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    classes = [np.flatnonzero(toxic == k) for k in (0, 1)]
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        picked = [int(i) for k in (0, 1) for i in rng.choice(classes[k], BATCH // 2)]
        shown = [docs[i][rng.random(len(docs[i])) < SHOWN] for i in picked]
        bags = [d + len(vocabulary) * (rng.integers(1, SLIPS + 1, len(d)) if rng.random() < MISSPELT else 0) for d in shown]
        here, back = np.unique(np.concatenate(bags), return_inverse=True)
        direction = weights[:, 1] - weights[:, 0]
        grams, sizes = grams_of(here)
        values = (np.add.reduceat((vectors @ direction)[grams], np.cumsum(sizes) - sizes) / sizes)[back] if len(here) else np.zeros(0)
        # Vectors are needed for the worst passages only.
        bounds, spans = np.concatenate(([0], np.cumsum([len(b) for b in bags]))), []
        for k in range(len(picked)):
            first, _ = worst_passage(values[bounds[k] : bounds[k + 1]])
            spans.append(bags[k][first : first + WINDOW])
        met, owner = np.concatenate(spans), np.repeat(np.arange(len(picked)), [len(s) for s in spans])
        grams, sizes = grams_of(met)
        of_gram, share = np.repeat(owner, sizes), np.repeat(1 / (WINDOW * np.maximum(sizes, 1)), sizes).astype(np.float32)
        used, place = np.unique(grams, return_inverse=True)
        # How much of each n-gram is in each passage.
        mix = np.bincount(of_gram * len(used) + place, share, minlength=len(picked) * len(used)).reshape(len(picked), len(used)).astype(np.float32)
        means = mix @ vectors[used]
        wrong = (_softmax(means @ weights + bias) - np.eye(2, dtype=np.float32)[toxic[picked]]) / len(picked)
        step_v = mix.T @ (wrong @ weights.T) + SHRINK / len(picked) * vectors[used]
        step_w, step_b = means.T @ wrong + SHRINK * weights, wrong.sum(axis=0)
        for held, seen, g, where in ((vectors, seen_v, step_v, used), (weights, seen_w, step_w, slice(None)), (bias, seen_b, step_b, slice(None))):
            seen[where] += g * g
            held[where] -= rate * g / np.sqrt(seen[where])
    odds = np.log(toxic_share / (1 - toxic_share))
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0] + odds))


def scorer(model: Model):
    """texts -> scores. Values of words are kept between calls."""
    kept: dict[str, float] = {}

    def score(texts: list[str]) -> list[float]:
        bags = [words_in(t) for t in texts]
        if len(kept) > CACHE_WORDS:
            kept.clear()
        new = list({w for b in bags for w in b if w not in kept})
        for i in range(0, len(new), 50_000):
            kept.update(zip(new[i : i + 50_000], model.of_words(new[i : i + 50_000]).tolist(), strict=True))
        out = []
        for b in bags:
            value = worst_passage(np.fromiter(map(kept.__getitem__, b), np.float64, len(b)))[1] + model.bias
            out.append(float(1 / (1 + np.exp(-np.clip(value, -60, 60)))))
        return out

    return score


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample_of(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, float]:
    """Texts and marks of at most ``rows`` labelled rows a class that are not held out, and the share of toxic labels among all of those.

    The ids are drawn by hash from the labels alone, so the documents are read once and not shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    known = known.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = n_toxic / n if n else 0.0
    if n_toxic in (0, n):
        return [], np.zeros(0, np.int64), share
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).where(F.length("text") <= chars)
    # Repeated ids could multiply rows: each (text, mark) is met once, and the first of them by hash are taken.
    met = texts.join(F.broadcast(drawn[0].unionAll(drawn[1])), "doc_id").select("text", "toxic").distinct()
    got = [met.where(F.col("toxic") == k).orderBy(F.xxhash64("text"), "text").limit(rows).collect() for k in (0, 1)]
    return [r["text"] for g in got for r in g], np.array([r["toxic"] for g in got for r in g], np.int64), share


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled documents that are not held out."""
    texts, toxic, share = sample_of(docs, labels, rows=rows)
    if len(set(toxic.tolist())) < 2:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))
    return train(texts, toxic, share)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.values, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(Model(*shared.value))
        for b in batches:
            out = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are never met."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def fold_by_hand(doc_id: int | None) -> int:
    """``fold_of`` for one id in Python."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5
