"""Operator 6, quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

N-grams are counted over one half of all trusted documents, in shards by n-gram key, and the model stays in those shards: no task and no driver holds more than
the vocabulary. Documents are scored by a join: their n-grams, put together by document and key, go to the shards, and sums for documents come back.
Every document's log perplexity is held against its language's threshold, which lies between quantiles of the scores of all labelled documents.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taktwerk.llm.common import Scratch, n_words, own, read_table, ship, text_or_empty

#: Bytes of text for a shard of the model; rounds of scoring: each deals out the n-grams of a part of the documents, and its shuffle files go before the next.
SHARD_BYTES, LEAST_SHARDS, ROUNDS = 24_000_000, 12, 4
#: Words seen this often in the trusted documents are tokens of their own; others count as their shape.
VOCABULARY_COUNT = 3
#: The threshold lies midway between these quantiles of trusted and of rejected labelled documents.
TRUSTED_QUANTILE, REJECTED_QUANTILE = 0.995, 0.05
#: Words of the mean trusted surprise that every document's own is averaged with, so that a very short text is not judged by one rare word.
PRIOR_WORDS = 20

#: Tokens whose n-grams go to the shards together.
CHUNK_TOKENS = 1_000_000
#: Bits that tell which documents may be trusted: 4 MiB in all. Beyond some ten million trusted documents more of the others pass; the join that follows is exact.
ID_BITS = 1 << 25
#: A shard's sum for a document comes back in whole parts of 1 / UNIT: shorter than doubles, and equal in whatever order shards answer.
UNIT = 1 << 30

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"([Xx9])\1+")
_ASCII = {k: "X" if chr(k).isupper() else "x" if chr(k).islower() else "9" for k in range(128) if chr(k).isalnum()}


def _token_id(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shape_of(word: str) -> str:
    """The kind of a word outside the vocabulary: runs of capitals, small letters, other letters and digits, and its marks as they are."""
    if word.isascii():
        kinds = _RUN.sub(r"\1", word.translate(_ASCII))
        return "\0" + (kinds[:13] + "+" if len(kinds) > 12 else kinds)
    kinds = []
    for ch in word:
        kind = "X" if ch.isupper() else "x" if ch.islower() else "o" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not kinds or kinds[-1] != kind or kind not in "Xxo9":
            kinds.append(kind)
        if len(kinds) > 12:
            kinds.append("+")
            break
    return "\0" + "".join(kinds)


class Tokens:
    """Token numbers of texts: ranks by frequency of vocabulary words and of shapes of others, so that most numbers are small and n-grams compress well; what training never saw has the number after the last.

    A word that repeats the one before it has that number too: training leaves repeats out, so the model falls back to lower orders after it."""

    START = _token_id("\0start")

    def __init__(self, names: np.ndarray, frequent: np.ndarray, number: np.ndarray, keep: int = 200_000):
        """``names``: sorted ids of all tokens; ``frequent``: whether each is a vocabulary word; ``number``: its token number."""
        self.names, self.frequent, self.number, self.keep, self.known, self.shapes = names, frequent, number, keep, {}, {}
        self.start = self._place(self.START)

    def _place(self, token: int) -> int:
        at = int(np.searchsorted(self.names, np.uint64(token)))
        return int(self.number[at]) if at < len(self.names) and self.names[at] == token else len(self.names)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.keep:
            self.known.clear()
        ids = np.array([_token_id(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.names, ids), len(self.names) - 1)
        own = (self.names[at] == ids) & self.frequent[at]
        for w, i, vocabulary in zip(words, self.number[at].tolist(), own.tolist(), strict=True):
            if not vocabulary:
                shape = shape_of(w)
                i = self.shapes.get(shape)
                if i is None:
                    if len(self.shapes) > self.keep:
                        self.shapes.clear()
                    i = self.shapes[shape] = self._place(_token_id(shape))
            self.known[w] = i

    def __call__(self, text: str, collapse: bool = False) -> np.ndarray:
        """The numbers after two start marks; ``collapse`` leaves repeats out, as for training: the model shall not expect them."""
        known, words = self.known, _WORD.findall(text)
        if collapse:
            words = words[:1] + [b for a, b in zip(words, words[1:], strict=False) if a != b]
        ids = [known.get(w) for w in words]
        if None in ids:
            new = list(dict.fromkeys(w for i, w in zip(ids, words, strict=True) if i is None))
            self._learn([*new, *{w for i, w in zip(ids, words, strict=True) if i is not None}] if len(known) > self.keep else new)
            ids = [known[w] for w in words]
        out = np.empty(len(ids) + 2, np.int64)
        out[:2] = self.start
        out[2:] = ids
        if not collapse:  # equal words have equal numbers, but so have words of one shape
            alike = np.nonzero(out[3:] == out[2:-1])[0].tolist()
            if same := [i + 3 for i in alike if words[i] == words[i + 1]]:
                out[same] = len(self.names)
        return out


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length; the first is sorted. Bytes of equal weight stand together, so that they compress."""
    first = np.diff(columns[0], prepend=0)
    raw = [np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in (first, *columns[1:])]
    return len(first).to_bytes(8, "little") + pa.compress(b"".join(raw), "zstd", asbytes=True)


def _unpack(data: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * n_columns * 8, "zstd", asbytes=True)
    out = [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in np.frombuffer(raw, np.uint8).reshape(n_columns, 8, n)]
    return [np.cumsum(out[0]), *out[1:]]


def _unpacked(blobs: list[bytes], n_columns: int) -> list[np.ndarray]:
    parts = [_unpack(x, n_columns) for x in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(n_columns)]


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pair of tokens, given by its number."""
    return key % 1_000_000_007 % shards


def _dealt(key: np.ndarray, shards: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, packed columns after the key) of rows, each to the shard of its key."""
    shard = _shard(key, shards)
    order = np.lexsort((key, shard)) if len(key) and int(key.max()) > (1 << 62) // shards else np.argsort(shard * (int(key.max()) + 1 if len(key) else 1) + key)
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        if ends[k] < ends[k + 1]:
            part = order[ends[k] : ends[k + 1]]
            yield k, _pack(key[part], *[x[part] for x in columns])


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.nonzero(new)[0]


def _sums(n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each run: the sum of n, and how often it is 1, 2, and 3 or more."""
    return [np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for x in (n, n == 1, n == 2, n >= 3)]


def _times(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(times: list[int]) -> np.ndarray:
    """The discounts of modified Kneser-Ney for counts of 0, 1, 2, and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = times
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *[min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]])


def _lowered(n: np.ndarray, total: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (n - d[np.minimum(n, 3)]) / total


def _back(sums: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    return (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / sums[0]


@dataclass
class Words:
    """What every task knows of single tokens: by sorted id, which are vocabulary and their numbers; by number, probability, back-off weight and the sum of the pairs that they begin. These have a last place for what is unknown."""

    names: np.ndarray
    frequent: np.ndarray
    number: np.ndarray
    p: np.ndarray | None = None
    back: np.ndarray | None = None
    total: np.ndarray | None = None


@dataclass
class Model:
    """``words`` for all tasks; ``stored`` (shard, what, data) of the counts of pairs and trigrams, in buckets by shard so that a round's questions come to it and it stays where it is; discounts of both, ``start`` -ln of the back-off weight of the two start marks."""

    words: Words
    stored: DataFrame
    n_shards: int
    pair_cut: np.ndarray
    triple_cut: np.ndarray
    start: float


def _chunks(texts: list[str], tokens: Tokens, collapse: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first, tokens) of some texts at a time."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(tokens(t, collapse))
        size += len(held[-1])
        if size >= CHUNK_TOKENS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _abc(held: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate([x[k : len(x) - 2 + k] for x in held]) for k in range(3)]


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids``, so that a join does not move the texts of others. Told by ID_BITS bits, broadcast as bitmaps of 4 KiB at most."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    maps = ids.groupBy(F.bitmap_bucket_number(bit).alias(own("bucket"))).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(own("bits")))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(own("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn(own("bucket"), F.bitmap_bucket_number(bit)).join(F.broadcast(maps), own("bucket"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop(own("bucket"), own("bits"))


def train(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> Model | None:
    """The model of all ``trusted`` documents; None if they have no word."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, size // SHARD_BYTES)
    ids = scratch.store(trusted.select("doc_id").distinct(), "trusted-ids")
    chosen = scratch.store(_perhaps(docs.where(F.col("text").isNotNull()), ids).join(ids, "doc_id").select("text"), "trusted")
    scratch.drop(ids)
    scratch.release()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(_WORD.findall(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times: Counter[tuple[int, bool]] = Counter()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                often = n >= VOCABULARY_COUNT
                times[_token_id(w if often else shape_of(w)), often] += n
            names = np.array([i for i, _ in times], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([o for _, o in times], pa.bool_()), pa.array(list(times.values()), pa.int64())], names=["id", "often", "n"])

    words = chosen.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = words.mapInArrow(named, "id long, often boolean, n long").groupBy("id").agg(F.max("often").alias("often"), F.sum("n").alias("n")).toArrow()
    del words  # its shuffle files can go
    if not table.num_rows:
        return None
    names = np.append(table["id"].to_numpy().view(np.uint64), np.uint64(Tokens.START))
    often = np.append(table["often"].to_numpy(zero_copy_only=False), False)
    by_id, by_count = np.argsort(names), np.lexsort((names, -np.append(table["n"].to_numpy(), 0)))
    number = np.empty(len(names), np.int32)
    number[by_count] = np.arange(len(names))
    known = Words(names[by_id], often[by_id], number[by_id])
    v = len(names) + 1
    shared = spark.sparkContext.broadcast(known)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value.names, shared.value.frequent, shared.value.number)
        for batch in batches:
            for _, held in _chunks(batch.column(0).to_pylist(), tokens, True):
                a, b, c = _abc(held)
                rows = list(_dealt(a * v + b, shards, c))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "data"])

    shard_schema = "shard int, what string, data binary"

    def rows_of(rows: list[tuple[int, str, bytes]]) -> pa.Table:
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "what", "data"])

    def by_first(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        # Counts of trigrams with the sums of their first two tokens, handed on to the shards of their last two.
        ab, c = _unpacked(t["data"].to_pylist(), 2)
        order = np.lexsort((c, ab))
        ab, c = ab[order], c[order]
        at = _runs(ab, c)
        n = np.diff(np.append(at, len(ab)))
        ab, c = ab[at], c[at]
        at = _runs(ab)
        sums = _sums(n, at)
        each = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ab))))
        out = [(k, "triples", x) for k, x in _dealt(ab % v * v + c, shards, ab // v, n, *[x[each] for x in sums])]
        out.append((key[0].as_py(), "backs", _pack(ab[at], *sums)))
        out.append((-1, "times", np.array(_times(n)).tobytes()))
        return rows_of(out)

    triples = scratch.store(chosen.mapInArrow(grams, "shard int, data binary").groupBy("shard").applyInArrow(by_first, shard_schema), "triples")
    scratch.drop(chosen)
    scratch.release()
    times = lambda df: np.sum([np.frombuffer(r[0], np.int64) for r in df.where("what = 'times'").select("data").collect()], axis=0).tolist()

    def by_last(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        # Pairs with the number of tokens that stand before them; all that the shard holds in one piece each.
        what, data, k = t["what"].to_pylist(), t["data"].to_pylist(), key[0].as_py()
        part = _unpacked([x for w, x in zip(what, data, strict=True) if w == "triples"], 7)
        order = np.lexsort((part[1], part[0]))
        part = [x[order] for x in part]
        at = _runs(part[0])
        n = np.diff(np.append(at, len(part[0])))
        backs = _unpacked([x for w, x in zip(what, data, strict=True) if w == "backs"], 5)
        return rows_of([(k, "triples", _pack(*part)), (k, "pairs", _pack(part[0][at], n)), (k, "backs", _pack(*backs)), (-1, "times", np.array(_times(n)).tobytes())])

    model = scratch.store(triples.where("shard >= 0").groupBy("shard").applyInArrow(by_last, shard_schema), "model", buckets=(shards, "shard"))
    triple_cut, pair_cut = _discounts(times(triples)), _discounts(times(model))
    scratch.drop(triples)
    scratch.release()

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                bc, n = _unpack(data, 2)
                at = _runs(bc // v)
                c, before = np.unique(bc % v, return_counts=True)
                none = [np.zeros(len(c), np.int64)] * 4
                cols = [np.concatenate(x) for x in zip([(bc // v)[at], np.zeros(len(at), np.int64), *_sums(n, at)], [c, before, *none], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "n", "total", "n1", "n2", "n3"])

    one = model.where("what = 'pairs'").select("data").mapInArrow(singles, "token long, n long, total long, n1 long, n2 long, n3 long")
    one = one.groupBy("token").agg(*[F.sum(x).alias(x) for x in ("n", "total", "n1", "n2", "n3")]).toArrow()
    token, n, *sums = (one[x].to_numpy() for x in ("token", "n", "total", "n1", "n2", "n3"))
    seen, first = n > 0, sums[0] > 0
    cut = _discounts(_times(n))
    spread = _back([np.array([x]) for x in (n.sum(), *((n == 1).sum(), (n == 2).sum(), (n >= 3).sum()))], cut)[0]
    scratch.release()
    known.p = np.full(v, spread / (seen.sum() + 1))
    known.p[token[seen]] += _lowered(n[seen], n.sum(), cut)
    known.back, known.total = np.ones(v), np.ones(v)
    known.total[token[first]] = sums[0][first]
    known.back[token[first]] = _back([x[first] for x in sums], pair_cut)
    begin = int(known.number[np.searchsorted(known.names, np.uint64(Tokens.START))]) * (v + 1)
    backs = _unpacked([r[0] for r in model.where((F.col("what") == "backs") & (F.col("shard") == int(_shard(np.array([begin]), shards)[0]))).select("data").collect()], 5)
    start = -float(np.log(_back([x[backs[0] == begin] for x in backs[1:]], triple_cut)[0]))
    return Model(known, model, shards, pair_cut, triple_cut, start)


def score(docs: DataFrame, model: Model, columns: list[str], scratch: Scratch) -> DataFrame:
    """``columns`` of each document with ``words`` and ``surprise``, the sum over its words of -ln p.

    ln p is a sum of what single tokens give, which each task knows, of what a seen pair or trigram adds to it, and of the back-off
    weight of the pair before. The last two are asked of the pair's shard.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.words)
    shards, pair_cut, triple_cut, begin = model.n_shards, model.pair_cut, model.triple_cut, model.start
    v, n_cols = len(model.words.names) + 1, len(columns)
    fields = docs.select(*columns).schema
    out_schema = StructType([*fields.fields]).add("words", "long").add("surprise", "double")
    ask_schema = "shard int, chunk long, data binary, heads binary"
    answer_schema = "chunk long, data binary, heads binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        tokens, p, back = Tokens(w.names, w.frequent, w.number), np.log(w.p), np.log(w.back)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, held in _chunks(batch.column(n_cols).to_pylist(), tokens, False):
                a, b, c = _abc(held)
                n = np.array([len(x) - 2 for x in held])
                ends = np.cumsum(n)
                upto = np.concatenate([[0.0], np.cumsum(-p[c] - back[b])])
                base = upto[ends] - upto[ends - n] + np.where(n > 0, begin, 0.0)
                doc, last = np.repeat(np.arange(len(n)), n), np.zeros(len(a), np.int64)
                last[ends[n > 0] - 1] = 1
                sink = pa.BufferOutputStream()
                heads = pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns[:n_cols], pa.array(n.astype(np.int64)), pa.array(base)], names=[*columns, "words", "surprise"])
                with pa.ipc.new_stream(sink, heads.schema) as f:
                    f.write_batch(heads)
                # A pair with a token unseen in training is in no shard.
                use = (b < v - 1) & (c < v - 1)
                rows = list(_dealt((b * v + c)[use], shards, a[use], (2 * doc + last)[use]))
                size = len(rows) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in rows] + [chunk % shards], pa.int32()),
                        pa.array([chunk] * size, pa.int64()),
                        pa.array([x for _, x in rows] + [None], pa.binary()),
                        pa.array([None] * (size - 1) + [sink.getvalue().to_pybytes()], pa.binary()),
                    ],
                    names=["shard", "chunk", "data", "heads"],
                )
                chunk += 1

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        w, parts = shared.value, dict(zip(held["what"].to_pylist(), held["data"].to_pylist(), strict=True))
        pairs, before = _unpacked([x for k, x in parts.items() if k == "pairs"], 2)
        triples = _unpacked([x for k, x in parts.items() if k == "triples"], 7)
        backs = _unpacked([x for k, x in parts.items() if k == "backs"], 5)
        chunks, data, heads = [], [], []
        at = np.searchsorted(pairs, triples[0])
        low = w.back[pairs // v] * w.p[pairs % v]
        pair_p = _lowered(before, w.total[pairs // v], pair_cut) + low
        back_3 = _back(triples[3:7], triple_cut)
        triple_add = np.log(_lowered(triples[2], triples[3], triple_cut) + back_3 * pair_p[at]) - np.log(back_3) - np.log(low[at])
        pair_add = np.log(pair_p) - np.log(low)
        triple_key = at * v + triples[1]
        back_add = np.log(_back(backs[1:], triple_cut))

        def find(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(names):
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            return place, names[place] == keys

        for chunk, blob, head in zip(asked["chunk"].to_pylist(), asked["data"].to_pylist(), asked["heads"].to_pylist(), strict=True):
            if head is not None:
                chunks.append(chunk), data.append(None), heads.append(head)
                continue
            bc, a, doc = _unpack(blob, 3)
            add = np.zeros(len(bc))
            i, hit = find(pairs, bc)
            add[hit] = pair_add[i[hit]]
            j, full = find(triple_key, i * v + a)
            full &= hit
            add[full] = triple_add[j[full]]
            k, known = find(backs[0], bc)
            known &= doc % 2 == 0
            add[known] += back_add[k[known]]
            use = add != 0
            if use.any():
                sums = np.bincount(doc[use] // 2, add[use])
                some = np.nonzero(sums)[0]
                chunks.append(chunk), data.append(_pack(some, np.rint(sums[some] * UNIT).astype(np.int64))), heads.append(None)
        return pa.table([pa.array(chunks, pa.int64()), pa.array(data, pa.binary()), pa.array(heads, pa.binary())], names=["chunk", "data", "heads"])

    def summed(t: pa.Table) -> pa.Table:
        heads = pa.ipc.open_stream(next(x for x in t["heads"].to_pylist() if x is not None)).read_all()
        total = np.zeros(heads.num_rows, np.int64)
        for blob in t["data"].to_pylist():
            if blob is not None:
                some, add = _unpack(blob, 2)
                total[some] += add
        return heads.set_column(n_cols + 1, "surprise", pa.array(heads["surprise"].to_numpy() - total / UNIT))

    whole = docs.select(*columns, text_or_empty(F.col("text")).alias(own("text")))
    deal = F.pmod(F.xxhash64(*columns, own("text")), F.lit(ROUNDS))

    def scored(k: int) -> DataFrame:
        asked = whole.where(deal == k).mapInArrow(ask, ask_schema)
        answers = asked.groupBy("shard").cogroup(model.stored.where("shard >= 0").groupBy("shard")).applyInArrow(answer, answer_schema)
        return scratch.store(answers.groupBy("chunk").applyInArrow(summed, out_schema), "scores")

    parts = []
    for k in range(ROUNDS):  # each round's shuffle files go before the next
        parts.append(scored(k))
        scratch.release()
    return reduce(DataFrame.unionAll, parts)


def _votes(labels: DataFrame) -> DataFrame:
    """(doc_id, good) with 1 if all labels of a document say quality 1, else 0."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias(own("good")))


@dataclass
class Fitted:
    """The scores (doc_id, lang, words, surprise) of all documents, and what turns scores into verdicts."""

    scores: DataFrame
    mean: float
    overall: float | None
    cuts: DataFrame

    def judged(self, scored: DataFrame) -> DataFrame:
        """``scored`` with log_perplexity, threshold and kept."""
        value = F.when(F.col("words") > 0, (F.col("surprise") + PRIOR_WORDS * self.mean) / (F.col("words") + PRIOR_WORDS))
        out = scored.join(self.cuts, F.col("lang") == F.col(own("lang")), "left").withColumns({"log_perplexity": value, "threshold": F.coalesce(own("cut"), F.lit(self.overall).cast("double"))})
        kept = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)) & (F.col("words") > 0)
        return out.withColumn("kept", kept).drop(own("lang"), own("cut"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, columns: list[str]) -> Fitted | None:
    """Trains on one half of the trusted documents and sets thresholds by the other; None without a trusted document to train on."""
    ship(docs.sparkSession)
    votes, good, fold = _votes(labels), F.col(own("good")) == 1, F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2))
    # One half of the trusted documents trains; the other tells how the model scores clean text that it has not seen.
    model = train(docs.select("doc_id", "text"), votes.where(good & (fold == 0)), scratch)
    if model is None:
        if docs.join(votes.where(good).select("doc_id"), "doc_id").where(n_words(F.col("text")) > 0).limit(1).count():
            warnings.warn("quality classifier: no trusted document in the half that trains; without a model all documents with words are kept", stacklevel=2)
        return None
    scores = score(docs, model, columns, scratch)
    scratch.drop(model.stored)
    scratch.release()
    unseen = votes.where(~good | (fold == 1))
    labelled = scratch.store(scores.where("words > 0").join(unseen, "doc_id"), "labelled")
    mean = labelled.where(good).agg(F.sum("surprise") / F.sum("words")).first()[0] or 0.0
    labelled = labelled.withColumn("v", (F.col("surprise") + PRIOR_WORDS * mean) / (F.col("words") + PRIOR_WORDS))

    def cuts(*by: str) -> DataFrame:
        quantile = lambda side, q: F.percentile_approx(F.when(side, F.col("v")), q, 100_000)
        t = labelled.groupBy(*by).agg(quantile(good, TRUSTED_QUANTILE).alias("g"), quantile(~good, REJECTED_QUANTILE).alias("b"))
        return t.select(*by, F.when(F.col("b") > F.col("g"), (F.col("g") + F.col("b")) / 2).otherwise(F.col("g")).alias(own("cut")))

    per = scratch.store(cuts("lang").where(F.col(own("cut")).isNotNull() & F.col("lang").isNotNull()).withColumnRenamed("lang", own("lang")), "cuts")
    return Fitted(scores, mean, cuts().first()[0], per)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, threshold, kept) of each row of ``docs``.

    Trusted are documents whose labels all say quality 1, rejected ones those with a label 0. The model learns from a half of the trusted
    ones, told by a hash of doc_id; quantiles are those of the other half. A language's threshold is midway between the
    quantiles of its trusted and its rejected documents, or the trusted quantile where none is rejected or they overlap; languages without trusted
    documents, and null, take the threshold of all; with no trusted document in the other half there is none and all are kept. Documents without words
    have null perplexity and are not kept. Without a trusted document in the half that trains there is no model, and all documents with words are kept;
    a warning says so if the other half has one. Repeated rows are judged each.
    """
    if (fitted := fit(docs, labels, scratch, ["doc_id", "lang"])) is None:
        words, none = n_words(F.col("text")), F.lit(None).cast("double")
        return docs.select("doc_id", "lang", words.alias("n_words"), none.alias("log_perplexity"), none.alias("threshold"), (words > 0).alias("kept"))
    return fitted.judged(fitted.scores).select("doc_id", "lang", F.col("words").alias("n_words"), "log_perplexity", "threshold", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns. Rows of equal doc_id, lang and text have one verdict, so a hash of these names it."""
    name = own("name")
    named = docs.withColumn(name, F.xxhash64("doc_id", "lang", "text"))
    if (fitted := fit(named, labels, scratch, ["doc_id", "lang", name])) is None:
        return docs.where(n_words(F.col("text")) > 0)
    kept = fitted.judged(fitted.scores).where("kept").select(name).distinct()
    return named.join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
