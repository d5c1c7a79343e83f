"""Operator 8, token ids in binary files of directly addressable codes.

An id is split into 8-bit chunks, low first. Level k holds the k-th chunk of every id that reaches it, a bitmap says which of them continue
on level k + 1, and a rank directory counts the set bits before each word of the bitmap. Any token is found
by one look at each level, without decoding a block.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, read_table, ship, text_or_empty

END_ID, SEGMENT_TOKENS = 2, 1 << 20
MAGIC = b"TWDC0001"
_WORD_BITS = 512


class DirectCodes:
    """A sequence of unsigned 32-bit integers as levels of bytes with continuation bitmaps and rank directories.

    Layout, little-endian: number of values (8 bytes), number of levels (4), then for each level the count of its chunks (8), the
    chunks, the bitmap (padded to whole words of 512 bits) and the rank directory (8 bytes for each word).
    """

    def __init__(self, buf: bytes | memoryview):
        buf = memoryview(buf)
        self.n, levels = struct.unpack_from("<QI", buf, 0)
        at, self.levels = 12, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", buf, at)
            words = -(-n // _WORD_BITS)
            chunks = np.frombuffer(buf, np.uint8, n, at + 8)
            bits = np.frombuffer(buf, np.uint8, words * _WORD_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(buf, "<u8", words, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 8 * words
        self.size = at

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        parts, rest, levels = [], ids.astype(np.uint32), 0
        while len(rest) or not levels:
            more = rest > 0xFF
            words = -(-len(rest) // _WORD_BITS)
            bits = np.zeros(words * _WORD_BITS // 8, np.uint8)
            packed = np.packbits(more, bitorder="little")
            bits[: len(packed)] = packed
            counts = np.bitwise_count(bits.reshape(words, -1)).sum(axis=1, dtype=np.uint64) if words else np.zeros(0, np.uint64)
            ranks = np.cumsum(counts, dtype=np.uint64) - counts
            parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
            rest, levels = rest[more] >> 8, levels + 1
        return struct.pack("<QI", len(ids), levels) + b"".join(parts)

    def all(self) -> np.ndarray:
        """Every value, level by level from the last."""
        higher = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            values[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= higher << np.uint32(8)
            higher = values
        return higher

    def __getitem__(self, i: int) -> int:
        """The i-th value, by one rank a level."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            word, byte = i // _WORD_BITS, i >> 3
            inside = np.bitwise_count(bits[word * _WORD_BITS // 8 : byte]).sum() + int(bits[byte] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[word]) + int(inside), shift + 8
        return value


#: Like the tokenizer's own pattern, over characters for which Python's classes mean the same.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: Latin letters, and ASCII marks: in that pattern no piece holds both.
_LETTERS, _MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+"), string.punctuation


def _unsafe_chars() -> re.Pattern:
    """Characters whose class may differ between the two regex engines; texts with one are encoded in one piece."""
    odd = [c for c in range(0x2000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn") or 0x1C <= c <= 0x1F or c == 0x85]
    return re.compile("[" + "".join(map(re.escape, map(chr, odd))) + " -‏ -  -\U0010ffff]")


class PieceEncoder:
    """Token ids of whole texts. The tokenizer treats each piece of its pre-tokenizing pattern alone, and no piece goes on after
    a space or line end, so the ids of what stands between these are asked of it once and kept; beyond ``keep`` the memory starts anew."""

    def __init__(self, path: str, keep: int = 800_000):
        # Tasks share the machine's cores already; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe, self.keep, self.known = _unsafe_chars(), keep, {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line[0] if len(line) == 1 else -1
        # The same model over lines whose bytes are already its characters: letters need no pattern and no second form of the text.
        as_chars = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars = {c: as_chars.pre_tokenize_str(chr(c))[0][0] for c in range(0x250)}
        self.lines = Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre_tokenizers.Split(self.chars[10], "isolated")
        self.tails: dict[str, bytes] = {}
        probe = "\n the\n Überßtraße\n I\n naïveté\n qxzjk\n don"
        self.plain = self.lines.encode(probe.translate(self.chars), add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _keys(self, text: str) -> tuple[list[str], bool] | None:
        """Keys of what to join the ids of, and whether they are words between single spaces and line ends; None if the text must be encoded whole."""
        if any(s in text for s in self.special):
            return None
        # A line end stays with what follows it; the space before all others but the first was taken by the split.
        keys = text.replace("\n", " \n").split(" ")
        words = text.split()
        # With one space or line end between words and no other white space the pattern is not needed.
        if len(words) == len(keys) and sum(map(len, words)) + len(words) - 1 == len(text) and "\0" not in text:
            keys[0] = f"\0{keys[0]}"
            return keys, True
        return None if self.unsafe.search(text) else ([f"\0{p}" for p in _PIECES.findall(text)], False)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, keys: set[str]) -> None:
        """Words are asked of the tokenizer in one text of lines and cut at the line ends' ids, as no piece goes on after a line end."""
        after_line = [k for k in keys if k[0] in "\0\n"]
        after_space = self._learn_plain(keys.difference(after_line)) if self.plain else list(keys.difference(after_line))
        for words, text in ((after_space, "\n " + "\n ".join(after_space)), (after_line, "\n" + "\n".join([k[1:] for k in after_line]))):
            if not words:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(ids == self.line_end)[0]
            if len(at) != len(words):
                self._learn(words)
                continue
            raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.known.update(zip(words, [raw[lo + 4 : hi] for lo, hi in zip(at, at[1:], strict=False)], strict=True))
            line = raw[:4]
            for k in words if words is after_line else ():
                if k[0] == "\n":
                    self.known[k] = line + self.known[k]

    def _learn_plain(self, words: set[str]) -> list[str]:
        """Learns those words after a space that are letters and then marks, as no piece holds both; gives the others. Letters are asked once for all the marks they occur with."""
        plain, others = {}, []
        for w in words:
            x = w.rstrip(_MARKS)
            if _LETTERS.fullmatch(x):
                plain[w] = x
            else:
                others.append(w)
        letters = list(set(plain.values()).difference(self.known))
        if letters:
            ids = np.array(self.lines.encode_batch_fast([("\n " + "\n ".join(letters)).translate(self.chars)], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(ids == self.line_end)[0]
            if len(at) != len(letters):
                return list(words)
            raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.known.update(zip(letters, [raw[lo + 4 : hi] for lo, hi in zip(at, at[1:], strict=False)], strict=True))
        for w, x in plain.items():
            if len(x) < len(w):
                t = w[len(x) :]
                if t not in self.tails:
                    self.tails[t] = self._whole(t)
                self.known[w] = self.known[x] + self.tails[t]
        return others

    def _learn(self, keys: Iterable[str]) -> None:
        keys = list(keys)
        for k, e in zip(keys, self.tokenizer.encode_batch_fast([_text_of(k) for k in keys], add_special_tokens=False), strict=True):
            self.known[k] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.keep:
            self.known.clear()
            self.tails.clear()
        keys = [self._keys(t) for t in texts]
        for learn, even in ((self._learn_words, True), (self._learn, False)):
            learn(set().union(*(k[0] for k in keys if k is not None and k[1] == even)).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, k[0])) if k is not None else self._whole(t) for t, k in zip(texts, keys, strict=True)]


def _text_of(key: str) -> str:
    """The text that a key stands for: itself after a mark or a line end, else with a space before it."""
    return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else f" {key}"


def _groups(ids: list, texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of about so many characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield ids[start : i + 1], texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("codes", pa.binary())])


def _segment(part: int, segment: int, ids: list, encoded: list[bytes]) -> pa.RecordBatch:
    """A segment's bytes: magic, number of documents, ids and their null flags, token counts, then the codes of all tokens."""
    tokens = np.frombuffer(b"".join(encoded), "<u4")
    head = struct.pack("<Q", len(ids)) + np.array([0 if i is None else i for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)
    blob = MAGIC + head + np.array([len(e) // 4 for e in encoded], "<u8").tobytes() + DirectCodes.encode(tokens)
    return pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "n_docs": [len(ids)], "n_tokens": [len(tokens)], "codes": [blob]}, schema=_SEGMENT)


def open_segment(blob: bytes) -> tuple[list, np.ndarray, DirectCodes]:
    """Document ids, token counts and codes of a segment."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<Q", blob, 8)
    ids, none = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, np.uint8, n, 16 + 8 * n)
    counts = np.frombuffer(blob, "<u8", n, 16 + 9 * n).astype(np.int64)
    return [None if x else i for i, x in zip(ids.tolist(), none.tolist(), strict=True)], counts, DirectCodes(memoryview(blob)[16 + 17 * n :])


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer_path: str, *, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The token files of (doc_id, text): a table in the shared folder with one row a segment, in ascending doc_id order.

    Each document's ids are followed by ``end_id``. Range partitions of doc_id and a hash of the text, so that no id, however
    often it occurs, lands in one task; null ids come first. Null text is empty and gives the end id alone. Equal rows are written each.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, ids, done, size = 0, 0, [], [], 0
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for some, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = [c + end for c in encoder(texts)]
                ids += some
                done += codes
                size += sum(map(len, codes)) // 4
                if size >= segment_tokens:
                    yield _segment(part, segment, ids, done)
                    segment, ids, done, size = segment + 1, [], [], 0
        if ids:
            yield _segment(part, segment, ids, done)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    segments = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, "part int, segment int, n_docs long, n_tokens long, codes binary")
    return scratch.store(segments, "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens and the crc of its ids, which are decoded."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "codes")), strict=True):
                ids, counts, codes = open_segment(blob)
                raw, ends = memoryview(codes.all().astype("<u4").tobytes()), np.cumsum(counts)
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ids), pa.int32()), "segment": pa.array([segment] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "at": pa.array(ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    docs = files.select("part", "segment", "codes").mapInArrow(decode, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Starts: parts are as many as partitions; segments are summed within their part.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    starts = files.select("part", "segment", inside.alias("inside"), "n_tokens").drop("n_tokens").join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("inside")).alias("first"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the token files of all documents and reads them back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, Scratch(spark, "tokens"), str(tokenizer_path)))
