"""Operator 11: fill-in-middle, by a two-pass streaming matcher.

The first pass runs a lazy match iterator over a text and counts its units; two hashes of the id choose ranks among them. The second pass
runs the iterator again, up to the larger rank, and notes where both end. No list of units is ever held, so the memory of a row is its text and its output.

Defined cases: a null text is empty; an empty text, or one that holds a mark, stays plain. A null doc_id counts as "" in the hash. Repeated rows
give repeated results, an empty table an empty one. The forms need the integer id and the text only; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import read_table, ship, text_or_empty

#: Lines with their ends, the last perhaps without.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of text that are handed on in one batch, about.
BATCH_CHARS = 4_000_000


class Rates(NamedTuple):
    """Of a hundred texts, how many are cut, and how many of those put the suffix first."""

    cut: int = 100
    suffix_first: int = 50


class Cut(NamedTuple):
    """Units of a text, its form, and the characters at which prefix and middle end (None if plain)."""

    n: int
    form: str
    prefix_end: int | None = None
    middle_end: int | None = None


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(text: str, doc_id: int | None, units: re.Pattern, seed: int, rates: Rates) -> Cut:
    """Where ``text`` is cut. Two passes of a match iterator: one counts, one stops at both ranks."""
    n = sum(1 for _ in units.finditer(text))
    first, second, whether, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rates.cut:
        return Cut(n, "plain")
    low, high = sorted((first % (n + 1), second % (n + 1)))
    ends, at = [], 0
    matches = units.finditer(text)
    for steps in (low, high - low):
        for m in islice(matches, steps):
            at = m.end()
        ends.append(at)
    return Cut(n, "spm" if order % 100 < rates.suffix_first else "psm", *ends)


def render(text: str, c: Cut) -> str:
    """The text in its form."""
    if c.form == "plain":
        return text
    prefix, middle, suffix = text[: c.prefix_end], text[c.prefix_end : c.middle_end], text[c.middle_end :]
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if c.form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``render`` was given. The marks occur once each: a text that holds one stays plain, and no end of a part can join a mark to a second one."""
    if form == "plain":
        return output
    outer, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(outer) :].partition(inner)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, *, units: str = LINES, seed: int = 7, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of (doc_id, text). ``units`` must match every character of a text once."""
    pattern = re.compile(units)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, chars = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                i, t = doc_id.as_py(), text.as_py()
                c = cut(t, i, pattern, seed, rates)
                plain = c.form == "plain"
                rows.append((i, c.n, c.form, None if plain else c.prefix_end, None if plain else c.middle_end - c.prefix_end, render(t, c)))
                chars += len(t)
                if chars >= BATCH_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
        if rows:
            yield batch(rows)

    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(formed: DataFrame) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, output, form): the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restore(o.as_py(), f.as_py()) for o, f in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ship(formed.sparkSession)
    return formed.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, text string")


def _digests(formed: DataFrame) -> DataFrame:
    """What the contract asks of ``fill_in_middle``'s rows: hashes of the output and of the text rebuilt from it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outputs, forms = b.column(5), b.column(2)
            one, two = [], []
            for o, f in zip(outputs, forms, strict=True):
                text = o.as_py()
                one.append(hashlib.sha256(text.encode()).hexdigest())
                two.append(hashlib.sha256(restore(text, f.as_py()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(one, pa.string()), pa.array(two, pa.string())], names=[*b.schema.names[:5], "output_sha256", "restored_sha256"])

    return formed.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by lines, with the hashes of its output and of what is rebuilt from it."""
    return _digests(fill_in_middle(read_table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS low, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(lines[1:low], ''), '') AS a, coalesce(array_to_string(lines[low + 1:high], ''), '') AS b, coalesce(array_to_string(lines[high + 1:], ''), '') AS c FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
