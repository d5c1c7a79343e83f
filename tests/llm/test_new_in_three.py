"""Fill-in-middle, toxicity and importance resampling: brute force, round trips, held-out labels, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.llm import common, fill_in_middle as fim, importance, toxicity

SCHEMA = "doc_id long, text string, lang string, form string, output string, n long, weight string, part string, score string, toxic string"


def row(i, text):
    return (i, text, "en", "f", "o", 1, "w", "p", "s", "t")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(60)]
    rows = [row(i, "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [row(60, None), row(61, ""), row(62, "\n"), row(63, "\n\n\nx"), row(64, "ends\n"), row(65, "holds <M> a mark\nb"), row(66, "almost <S\n> a mark <\nP>\n<P\n"), row(67, "ünïcode 😀\r\nß x\n"), row(None, "no id\nhere"), row(68, "same\ntwice\n"), row(68, "same\ntwice\n")]
    rows += [row(69, "line of a long text\n" * 30_000), row(70, "x" * 200_000), row(71, "Éa éA AÉ"), row(72, "a" + "\n" * 50_000)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain_fim(i, text):
    """The contract by lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_lists_of_lines(odd, spark):
    rows, docs = odd
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim.fill_in_middle(docs).collect())
    assert got == Counter((r[0], *plain_fim(r[0], r[1])) for r in rows)
    back = Counter((r["doc_id"], r["text"]) for r in fim.restored(fim.fill_in_middle(docs)).collect())
    assert back == Counter((r[0], r[1] or "") for r in rows)
    assert {c[2] for c in got} == {"plain", "psm", "spm"}
    empty = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and fim.restored(empty).collect() == []


def test_fill_in_middle_digests(odd):
    rows, docs = odd
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in fim._digests(fim.fill_in_middle(docs)).collect())
    want = Counter()
    for r in rows:
        n, form, p, m, out = plain_fim(r[0], r[1])
        want[(r[0], n, form, p, m, digest(out), digest(r[1] or ""))] += 1
    assert got == want


def test_fill_in_middle_rates_and_units(odd):
    rows, docs = odd
    none = fim.fill_in_middle(docs, rates=fim.Rates(cut=0))
    assert {r["form"] for r in none.select("form").distinct().collect()} == {"plain"}
    by_char = fim.fill_in_middle(docs.where(F.length("text") < 2_000), units=r"(?s:.)", rates=fim.Rates(suffix_first=0))
    assert {r["form"] for r in by_char.select("form").distinct().collect()} == {"plain", "psm"}
    for r in by_char.where("form <> 'plain'").collect():
        assert fim.restore(r["output"], r["form"]).__len__() == r["n"]


def plain_importance(docs, target, longest, percent=10, least=20, buckets=10_000):
    """The contract by counters."""
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(code(f) for _, x in docs for f in features(x)[1]), Counter(code(f) for x in target for f in features(x)[1])
    S, T = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for i, x in docs:
        w, fs = features(x)
        weight = sum(gain(code(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = Counter()
    for k, r in enumerate(fit[: math.floor(percent * len(fit) / 100)], 1):
        ranks[(*r[:4], k)] += 1
    for r in [*fit[math.floor(percent * len(fit) / 100) :], *(r for r in out if r[4] < least)]:
        ranks[(*r[:4], None)] += 1
    return ranks


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("nodes", [30, 500_000])
def test_importance_equals_counters(odd, spark, longest, nodes, monkeypatch):
    monkeypatch.setattr(importance, "TRIE_NODES", nodes)
    rows, docs = odd
    target = [("wort1 wort2 WORT3 é",), ("wort1 neu",), (None,), ("",)]
    got = importance.resample(docs, spark.createDataFrame(target, "text string"), common.Scratch(spark, "t"), longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_importance([r[:2] for r in rows], [t[0] for t in target], longest)


def test_importance_of_hot_and_empty_rows(spark):
    schema = "doc_id long, text string"
    hot = [(None, "a b c " * 10)] * 300 + [(i, "a d e " * 10) for i in range(100)]
    target = spark.createDataFrame([("a e",)], "text string")
    got = importance.resample(spark.createDataFrame(hot, schema).repartition(3), target, common.Scratch(spark, "t"), percent=90)
    assert Counter(map(tuple, got.collect())) == plain_importance(hot, ["a e"], 1, percent=90)
    assert importance.resample(spark.createDataFrame([], schema), target, common.Scratch(spark, "t")).collect() == []
    none = importance.resample(spark.createDataFrame(hot, schema), target.limit(0), common.Scratch(spark, "t"))
    assert none.where("rank IS NOT NULL").count() == 40


def test_trie_carries_crcs():
    trie = importance.Trie()
    nodes = list(trie.walk(["ä", "b", "ä", "b"], 2, float))
    assert len(nodes) == 7 and len(trie) == 5  # ä, ä b, b, b ä and the root
    assert {trie.crc[n] for n in nodes} == {zlib.crc32(x.encode()) for x in ("ä", "b", "ä b", "b ä")}


INSULTS = ["idiot", "moron", "worthless", "pathetic"]


def speech(rng, toxic):
    words = ["".join(rng.choices(["lo", "ra", "ne", "ti", "su", "ka"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90))]
    if toxic:
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
    return " ".join(words)


@pytest.fixture(scope="module")
def speeches():
    rng = random.Random(5)
    return [(i, speech(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(700)]


@pytest.fixture(scope="module")
def tables(spark, speeches):
    rows = [row(i, t) for i, t, _ in speeches] + [row(900, None), row(901, ""), row(902, "!!! ..."), row(None, "no id"), row(903, "lo ra " * 20_000 + "you pathetic idiot" + " ne ti" * 20_000), row(904, "z" * 100_000), row(905, "퟿ 漢字" * 50), row(0, speeches[0][1])]
    labels = [(i, 1, y, "x") for i, _, y in speeches] + [(5, 1, None, "x"), (None, 0, 1, "x"), (7, 1, 0, "x"), (7, 1, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(*tables)


def test_toxicity_on_the_fold_that_it_never_met(tables, model, speeches):
    docs, _ = tables
    got = toxicity.score_documents(docs, model).toPandas()
    assert len(got) == 708 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    score = got.drop_duplicates("doc_id").set_index("doc_id")["predicted"]
    held = [(i, y) for i, _, y in speeches if toxicity.fold_by_hand(i) == 0]
    assert len(held) > 100 and np.mean([score[i] == y for i, y in held]) > 0.97
    assert score[903] == 1 and score[900] == score[901] == score[902] == score[904] == 0


def test_toxicity_of_unseen_misspellings(model):
    score = toxicity.scorer(model)
    met = score([f"lora neti {w} su" for w in ("idiiot", "idiott", "moronn", "morron", "pathettic", "patetic", "wortless", "worthlesss")])
    clean = score(["lora neti su", "ka lo neti ti", "lora neti latisu su", "lora neti zuzu su"])
    assert min(met) > 50 * max(clean), (met, clean)


def test_toxicity_learns_from_no_held_out_label(tables, spark):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = toxicity.sample_of(docs, labels), toxicity.sample_of(docs, flipped)
    assert a[0] == b[0] and (a[1] == b[1]).all() and a[2] == b[2]
    few = toxicity.sample_of(docs, labels, rows=10)
    assert len(few[0]) == 20 and few[1].sum() == 10


def test_toxicity_without_labels(tables, spark):
    docs, labels = tables
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        got = toxicity.score_documents(docs.limit(5), toxicity.fit(docs, some)).collect()
        assert all(abs(r["score"] - want) < 1e-6 for r in got)
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def test_subwords_by_hand():
    words = ["abc", "ü", "abcd", "x" * 40]
    buckets, owners = toxicity.subwords(words)
    for k, w in enumerate(words):
        m = f"<{w}>"
        grams = [m[i : i + n] for n in range(3, 7) for i in range(len(m) - n + 1)]
        assert (owners == k).sum() == len(grams) + 1
    one, _ = toxicity.subwords(["abcd"])
    assert sorted(buckets[owners == 2]) == sorted(one)
    assert len(set(toxicity.subwords(["abc"])[0]) & set(toxicity.subwords(["abcd"])[0])) == 3  # <ab, abc and <abc


def test_worst_passage_by_hand():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 5, 6, 50):
        v = rng.normal(size=n)
        want = v.sum() / toxicity.WINDOW if n <= toxicity.WINDOW else max(v[i : i + toxicity.WINDOW].mean() for i in range(n - toxicity.WINDOW + 1))
        assert abs(toxicity.worst_passage(v)[1] - want) < 1e-12
