"""Failure texts to codes and the guard of numbers, against plain Python."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from taktwerk.operators import text as T

PHRASES = [("loose_bolt", "bolt not tight"), ("loose_bolt", "under torque"), ("scratch", "paint scratched"), ("scratch", "surface marks"), ("leak", "seal leaking at pump"), ("leak", None)]
TEXTS = [(1, "Bolts found under torque; bolt NOT tight"), (2, "Leaking pump seals"), (3, "marks on surface"), (4, "nothing known"), (5, None), (6, ""), (7, "paint"), (7, "paint scratched"), (8, "scratch"), (None, "pump seal leaking at")]


def toks(s):
    out = set()
    for w in re.findall("[a-z]+", (s or "").lower()):
        out.add(w[:-3] if len(w) > 4 and w.endswith("ing") else w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    return out


def plain(texts, phrases, vocabulary):
    phrases = [(c, p) for c, p in phrases if c in vocabulary]
    every = {(c, p) for c, p in phrases} | {(c, c.replace("_", " ")) for c, _ in phrases}
    codes = {c for c, _ in phrases}
    idf = {t: math.log(1 + len(codes) / len({c for c, p in every if t in toks(p)})) for _, p in every for t in toks(p)}
    have = {}
    for k, s in texts:
        have.setdefault(k, set()).update(toks(s))
    out = {}
    for k, ts in have.items():
        best = []
        for c, p in every:
            m = ts & toks(p)
            if m:
                best.append((-round(sum(idf[t] for t in m) / sum(idf[t] for t in toks(p)) * (0.55 + 0.45 * min(1, len(m) / 3)), 9), c))
        best = [b for b in best if -b[0] >= 0.40]
        out[k] = (min(best)[1], round(-min(best)[0], 6)) if best else ("UNMAPPED", 0.0)
    return out


def test_codes_equal_plain_scores(spark):
    texts, phrases = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(PHRASES, "code string, phrase string")
    for vocabulary in ({"loose_bolt", "scratch", "leak"}, {"leak", "other"}, set()):
        known = spark.createDataFrame([(v,) for v in sorted(vocabulary)], "code string")
        got = {r["id"]: (r["code"], round(r["score"], 6)) for r in T.propose_codes(texts.where("id IS NOT NULL"), "id", phrases, known).collect()}
        assert got == plain([t for t in TEXTS if t[0] is not None], PHRASES, vocabulary)
        assert all(c in vocabulary | {"UNMAPPED"} for c, _ in got.values())
    assert T.propose_codes(texts.limit(0), "id", phrases, phrases.select("code")).count() == 0


def test_rare_tokens_miss_no_score(spark):
    """Texts of every pair and triple of a phrase's words score as plainly, though common words alone bring no text and phrase together."""
    phrases = [("a", "alpha beta gamma delta"), ("b", "beta gamma delta epsilon"), ("c", "gamma delta"), ("d", "delta"), ("d", "delta alpha")]
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [(n, " ".join(w for b, w in enumerate(words) if n >> b & 1)) for n in range(64)]
    ours = T.propose_codes(spark.createDataFrame(texts, "id int, text string"), "id", spark.createDataFrame(phrases, "code string, phrase string"), spark.createDataFrame([(c,) for c in "abcd"], "code string"))
    assert {r["id"]: (r["code"], round(r["score"], 6)) for r in ours.collect()} == plain(texts, phrases, set("abcd"))
    index = spark.createDataFrame([("common", "a", "p", 0.3, 1.3), ("rare", "a", "p", 1.0, 1.3)], "token string, code string, phrase string, idf double, whole double")
    assert [r["token"] for r in T.rare_tokens(index, 0.40).collect()] == ["rare"]


def test_pairs_are_not_shuffled(spark):
    """A text's tokens are brought together by its key alone, and pairs of text and phrase are not."""
    texts, phrases = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(PHRASES, "code string, phrase string")
    plan = T.propose_codes(texts, "id", phrases, phrases.select("code"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+, (code|token|word)", plan), plan


def test_numbers_from_nowhere_are_replaced(spark):
    answers = [(1, "Station 4 lost 12.5 units"), (2, "Station 4 lost 13 units, -7 next"), (3, "no number"), (4, None), (5, "lost 9")]
    lines = [(1, "station 4"), (1, "12.5 units an hour"), (2, "station 4, 12.5 units"), (2, "7 units"), (9, "9")]
    out = T.guarded(spark.createDataFrame(answers, "id int, text string"), spark.createDataFrame(lines, "id int, text string"), ["id"], F.lit("see the evidence"))
    got = {r["id"]: (r["text"], r["grounded"], r["n_flagged"]) for r in out.collect()}
    assert got == {1: (answers[0][1], True, 0), 2: ("see the evidence", False, 2), 3: ("no number", True, 0), 4: (None, True, 0), 5: ("see the evidence", False, 1)}
