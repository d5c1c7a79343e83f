from __future__ import annotations

import re

from taktwerk.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as cp

    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scratch, seen = Scratch(spark, "t"), []
    for name, stage in cp.STAGES:
        docs = scratch.store(stage(spark, docs, SF), "stage")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == start.columns
            seen.append(docs.select("doc_id", "text").toPandas())
    clean = {i for i, q in labels.items() if q == 1}
    assert len(clean & set(seen[0]["doc_id"])) >= 0.95 * len(clean)
    words = lambda x: len(re.findall("[^\x20\x09-\x0D]+", x))
    assert set(seen[1]["doc_id"]) <= set(seen[0]["doc_id"]) and seen[1]["text"].map(words).min() > 0
    # No two that stay are near copies: five-word shingles, 0.8.
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in seen[2]["text"])]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert set(seen[3]["doc_id"]) <= set(seen[2]["doc_id"])
    assert docs.toPandas()["words"].sum() == seen[3]["text"].map(words).sum()
