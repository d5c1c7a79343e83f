from __future__ import annotations

import hashlib
import math
import random

import pytest

from taktwerk.operators import faults as A
from taktwerk.operators import fusion as U
from taktwerk.operators import ledger as G

BOUNDS = "window long, t_lo double, t_hi double"


def _fuse(spark, quality, bounds=((0, 90.0, 110.0),), llr=3.0, group=((5, 5), (6, 5))):
    tops = spark.createDataFrame([(1, 5, llr)], "window long, top_station int, llr double")
    at = spark.createDataFrame([(1, 90.0, 110.0)], BOUNDS)
    q = spark.createDataFrame(list(quality), "window long, station int, llr double")
    g = spark.createDataFrame(list(group), "station int, grp int")
    r = U.fuse(tops, at, q, spark.createDataFrame(list(bounds), BOUNDS), g, 30.0).first()
    return r.top_station, r.fused_top_station, r.fused_llr_margin, r.is_fused


def test_groups_link_best_rivals_at_the_threshold(spark):
    rows = [(32, 0.97, 33), (33, 0.97, 32), (10, 0.10, 11), (11, 0.90, 12), (12, 0.2, 10), (20, 0.99, 99), (21, None, 20)]
    d = spark.createDataFrame(rows, "station int, ambiguity double, confusable_with int")
    assert {(r.station, r.grp) for r in U.ambiguous_groups(spark, d).collect()} == {(32, 32), (33, 32), (11, 11), (12, 11)}


def test_groups_of_an_empty_table(spark):
    d = spark.createDataFrame([], "station int, ambiguity double, confusable_with int")
    assert U.ambiguous_groups(spark, d).count() == 0


def test_quality_may_lead_but_never_replaces_the_flow_top(spark):
    assert _fuse(spark, [(0, 5, 0.5), (0, 6, 9.0)]) == (5, 6, 5.5, True)
    assert _fuse(spark, [(0, 6, 2.0)]) == (5, 5, 1.0, True)


def test_no_fusion_without_evidence_that_overlaps(spark):
    alone = (5, 5, None, False)
    assert _fuse(spark, []) == alone
    assert _fuse(spark, [(0, 5, 0.0), (0, 6, 0.0)]) == alone
    assert _fuse(spark, [(0, 7, 9.0)]) == alone
    assert _fuse(spark, [(0, 6, 9.0)], bounds=[(0, 111.0, 300.0)]) == alone
    assert _fuse(spark, [(0, 6, 9.0)], group=[(1, 1), (2, 1)]) == alone


def test_evidence_of_several_windows_adds_up_and_touching_ends_count(spark):
    bounds = [(0, 10.0, 90.0), (1, 95.0, 96.0), (2, 110.0, 500.0), (3, 110.5, 500.0), (4, None, None)]
    assert _fuse(spark, [(n, 6, 2.0) for n in range(5)], bounds) == (5, 6, 3.0, True)


def test_ties_go_to_the_first_station_and_a_missing_likelihood_counts_as_zero(spark):
    assert _fuse(spark, [(0, 6, 3.0)]) == (5, 5, 0.0, True)
    assert _fuse(spark, [(0, 6, 1.0)], llr=None) == (5, 6, 1.0, True)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(1)
    spans = [(n, a := rng.randint(-200, 900), a + rng.choice([0, 3, 40, 700])) for n in range(60)]
    left, right = spans[:30], spans[30:]
    made = [spark.createDataFrame([(n, float(a), float(b)) for n, a, b in part], BOUNDS) for part in (left, right)]
    got = [(r.window, r.other) for r in U.overlapping(*made, 50.0).collect()]
    want = {(n, m) for n, a, b in left for m, c, d in right if d >= a and c <= b}
    assert len(got) == len(set(got)) and set(got) == want


CHANNELS = ["proc_time_s", "blocked_s"]


def _normal(seed, fault, station, vehicle, channel):
    h = hashlib.sha256(f"{seed}:{fault}:{station}:{vehicle}:{channel}".encode()).hexdigest()
    u = [(int(h[k : k + 8], 16) + 0.5) / 2**32 for k in (0, 8)]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def _by_hand(rows, faults, seed):
    """One fault after the other over a list of rows, as the contract words it."""
    rows = [{**x, "data_quality": "OBSERVED"} for x in sorted(rows, key=lambda x: (x["station"], x["t"], x["vehicle_id"]))]
    gone = set()
    for f in sorted(faults, key=lambda f: f["fault_id"]):
        mine = [k for k, x in enumerate(rows) if x["station"] == f["station"]]
        hit = [k for k in mine if f["t_from"] <= rows[k]["t"] < f["t_to"]]
        if f["kind"] == "DROPOUT":
            gone |= set(hit)
        elif f["kind"] == "INTERMITTENT":
            period = max(f["burst_on_s"] + f["burst_off_s"], 1.0)
            gone |= {k for k in hit if (rows[k]["t"] - f["t_from"]) % period >= f["burst_on_s"]}
        else:
            before = [k for k in mine if rows[k]["t"] < f["t_from"]]
            for c in CHANNELS:
                seen = [rows[k][c] for k in hit if rows[k][c] is not None]
                mean = sum(seen) / len(seen) if seen else 0.0
                sd = math.sqrt(sum((v - mean) ** 2 for v in seen) / len(seen)) if seen else 0.0
                spread = max(sd if round(sd, 9) > 0 else sum(map(abs, seen)) / max(1, len(seen)) * 0.2 + 1e-6, 1e-6)
                held = rows[(before or hit)[-1 if before else 0]][c] if hit else None
                for k in hit:
                    if f["kind"] == "STALE":
                        rows[k][c] = held
                    elif rows[k][c] is not None:
                        rows[k][c] = max(0.0, rows[k][c] + f["noise_frac"] * spread * _normal(seed, f["fault_id"], f["station"], rows[k]["vehicle_id"], c))
            for k in hit:
                rows[k]["data_quality"] = f["kind"]
    return {(x["station"], x["vehicle_id"]): x for k, x in enumerate(rows) if k not in gone}


def _telemetry(spark, rows):
    return spark.createDataFrame([(x["vehicle_id"], x["station"], x["t"], x["proc_time_s"], x["blocked_s"], "kept") for x in rows], "vehicle_id long, station int, t double, proc_time_s double, blocked_s double, kind string")


def _faults(spark, faults):
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in A.SCHEMA.split(", ")) for f in faults], A.SCHEMA)


def _case(seed):
    rng = random.Random(seed)
    rows = [{"vehicle_id": v, "station": s, "t": 10.0 * v + s, "proc_time_s": rng.choice([None, float(rng.randint(1, 50))]) if v % 9 == 0 else float(rng.randint(1, 50)), "blocked_s": 5.0 if s == 1 else rng.random()} for v in range(80) for s in range(3)]
    faults = []
    for n in range(9):
        a = float(rng.randint(-50, 700))
        faults.append({"fault_id": n, "station": rng.randint(0, 3), "kind": A.KINDS[rng.randint(0, 3)], "t_from": a, "t_to": a + rng.choice([0.0, 60.0, 250.0]), "noise_frac": 0.6, "burst_on_s": 30.0, "burst_off_s": 20.0})
    return rows, faults


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_list_of_faults_acts_in_order(spark, seed):
    rows, faults = _case(seed)
    got = A.apply_faults(_telemetry(spark, rows), _faults(spark, faults), CHANNELS, t="t", seed=5, bucket_s=70.0).collect()
    want = _by_hand(rows, faults, 5)
    assert len(got) == len(want)
    for g in got:
        w = want[g.station, g.vehicle_id]
        assert g.data_quality == w["data_quality"] and g.kind == "kept"
        for c in CHANNELS:
            assert (g[c] is None) == (w[c] is None) and (g[c] is None or abs(g[c] - w[c]) < 1e-6), (g, w)


def test_noise_does_not_depend_on_partitions(spark):
    rows, faults = _case(2)
    tel, f = _telemetry(spark, rows), _faults(spark, faults)
    runs = [sorted(map(tuple, A.apply_faults(d, f, CHANNELS, t="t", seed=5).collect()), key=repr) for d in (tel.coalesce(1), tel.repartition(7))]
    assert runs[0] == runs[1]


def test_no_faults_no_rows_and_wrong_kinds(spark):
    rows, faults = _case(3)
    none = _faults(spark, [])
    assert {r.data_quality for r in A.apply_faults(_telemetry(spark, rows), none, CHANNELS, t="t").collect()} == {"OBSERVED"}
    assert A.apply_faults(_telemetry(spark, []), _faults(spark, faults), CHANNELS, t="t").count() == 0
    odd = [{"vehicle_id": 1, "station": 0, "t": None, "proc_time_s": 1.0, "blocked_s": None}, {"vehicle_id": 2, "station": None, "t": 5.0, "proc_time_s": 1.0, "blocked_s": None}]
    assert A.apply_faults(_telemetry(spark, odd), _faults(spark, faults), CHANNELS, t="t").count() == 2
    with pytest.raises(ValueError, match="LOUD"):
        A.apply_faults(_telemetry(spark, rows), _faults(spark, [{**faults[0], "kind": "LOUD"}]), CHANNELS, t="t")


def test_only_silent_windows_are_masked(spark):
    d = spark.createDataFrame([(0, 0.01, 8), (1, None, 8), (2, 0.01, 5), (3, 0.05, 8), (4, None, None)], "window int, proc_time_s_std double, proc_time_s_count long")
    assert A.mask_suspect(d).count() == 5
    assert {r.window for r in A.mask_suspect(A.stale_suspect(d)).collect()} == {2, 3, 4}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "chain long, at long, body string")


def _hashes(bodies):
    out = [G.GENESIS]
    for b in bodies:
        out.append(hashlib.sha256((out[-1] + b).encode()).hexdigest())
    return out[1:]


def test_appends_go_on_from_the_stored_heads(spark, tmp_path):
    root = str(tmp_path / "ledger")
    G.append(spark, root, 0, _rows(spark, [(1, 5, "a"), (1, 4, "b"), (2, 1, "x"), (None, 1, "n")]), "at")
    G.append(spark, root, 3, _rows(spark, [(1, 1, "c"), (1, 2, None), (3, 1, "ü"), (None, 0, "m")]), "at")
    rows = G.entries(spark, root).orderBy("entry_id").collect()
    by = {c: [(r.entry_id, r.entry_hash) for r in rows if r.chain == c] for c in (1, 2, 3, None)}
    for chain, bodies in {1: ["b", "a", "c", ""], 2: ["x"], 3: ["ü"], None: ["n", "m"]}.items():
        assert by[chain] == list(enumerate(_hashes(bodies), 1))
    assert all(r.first_break is None for r in G.verify_chains(G.entries(spark, root)).collect())
    assert {(r.batch, r.status) for r in G.verify_batches(spark, root).collect()} == {(0, "whole"), (3, "whole")}


def test_a_repeated_batch_changes_nothing_and_an_older_one_is_refused(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for n in (1, 2, 2):
        G.append(spark, root, n, _rows(spark, [(1, n, f"b{n}")]), "at")
    assert [r.entry_hash for r in G.entries(spark, root).orderBy("entry_id").collect()] == _hashes(["b1", "b2"])
    with pytest.raises(ValueError, match="older"):
        G.append(spark, root, 1, _rows(spark, [(1, 9, "late")]), "at")


def test_a_torn_batch_is_found_unseen_and_written_again(spark, tmp_path):
    root = str(tmp_path / "ledger")
    G.append(spark, root, 0, _rows(spark, [(1, 0, "a")]), "at")
    G.append(spark, root, 1, _rows(spark, [(1, 1, "b"), (2, 1, "c")]), "at")
    (tmp_path / "ledger" / "manifest" / "batch=1").rename(tmp_path / "gone")
    assert {(r.batch, r.status) for r in G.verify_batches(spark, root).collect()} == {(0, "whole"), (1, "torn")}
    assert [r.body for r in G.entries(spark, root).collect()] == ["a"]
    G.append(spark, root, 1, _rows(spark, [(1, 1, "b"), (2, 1, "c")]), "at")
    assert {r.status for r in G.verify_batches(spark, root).collect()} == {"whole"}
    assert [r.entry_hash for r in G.entries(spark, root).where("chain = 1").orderBy("entry_id").collect()] == _hashes(["a", "b"])


def test_altered_and_lost_entries_are_found(spark, tmp_path):
    root = str(tmp_path / "ledger")
    G.append(spark, root, 0, _rows(spark, [(1, n, str(n)) for n in range(4)] + [(2, 0, "z")]), "at")
    d = G.entries(spark, root)
    changed = d.selectExpr("batch", "chain", "entry_id", "if(entry_id = 3, 'new', body) AS body", "prev_hash", "entry_hash")
    assert {(r.chain, r.n, r.first_break) for r in G.verify_chains(changed).collect()} == {(1, 4, 3), (2, 1, None)}
    assert {(r.chain, r.first_break) for r in G.verify_chains(d.where("entry_id <> 2 OR chain = 2")).collect()} == {(1, 3), (2, None)}
    rows = d.where("entry_id <> 2").collect()
    spark.createDataFrame(rows, d.schema).write.mode("overwrite").parquet(f"{root}/entries/batch=0")
    assert {r.status for r in G.verify_batches(spark, root).collect()} == {"altered"}


def test_an_empty_ledger_and_an_empty_append(spark, tmp_path):
    root = str(tmp_path / "ledger")
    assert G.entries(spark, root).count() == G.verify_batches(spark, root).count() == 0
    G.append(spark, root, 0, _rows(spark, []), "at")
    assert G.entries(spark, root).count() == 0
    G.append(spark, root, 1, _rows(spark, [(1, 0, "a")]), "at")
    assert [r.entry_hash for r in G.entries(spark, root).collect()] == _hashes(["a"])
