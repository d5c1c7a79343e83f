"""A plant's files by hand: names mapped, times in three spellings, one clock, positions for identifiers."""

from __future__ import annotations

import json

import pytest

from taktwerk.sources import export

STATES = "Equipment,StateCode,EventTime\nB,RUNNING,2024-01-01 00:00:00\nB,Outfeed-Full,2024-01-01 00:00:20\nB,RUNNING,2024-01-01 00:00:25\nA,INFEED_EMPTY,2024-01-01 00:00:02\nA,RUNNING,2024-01-01 00:00:04\nA,RUNNING,2024-01-01 00:01:00\n"
SCANS = "Equipment,SerialNo,ReadTime\nA,Z1,01/01/2024 00:00:01\nA,Y2,2024-01-01T00:00:10Z\nB,Z1,2024-01-01 00:00:15\nB,Y2,2024-01-01 00:00:30.5\n"


def test_export_of_states_and_scans(spark, tmp_path):
    for name, text in (("states", STATES), ("scans", SCANS), ("vehicles", "SerialNo,ModelCode\nZ1,m\nY2,n\nQ9,m\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "map.json").write_text(export.template())
    spec = export.read_spec(str(tmp_path / "map.json"))
    got = export.load(spark, spec)
    rows = {(r.station, r.vehicle_id): (r.vehicle_key, r.t_start_s, r.t_depart_s, r.blocked_s, r.starved_s, r.proc_time_s, r.variant) for r in got["telemetry"].collect()}
    assert rows == {(0, 0): ("Z1", 1.0, 1.0, 0.0, 0.0, 0.0, "m"), (0, 1): ("Y2", 1.0, 10.0, 0.0, 2.0, 7.0, "n"), (1, 0): ("Z1", 15.0, 15.0, 0.0, 0.0, 0.0, "m"), (1, 1): ("Y2", 15.0, 30.5, 5.0, 0.0, 10.5, "n")}
    assert {(r.vehicle_key, r.vehicle_id, r.shift) for r in got["vehicles"].collect()} == {("Z1", 0, "UNKNOWN"), ("Y2", 1, "UNKNOWN")}
    assert got["inspections"] is None and got["environment"] is None
    given = json.loads(export.template()) | {"line": {"stations": ["X", "A"]}}
    (tmp_path / "odd.json").write_text(json.dumps(given))
    with pytest.raises(ValueError, match="B"):
        export.load(spark, export.read_spec(str(tmp_path / "odd.json")))
    with pytest.raises(FileNotFoundError):
        export.load(spark, export.ExportSpec(str(tmp_path), {"states": "states.csv", "scans": "none.csv"}))
