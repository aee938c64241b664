"""Extra columns that have the names of the operators' own, nulls everywhere, and no rows at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from layerlog.operators import clocks, delivery, drift, lateness, spikes, structural, units

AT = dt.datetime(2025, 10, 20, 5)
SCHEMA = """path string, line_number long, source string, device_id string, dedupe_key string, kind string, device_ts_raw string, job_id string, state string, received_at timestamp, event_ts timestamp, clock_offset_seconds double, reason string, line string, payload string,
 temp_unit string, bed_temp double, nozzle_temp double, target_bed_temp double, target_nozzle_temp double, bed_c double, nozzle_c double, target_bed_c double, target_nozzle_c double"""
CLASH = ["_key", "_nid", "_row", "_mid", "_s", "_n", "_many", "_ok", "_seq", "_producer", "_first", "_us", "_zone", "_t", "_p", "_d", "_h", "_in", "_e", "_C", "_F", "_K", "_job", "_hour", "_block", "_model", "_core", "_span", "hour_s", "delay_h", "now", "score", "field", "blob", "layout", "own_key"]
ROW = ("p", 1, "genC", "d", "ab", "status", "2025-10-20T05:00:00Z", "j", "IDLE", AT, AT, None, None, "{}", '{"a":1}', "C", 60.0, 210.0, 60.0, 210.0, 60.0, 210.0, 60.0, 210.0)


@pytest.fixture(scope="module")
def table(spark):
    rows = [ROW, ROW, (*ROW[:4], None, *ROW[5:]), (None,) * len(ROW), ("p", 2, *[None] * (len(ROW) - 2))]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASH})


def devices(spark):
    return spark.createDataFrame([("d", "Europe/Berlin"), (None, None)], "device_id string, tz_name string")


OPERATORS = {
    "surplus": lambda s, t: delivery.surplus(t), "keep_one": lambda s, t: delivery.keep_one(t), "accept": lambda s, t: delivery.accept_batch(t, s.createDataFrame([], delivery.RANGES), s.createDataFrame([], delivery.IDS), "dedupe_key", "device_id")[0],
    "units": lambda s, t: units.status_units(t), "instants": lambda s, t: clocks.true_instants(t, devices(s)), "misdated": lambda s, t: clocks.misdated(t, devices(s)), "hours": lambda s, t: lateness.stale_hours(t),
    "spikes": lambda s, t: spikes.score_readings(t), "rejects": lambda s, t: structural.rejects(t), "changes": lambda s, t: drift.changes(t), "unified": lambda s, t: drift.unified(t),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_core(spark, table, name):
    got = OPERATORS[name](spark, table)
    rows = got.collect()
    for c in set(CLASH) & set(got.columns):
        if name in ("surplus", "keep_one", "accept", "units", "instants"):
            assert {r[c] for r in rows} <= {c}
    assert OPERATORS[name](spark, table.limit(0)).count() == 0
    want = {"surplus": 3, "keep_one": 2, "accept": 2, "units": 3, "instants": 5, "misdated": 0, "hours": 0, "spikes": 6, "changes": 0, "unified": 5}
    assert len(rows) == want.get(name, len(rows))
