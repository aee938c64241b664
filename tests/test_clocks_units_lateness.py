import datetime as dt
import random

from pyspark.sql import functions as F

from layerlog.functions.unitlabels import read_label, read_unit, readings
from layerlog.operators import clocks, lateness, units

UTC = dt.timezone.utc
EVENTS = "path string, line_number long, source string, device_id string, device_ts_raw string, received_at timestamp, event_ts timestamp, clock_offset_seconds double, other string"


def us(*a):
    return int((dt.datetime(*a, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)


def test_notations(spark):
    cases = [
        ("genB", "1760921077361", None, 1760921077361000), ("genB", "1760942608", None, 1760942608000000), ("genB", "1760926139.566", None, 1760926139566000), ("genB", "1760923155207792", None, 1760923155207792),
        ("genB", "1761492529845000000", None, 1761492529845000), ("genC", "2025-10-20T07:25:31.256+02:00", None, us(2025, 10, 20, 5, 25, 31) + 256000), ("genC", "2025-10-24T11:07:28.262-0500", None, us(2025, 10, 24, 16, 7, 28) + 262000),
        ("genC", "Fri, 24 Oct 2025 23:09:58 +0000", None, us(2025, 10, 24, 23, 9, 58)), ("genC", "25.10.2025 02:35:14 +00:00", None, us(2025, 10, 25, 2, 35, 14)), ("genC", "2025-10-31 04:58:00 [Europe/Berlin]", None, us(2025, 10, 31, 3, 58)),
        ("genC", "2025-10-20 05:37:23 EDT", None, us(2025, 10, 20, 9, 37, 23)), ("genC", "20251020T095047Z", None, us(2025, 10, 20, 9, 50, 47)), ("genA", "10/21/2025 08:09:45 PM", 100.0, us(2025, 10, 21, 20, 11, 25)),
        ("genA", "24-Oct-2025 02:09:23", -60.0, us(2025, 10, 24, 2, 8, 23)), ("genA", "20251021 132938", 0.5, us(2025, 10, 21, 13, 29, 38) + 500000),
        # a wall time that occurs twice means the first; without an offset a genA time is wall time too
        ("genC", "2025-10-26 02:30:00", None, us(2025, 10, 26, 0, 30)), ("genA", "2025-10-27 02:30:00", None, us(2025, 10, 27, 1, 30)), ("genC", "2025-10-25 12:00:00.123", None, us(2025, 10, 25, 10) + 123000),
        ("genC", None, None, None), ("genC", "", None, None), ("genC", "yesterday", None, None), ("genC", "2025-13-40 99:00:00", None, None), ("genC", "x" * 5000, None, None),
    ]
    rows = [("p", i, s, "dev", raw, dt.datetime(2025, 11, 3, tzinfo=UTC), None, off, "o") for i, (s, raw, off, _) in enumerate(cases)]
    devices = spark.createDataFrame([("dev", "Europe/Berlin"), ("other", "Asia/Kolkata")], "device_id string, tz_name string")
    got = {r.line_number: r.event_us for r in clocks.true_instants(spark.createDataFrame(rows, EVENTS), devices).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    bad = clocks.misdated(spark.createDataFrame(rows, EVENTS), devices)
    assert bad.count() == sum(c[3] is not None for c in cases) and bad.columns == ["path", "line_number", "event_us"]
    assert clocks.misdated(spark.createDataFrame([], EVENTS), devices).count() == 0


def test_zone_is_estimated_from_receipts(spark):
    rows = []
    for i in range(30):
        at = dt.datetime(2025, 10, 20, i % 24, 0)
        rows.append(("p", i, "genC", "lost", f"{at + dt.timedelta(hours=11):%Y-%m-%d %H:%M:%S}", (at + dt.timedelta(minutes=2)).replace(tzinfo=UTC), None, None, ""))
    devices = spark.createDataFrame([("x", "Australia/Sydney"), ("y", "America/New_York"), ("lost", None)], "device_id string, tz_name string")
    got = clocks.true_instants(spark.createDataFrame(rows, EVENTS), devices).collect()
    assert all(abs((r.received_at.replace(tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6 - r.event_us) <= 180e6 for r in got)


def test_history_of_zones(spark):
    rows, want = [], {}
    zone = {"moved": lambda k: 11 if k < 300 else -4, "stays": lambda k: 11, "told": lambda k: -4, "few": lambda k: -4 if k < 295 else 11}
    for d, hours in zone.items():
        for k in range(600 if d == "moved" else 300):
            at = dt.datetime(2025, 10, 10) + dt.timedelta(minutes=29 * k)
            rows.append(("p", len(rows), "genC", d, f"{at + dt.timedelta(hours=hours(k)):%Y-%m-%d %H:%M:%S}", (at + dt.timedelta(minutes=2)).replace(tzinfo=UTC), None, None, ""))
            want[len(rows) - 1] = int((at.replace(tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
    devices = spark.createDataFrame([("x", "Australia/Sydney"), ("y", "America/New_York"), ("z", "Asia/Kolkata"), ("told", "America/New_York"), ("few", "America/New_York")], "device_id string, tz_name string")
    got = {r.line_number: (r.device_id, r.event_us) for r in clocks.true_instants(spark.createDataFrame(rows, EVENTS), devices).collect()}
    wrong = [(d, k) for k, (d, us_) in got.items() if us_ != want[k]]
    # the day of the move may go to either side; a handful of odd times is no move
    assert {d for d, _ in wrong} <= {"moved", "few"} and sum(d == "moved" for d, _ in wrong) <= 50 and sum(d == "few" for d, _ in wrong) == 5


def test_labels():
    for label, want in {"C": ("C", 0), "°C": ("C", 0), " degC ": ("C", 0), "celsius": ("C", 0), "K": ("K", 0), "kelvin": ("K", 0), "deg F": ("F", 0), "fahrenheit": ("F", 0), "dC": ("C", -1), "C/10": ("C", -1), "0.1 C": ("C", -1), "decicelsius": ("C", -1), "c": ("C", 0), "℃": ("C", 0), "mK": ("K", -3)}.items():
        assert read_label(label) == want, label
    assert [read_label(x) for x in (None, "", "   ", "volts", "m", "F/s")] == [None] * 6
    assert read_label("x" * 20_000) is None


def test_exponents():
    for label, dimension, want in [
        ("m²", "length", ("m", 0, 2)), ("mm^2", "length", ("m", -6, 2)), ("(cm)**3", "length", ("m", -6, 3)), ("s⁻²", "time", ("s", 0, -2)), ("ms-1", "time", ("s", 3, -1)), ("0.1 m2", "length", ("m", -1, 2)), ("m⁴/10", "length", ("m", -1, 4)),
        ("°C^1", "temperature", ("C", 0, 1)), ("dC¹", "temperature", ("C", -1, 1)), ("K^-1", "temperature", ("K", 0, -1)), ("C·10⁻¹", "temperature", ("C", -1, 1)), ("C10", "temperature", ("C", 1, 1)), ("C 10^-1", "temperature", ("C", -1, 1)),
        ("m²", "temperature", None), ("C12", "temperature", None), ("C ²", "temperature", None), ("²C", "temperature", None),
    ]:
        assert read_unit(label, dimension) == want, label
    assert read_label("°C^1") == ("C", 0) and read_label("mm", "length") == ("m", -3)
    assert [read_label(x) for x in ("C²", "K^-1", "m²", "°C⁰")] == [None] * 4  # no temperatures


def test_ambiguous_labels_have_all_their_readings():
    got = {(d, u): w for (d, u, p, e), w in readings("C") if (p, e) == (0, 1)}
    assert got["temperature", "C"] > 0.95 > 0.1 > got["charge", "coulomb"] > 0 and abs(sum(w for _, w in readings("C")) - 1) < 1e-9
    assert readings("C", "charge")[0][0][:2] == ("charge", "coulomb") and readings("F", "capacitance")[0][0][1] == "farad"
    assert read_unit("MK") == ("K", 6, 1) != read_unit("mK") and {u[2] for u, _ in readings("MK")} >= {6, -3}
    assert read_unit("GHz", "frequency") == ("Hz", 9, 1) and read_unit("nm", "length") == ("m", -9, 1) and read_unit("kPa", "pressure") == ("Pa", 3, 1) and read_unit("min", "time") == ("min", 0, 1)
    assert readings("10 " * 3000) == () and units.label_prior("dC").keys() == {"dC"} and units.label_prior(None) == {}


def test_labels_decide_what_values_leave_open(spark):
    schema = "path string, line_number long, device_id string, job_id string, kind string, temp_unit string, bed_temp double, nozzle_temp double, target_bed_temp double, target_nozzle_temp double"
    rows = [("p", i, "d", f"j{i // 3}", "status", label, 52.0, 62.0, None, None) for i, label in enumerate(["degF", "F", None, "C", "°C", "F", "farad", None, "fahrenheit", None, None, None])]
    unit = lambda df: [r.unit for r in units.status_units(df).orderBy("line_number").collect()]
    df = spark.createDataFrame(rows, schema)
    assert unit(df) == ["F"] * 3 + ["C"] * 3 + ["F"] * 3 + ["C"] * 3
    assert unit(df.withColumn("temp_unit", F.lit(None).cast("string"))) == ["C"] * 12


def test_units_follow_the_job_not_the_label(spark):
    schema = "path string, line_number long, device_id string, job_id string, kind string, temp_unit string, bed_temp double, nozzle_temp double, target_bed_temp double, target_nozzle_temp double, extra int"
    conv = {"C": lambda c: c, "F": lambda c: c * 1.8 + 32, "K": lambda c: c + 273.15, "dC": lambda c: c * 10}
    rnd, rows, want = random.Random(1), [], {}
    for j, u in enumerate(["C", "F", "K", "dC"] * 3):
        for k in range(8):
            t = [round(conv[u](x), 2) for x in (60 + rnd.gauss(0, 0.5), 215 + rnd.gauss(0, 1), 60.0, 215.0)]
            if k == 3:
                t[2] = t[3] = None
            rows.append(("p", len(rows), "d", f"j{j}", "status", rnd.choice(["C", "F", None, "??"]), *t, 1))
            want[len(rows) - 1] = u
    rows.append(("p", 999, "d", None, "status", "C", conv["F"](24.0), conv["F"](25.0), 32.0, 32.0, 1))
    want[999] = "F"
    rows.append(("p", 1000, "d", None, "status", "K", None, None, None, None, 1))
    want[1000] = "K"
    rows.append(("p", 1001, "d", None, "job_end", None, None, None, None, None, 1))
    df = spark.createDataFrame(rows, schema)
    out = units.status_units(df).collect()
    assert {r.line_number: r.unit for r in out} == want
    assert all(abs(r.target_bed_c - 60) < 0.01 for r in out if r.line_number < 900 and r.target_bed_c is not None)
    assert {(r.line_number, r.unit) for r in units.foreign_units(df).collect()} == {(k, u) for k, u in want.items() if u != "C"}
    assert units.foreign_units(df.limit(0)).count() == 0


def test_finger_tree_matches_a_dict():
    rnd = random.Random(3)
    for _ in range(20):
        tree, have, floor = lateness.FingerTree(4), {}, None
        for i in range(300):
            if rnd.random() < 0.05:
                key = rnd.randrange(0, 40 + i)
                gone = tree.evict_below(key)
                if floor is None or key > floor:
                    floor = key
                    assert gone == sorted((k, v) for k, v in have.items() if k < key)
                    have = {k: v for k, v in have.items() if k >= key}
            key = rnd.randrange(0, 60 + i)
            ok = tree.insert(key, (1.0, float(key), float(i)))
            assert ok == (floor is None or key >= floor)
            if ok:
                have[key] = lateness.combine(have.get(key), (1.0, float(key), float(i)))
        assert tree.items() == sorted(have.items())
        total = None
        for v in have.values():
            total = lateness.combine(total, v)
        assert tree.total() == total


def test_hours_against_brute_force(spark):
    rnd, rows = random.Random(4), []
    base = dt.datetime(2025, 10, 20, tzinfo=UTC)
    for i in range(600):
        at = base + dt.timedelta(minutes=rnd.randrange(60 * 30))
        late = rnd.choice([0.01, 0.5, 1, 2, 30, 47, 49, 50, 80])
        rows.append((rnd.choice(["a", "b", None]), at, at + dt.timedelta(hours=late), "IDLE", float(rnd.randrange(50)), None if rnd.random() < 0.3 else 1.0, None))
    hour = dt.datetime(2025, 10, 21, 5, tzinfo=UTC)
    rows += [("e", hour, hour + dt.timedelta(hours=2), "IDLE", 1.0, 1.0, None), ("f", hour, hour + dt.timedelta(hours=49), "IDLE", 1.0, 1.0, None), ("g", hour, hour + dt.timedelta(hours=49, microseconds=1), "IDLE", 1.0, 1.0, None), ("h", None, hour, "IDLE", 1.0, 1.0, None)]
    schema = "device_id string, event_ts timestamp, received_at timestamp, state string, bed_c double, nozzle_c double, chamber_c double"
    df = spark.createDataFrame(rows, schema)
    want = set()
    for d, at, got, *_ in rows:
        if at is None:
            continue
        end = at.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
        lag = (got - end).total_seconds()
        if lag > 3600:
            want.add((d, int(end.timestamp()) - 3600, "dropped" if lag > 48 * 3600 else "corrected"))
    assert {tuple(r) for r in lateness.stale_hours(df).collect()} == want
    full = {(r.device_id, r.hour_s): r for r in lateness.corrected_hours(df, span_h=6).select("*", *lateness.figures("now")).collect()}
    for (d, h), r in full.items():
        at = lambda x: int(x[1].replace(minute=0, second=0, microsecond=0).timestamp())
        lag = lambda x: (x[2] - x[1].replace(minute=0, second=0, microsecond=0)).total_seconds() / 3600 - 1
        mine = [x for x in rows if x[1] and x[0] == d and at(x) == h]
        kept = [x for x in mine if lag(x) <= 48]
        assert (r.samples or 0) == len(kept) and r.dropped == len(mine) - len(kept) and (not kept or abs(r.avg_bed_c - sum(x[4] for x in kept) / len(kept)) < 1e-9)
        if len(kept) > sum(lag(x) <= 1 for x in kept):
            assert (r.published[0] if r.published else 0) == sum(lag(x) <= 1 for x in kept)
    assert lateness.stale_hours(df.limit(0)).count() == 0
    # batches in order of receipt, with the state kept between them, end where one batch ends
    state, rows = None, sorted((x for x in rows if x[1]), key=lambda x: x[2])
    for k in range(0, len(rows), 151):
        state = lateness.advance(state, lateness.partials(spark.createDataFrame(rows[k : k + 151], schema)))
        state = spark.createDataFrame(state.collect(), state.schema)
    final = lateness.corrected(state)
    assert {(r.device_id, r.hour_s) for r in state.where(final).collect()} == {w[:2] for w in want if w[2] == "corrected"}
    assert {(r.device_id, r.hour_s) for r in state.where("dropped > 0").collect()} == {w[:2] for w in want if w[2] == "dropped"}
    assert {(r.device_id, r.hour_s): (r.now or [0])[0] for r in state.collect()} == {k: (r.now or [0])[0] for k, r in full.items()}


def test_table_is_corrected(spark):
    h = dt.datetime(2025, 10, 20, 5, tzinfo=UTC)
    old = "device_id string, source string, model string, firmware string, hour_ts timestamp, samples long, printing_samples long, idle_samples long, avg_bed_c double, avg_nozzle_c double, max_nozzle_c double, avg_chamber_c double"
    table = spark.createDataFrame([("d", "s", None, "1", h, 1, 1, 0, 5.0, 5.0, 5.0, None), ("d", "s", None, "1", h - dt.timedelta(hours=9), 7, 7, 0, 1.0, 1.0, 1.0, 1.0), ("e", "s", "m", "1", h, 1, 0, 1, 2.0, 2.0, 2.0, 2.0)], old)
    m = [("d", "s", None, "1", h, h, "PRINTING", 5.0), ("d", "s", None, "1", h, h + dt.timedelta(hours=9), "IDLE", 7.0), ("d", "s", None, "1", h, h + dt.timedelta(hours=99), "IDLE", 70.0), ("d", "s", None, "2", h, h + dt.timedelta(hours=9), "IDLE", 1.0), ("e", "s", "m", "1", h, h, "IDLE", 2.0), ("f", "s", "m", "1", h, h + dt.timedelta(hours=60), "IDLE", 2.0)]
    df = spark.createDataFrame(m, "device_id string, source string, model string, firmware string, event_ts timestamp, received_at timestamp, state string, bed_c double")
    got = {(r.device_id, r.firmware, r.hour_s): (r.samples, r.avg_bed_c, r.late, r.dropped, r.change) for r in lateness.correct_table(table, df).collect()}
    s = int(h.timestamp())
    assert got == {("d", "1", s): (2, 6.0, 1, 1, "corrected"), ("d", "1", s - 9 * 3600): (7, 1.0, None, 0, "unknown"), ("d", "2", s): (1, 1.0, 1, 0, "added"), ("e", "1", s): (1, 2.0, 0, 0, "kept")}
