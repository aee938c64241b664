import datetime as dt
import itertools
import json
import random

from layerlog.operators import drift, structural

UTC = dt.timezone.utc
LINES = "path string, line_number long, source string, received_at timestamp, line string, device_id string, reason string, other string"
GOT = dt.datetime(2025, 10, 20, 12, tzinfo=UTC)
A = "2025-10-20 11:00:00 "
B = {"t": 1760950000000, "dev": "d", "model": "B", "fw": "2", "k": "status", "bed_temp": 60.0, "nozzle_temp": "215.5", "temp_unit": "C", "state": "IDLE"}


def b(**kw):
    return json.dumps({k: v for k, v in (B | kw).items() if v != "drop"})


CASES = [
    ("genX", "{}", "unsupported_source"), (None, "{}", "unsupported_source"), ("genB", b(), None), ("genB", b() + " junk", "invalid_json"), ("genB", "[" + b() + "]", "invalid_json"), ("genB", b()[:-3], "invalid_json"),
    ("genB", b().replace("60.0", "NaN"), "invalid_json"), ("genB", b().replace('"', "'"), "invalid_json"), ("genB", None, "invalid_json"), ("genB", "", "invalid_json"), ("genB", b(dev=""), "missing_device"), ("genB", b(dev=None), "missing_device"),
    ("genB", b(t="12:41"), "invalid_device_time"), ("genB", b(t="1760950000000"), None), ("genB", b(t=1792562090000), "future_event_time"), ("genB", b(k="STATUS"), "unsupported_kind"), ("genB", b(k="job_end"), "missing_job_id"),
    ("genB", b(bed_temp="21,4"), "missing_temperature"), ("genB", b(bed_temp=True), "missing_temperature"), ("genB", b(temp_unit="K"), "unsupported_temperature_unit"), ("genB", b(temp_unit="F", bed_temp=392.1), "invalid_temperature"), ("genB", b(temp_unit="F", bed_temp=392.0), None),
    ("genB", b(bed_temp="inf"), "invalid_temperature"), ("genB", b(material='a "b" {\\ c'), None), ("genB", b(temp_unit="drop"), None),
    ("genC", '{"ts":"2025-10-20T11:00:00","device":{"id":"d"},"type":"maintenance"}', "invalid_device_time"), ("genC", '{"ts":"2025-10-20T13:00:00+02:00","device":{"id":"d"},"type":"maintenance"}', None), ("genC", '{"ts":"2025-10-20T11:00:00Z","device":"d","type":"maintenance"}', "missing_device"),
    ("prusalink", '{"received_at":"never","device":{"id":"d"}}', "invalid_received_time"), ("prusalink", '{"received_at":"2025-10-20T11:00:00Z","device":{"id":"d"},"status":{"printer":{"temp_bed":1,"temp_nozzle":"2"}}}', None),
    ("genA", A + "THERM bed=60 nozzle=215 tgt_bed=60 tgt_nozzle=215 fan=1 job=j", None), ("genA", A + "THERM bed=60 nozzle=215 tgt_bed=60 tgt_nozzle=215 job=j", "wrong_field_count"), ("genA", A + "THERM nozzle=215 bed=60 tgt_bed=60 tgt_nozzle=215 fan=1 job=j", "wrong_field_count"),
    ("genA", A + 'JOB start id=j material="PLA + x" layers=3', None), ("genA", A + 'JOB start id=j material="PL"A" layers=3', "broken_quoting"), ("genA", A + 'JOB start id= material="PLA" layers=3', "missing_job_id"), ("genA", "2025-13-20 11:00:00 ERR code=1 job=j", "invalid_device_time"),
    ("genA", A + "DBG x=1", "unsupported_kind"), ("genA", A + "IDLE bed=n/a nozzle=2 tgt_bed=0 tgt_nozzle=0 fan=0 job=-", "missing_temperature"), ("genA", A + "IDLE bed=250 nozzle=2 tgt_bed=0 tgt_nozzle=0 fan=0 job=-", "invalid_temperature"), ("genA", None, "invalid_device_time"),
    ("genB", b(material="y" * 300_000), None), ("genB", '{"a":' * 5000 + "1" + "}" * 5000, "missing_device"),
]


def test_first_reason(spark):
    rows = [("p", i, s, GOT, line, "d", None, "o") for i, (s, line, _) in enumerate(CASES)] + [("p", 900, "genB", None, b(), "d", None, "o"), ("p", 901, "genA", GOT, A + "DBG", None, None, "o"), ("p", 902, "genB", GOT, "x", "d", "invalid_json", "o")]
    df = spark.createDataFrame(rows, LINES)
    got = {r.line_number: r.verdict for r in structural.load_lines(df).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: c[2] for i, c in enumerate(CASES)}
    assert got[900] == "invalid_received_time" and got[901] == "missing_device"
    assert {r.line_number: r.reason for r in structural.rejects(df).collect()} == {k: v for k, v in got.items() if v and k != 902}
    v1 = {r.line_number: r.verdict for r in structural.load_lines(df, 1).collect()}
    assert sum(v1[k] == "unsupported_kind" and got[k] is None for k in got) == 1
    assert structural.rejects(df.limit(0)).count() == 0


def test_structure_against_a_scan():
    import numpy as np

    rnd = random.Random(2)
    lines = ["".join(rnd.choice('ab "{}[]\\é') for _ in range(rnd.randrange(30))) for _ in range(500)]
    for esc in (False, True):
        s = structural.Structure(lines, np.full(len(lines), esc))
        for i, line in enumerate(lines):
            inside, quotes, depth, low, cur, fields, slash = False, 0, 0, 0, b"", [], False
            for ch in line.encode():
                c = bytes([ch])
                if c == b'"' and not (esc and slash):
                    inside, quotes = not inside, quotes + 1
                elif not inside and c in b"{[":
                    depth += 1
                elif not inside and c in b"}]":
                    depth -= 1
                    low = min(low, depth)
                slash = c == b"\\" and not slash
                if c == b" " and not inside:
                    fields += [cur] * bool(cur)
                    cur = b""
                else:
                    cur += c
            fields += [cur] * bool(cur)
            assert (s.quotes[i], s.depth_end[i], min(0, s.depth_low[i])) == (quotes, depth, low)
            assert [f.encode() for f in s.fields(i)] == fields


RAW = "path string, line_number long, source string, received_at timestamp, payload string, extra string"


def raw(spark, files):
    rows = []
    for n, (path, recs) in enumerate(files):
        rows += [(path, i, "genB", dt.datetime(2025, 10, 20 + n, tzinfo=UTC), r if isinstance(r, str) or r is None else json.dumps(r), "") for i, r in enumerate(recs)]
    return spark.createDataFrame(rows, RAW)


def test_changes(spark):
    files = [
        ("x/d__1__a.jsonl", [{"k": "status", "bed_temp": 60.5, "fw": "1", "n": 1, "gone": "z"}, "not json", None]),
        ("x/d__2__b.jsonl", [{"kind": "status", "temps": {"bed": 61.0}, "firmware": "1", "n": "1", "seq": 4}, {"kind": None}]),
        ("x/d__3__c.jsonl", [{"kind": "status", "temps": {"bed": None}, "firmware": "1", "n": None, "seq": 5}]),
        ("x/e__1__a.jsonl", [{"other": 1}]),
    ]
    got = {tuple(r)[:1] + tuple(r)[2:] for r in drift.changes(raw(spark, files)).collect()}
    p = files[1][0]
    assert got == {(p, "renamed", "k", "kind"), (p, "renamed", "bed_temp", "temps.bed"), (p, "renamed", "fw", "firmware"), (p, "retyped", "n", "n"), (p, "removed", "gone", ""), (p, "added", "", "seq")}
    assert drift.changes(raw(spark, files).limit(0)).count() == 0


def test_one_table_keeps_every_value(spark):
    first = {"k": "status", "bed_temp": 60.5, "fw": "3.10", "n": 1, "dev": "007", "job": "1_000", "id": "1e5", "on": True, "gone": "z"}
    second = {"kind": "status", "temps": {"bed": "61.0"}, "firmware": "3.10", "n": "1", "dev": "007", "job": "2_000", "id": "1e5", "on": False, "seq": [4, {"a": None}]}
    files = [("x/d__1__a.jsonl", [first, "not json", None]), ("x/d__2__b.jsonl", [second, {"kind": None, "bed_temp": 1.0, "temps": {"bed": "hot"}}])]
    out = drift.unified(raw(spark, files))
    types = dict(out.dtypes)
    assert (types["dev"], types["id"], types["job"], types["n"], types["on"]) == ("string", "string", "string", "double", "boolean") and drift.unified(raw(spark, files).limit(0)).count() == 0
    got = {(r.path, r.line_number): r.asDict() for r in out.collect()}
    a, b = got[files[0][0], 0], got[files[1][0], 0]
    for r in (a, b):
        assert (r["dev"], r["id"], r["n"]) == ("007", "1e5", 1.0) and "3.10" in r.values() and "status" in r.values()
    assert a["job"] == "1_000" and a["gone"] == "z" and b["seq"] == '[4, {"a": null}]' and all(v is None for k, v in got[files[0][0], 1].items() if k not in ("path", "line_number", "source"))
    odd = got[files[1][0], 1]
    assert "hot" in {*odd.values(), *(odd["others"] or {}).values()} and any(v in (1.0, "1.0") for v in [*odd.values(), *(odd["others"] or {}).values()])


def test_names_across_sources_and_no_false_unions():
    p = lambda *v: drift.Profile.of(v)
    names = drift.canonical_names({("s", "a", "b"): 5, ("s", "b", "c"): 1}, [("s", ["a", "c"]), ("s", ["b"])], {("s", "a"): 9, ("s", "b"): 1, ("s", "c"): 1})
    assert names == {("s", "a"): "a", ("s", "b"): "a", ("s", "c"): "c"}
    own = {("B", "bed_temp"): "bed_temp", ("B", "dev"): "dev", ("C", "temps.bed_c"): "temps.bed_c", ("C", "dev"): "dev"}
    seen = {("B", "bed_temp"): p(60.0, 61.0, 24.0), ("B", "dev"): p("x"), ("C", "temps.bed_c"): p(60.0, 61.5, 24.0), ("C", "dev"): p("y")}
    assert drift.across_sources(own, seen, {"B": 2, "C": 1})["C", "temps.bed_c"] == "bed_temp"


def test_profiles_do_not_depend_on_how_records_are_batched():
    rnd = random.Random(6)
    values = [rnd.choice([None, True, "x", "12", rnd.random(), rnd.randrange(50), [1]]) for _ in range(400)]
    whole, parts_ = drift.Profile.of(values), drift.Profile.of(values[:90]).plus(drift.Profile.of(values[90:]))
    assert whole == parts_ and drift._unpack(drift._pack({"a": whole})) == {"a": whole} and len(whole.numbers) == drift.KMV
    assert [drift.Profile.of(v).code for v in ([None], [1, 2.0], [True, None], ["a", 1], [[]], [])] == ["", "n", "b", "ns", "o", ""]


def test_assignment_is_optimal():
    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = [[rnd.choice([0.0, rnd.random()]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in drift.assign(w))
        k = min(n, m)
        best = max(sum(w[i][j] for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9
