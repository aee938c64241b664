import datetime as dt
import json
import os

import pytest

from layerlog.operators import models, parse, quality
from layerlog.plans import pipeline, semantic
from layerlog.plans.pipeline import Store, run_pipeline
from layerlog.sources.fleet import simulate
from layerlog.sources.landing import decode

UTC = dt.timezone.utc
T0 = int(dt.datetime(2026, 9, 28, 8, tzinfo=UTC).timestamp())


def put(root, source, name, at, lines, header=""):
    folder = root / "landing" / f"received_date={dt.datetime.fromtimestamp(at, UTC).date()}" / f"source={source}"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{name}__{at}.{'txt' if header else 'jsonl'}"
    path.write_text(header + "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    return path


def b(sec, kind, **kw):
    return {"t": (T0 + sec) * 1000, "dev": "b1", "model": "B", "fw": "2.2.0", "k": kind, "job": "j", **kw}


def status(sec, **kw):
    return b(sec, "status", **({"bed_temp": 60.0, "nozzle_temp": 215.0, "state": "PRINTING"} | kw))


def parquet_files(root):
    return {str(p): p.stat().st_mtime_ns for p in (root / "data").rglob("*.parquet")}


def test_fleet_against_truth(spark, tmp_path):
    truth = simulate(spark, str(tmp_path), printers=9, days=2)
    out = run_pipeline(spark, str(tmp_path))
    assert out["rows"]["fact_print_job"] == truth.count() == 36 and out["duplicates_removed"] > 0
    fact = Store(spark, str(tmp_path)).table("fact_print_job")
    j = fact.alias("f").join(truth.alias("t"), ["device_id", "job_id"]).selectExpr("f.source", "abs(unix_micros(f.start_ts) - unix_micros(t.start_ts)) / 1e6 AS e", "f.outcome = t.outcome AS same").collect()
    assert len(j) == 36 and all(r.same for r in j) and all(r.e <= (90 if r.source == "genA" else 0) for r in j)
    before = parquet_files(tmp_path)
    again = run_pipeline(spark, str(tmp_path))
    assert again["run"]["no_op"] and again["run"]["files_processed"] == 0 and parquet_files(tmp_path) == before and again["rows"] == out["rows"]
    with pytest.raises(ValueError, match="version"):
        run_pipeline(spark, str(tmp_path), parser_version=2)
    second = run_pipeline(spark, str(tmp_path), parser_version=2, reprocess=True)
    cov = lambda o: next(r["coverage"] for r in o["coverage_by_source"] if r["source"] == "genC")
    assert cov(second) >= cov(out) and second["rows"]["fact_print_job"] == 36 and second["duplicates_removed"] == out["duplicates_removed"]
    with pytest.raises(ValueError, match="nothing was overwritten"):
        simulate(spark, str(tmp_path), printers=1, days=1)
    _semantic(spark, fact)


def _semantic(spark, fact):
    cube = semantic.PRINT_JOBS
    since, until = dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1)
    fact.createOrReplaceTempView("fact_print_job")
    for by, only in ((["model"], None), ([], {"model": "C"}), (["firmware", "material"], {"model": "B", "outcome": "success"})):
        r = cube.request(["prints", "failed_prints", "failure_rate"], by, only, since, until, companions=True)
        text, args = r.statement()
        a = r.frame(fact).collect()
        assert a == spark.sql(text, args=args).collect() and r.measures == ("prints", "failed_prints", "failure_rate", "labelled_prints", "unlabelled_prints")
        assert all(x.prints == x.labelled_prints + x.unlabelled_prints and (x.failure_rate is None or abs(x.failure_rate - x.failed_prints / x.labelled_prints) < 1e-12) for x in a)
    whole = {x.model: x for x in cube.request(["failure_rate", "labelled_prints"], ["model"], None, since, until).frame(fact).collect()}
    parts = cube.request(["failure_rate", "labelled_prints"], ["model", "firmware"], None, since, until).frame(fact).collect()
    for m, x in whole.items():  # recomputed from counts, not averaged
        assert abs(x.failure_rate * x.labelled_prints - sum(p.failure_rate * p.labelled_prints for p in parts if p.model == m)) < 1e-9
    assert cube.columns() | {"start_ts", "first_observed_ts"} <= set(fact.columns)
    e = cube.card("failure_rate")["examples"][0]
    cube.request(["failure_rate"], e["by"], e["only"], since, until).frame(fact).collect()
    assert set(cube.card("outcome")["values"]) == {"success", "failure", "unknown", "no_end_event"} and cube.card("failure_rate")["beside"] == ("labelled_prints", "unlabelled_prints")
    for bad in (dict(measures=["prints"]), dict(measures=["prints; drop"], since=since, until=until), dict(measures=["prints"], by=["device_id"], since=since, until=until), dict(measures=["prints"], only={"x": 1}, since=since, until=until)):
        with pytest.raises(ValueError):
            cube.request(**bad)
    text, args = cube.request(["prints"], [], {"model": "' OR 1=1 --"}, since, until).statement()
    assert "1=1" not in text and spark.sql(text, args=args).first().prints == 0


def test_increments(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no landing"):
        run_pipeline(spark, root)
    first = put(tmp_path, "genB", "b1", T0 + 600, [b(0, "job_start", material="PLA", layers="12.7"), status(60)])
    run_pipeline(spark, root)
    store = Store(spark, root)
    job = store.table("fact_print_job").first()
    assert (job.outcome, job.duration_seconds, job.layers, job.lifecycle_quality) == ("no_end_event", None, 13, "no_end_event")
    # the end comes three days later: the job is completed, one date is touched
    end = put(tmp_path, "genB", "b1", T0 + 3 * 86400, [b(7200, "job_end", ok=True), status(60)])
    out = run_pipeline(spark, root)
    job = store.table("fact_print_job").first()
    assert (job.outcome, job.duration_seconds) == ("success", 7200.0) and out["run"]["clean_partitions_touched"] == 1 and out["duplicates_removed"] == 1
    # a failure while modelling leaves a dirty snapshot that the next run repairs
    end.write_text(end.read_text().replace("true", "false"))
    monkeypatch.setattr(pipeline, "_model", lambda *a: (_ for _ in ()).throw(RuntimeError("disk")))
    with pytest.raises(RuntimeError):
        run_pipeline(spark, root)
    assert store.commit()["dirty"] and store.table("fact_print_job").first().outcome == "success"
    monkeypatch.undo()
    out = run_pipeline(spark, root)
    assert out["run"]["recovered_exports"] and out["run"]["files_processed"] == 0 and out["rows"]["parsed_events"] == 4
    assert store.table("fact_print_job").first().outcome == "failure" and not store.commit()["dirty"]
    # a failure while parsing changes nothing
    held = json.dumps(store.commit())
    put(tmp_path, "genB", "b2", T0 + 99, [status(1)])
    monkeypatch.setattr(parse, "judged", lambda *a: (_ for _ in ()).throw(RuntimeError("bad")))
    with pytest.raises(RuntimeError):
        run_pipeline(spark, root)
    assert json.dumps(store.commit()) == held
    monkeypatch.undo()
    # touched but equal: metadata only
    run_pipeline(spark, root)
    os.utime(first, ns=(1, 1))
    assert run_pipeline(spark, root)["run"]["no_op"] and store.known(store.commit())[str(first)][1] == 0
    # what increments built is what one run over everything builds
    rows = lambda: {t: sorted(map(str, store.table(t).drop("path").collect())) for t in ("clean_events", "fact_print_job", "dim_printer", "agg_status_hourly")}
    built = rows()
    run_pipeline(spark, root, reprocess=True)
    assert rows() == built
    first.unlink()
    with pytest.raises(ValueError, match="missing"):
        run_pipeline(spark, root)


def test_lines_appended_while_a_run_reads_arrive_with_the_next(spark, tmp_path, monkeypatch):
    path = put(tmp_path, "genB", "b1", T0 + 600, [status(60)])
    real = parse.judged

    def grown(*a):
        out = real(*a)
        with path.open("a") as f:  # after the listing, before anything is read
            f.write(json.dumps(status(90)) + "\n")
        return out

    write = pipeline.Store.write_plain

    def later(self, df, table, run):  # and after the lines were read
        if table == "manifest" and "-touched" not in run:
            with path.open("a") as f:
                f.write(json.dumps(status(120)) + "\n")
        return write(self, df, table, run)

    for attribute, change in ((("judged", parse), grown), (("write_plain", pipeline.Store), later)):
        monkeypatch.setattr(attribute[1], attribute[0], change)
        run_pipeline(spark, str(tmp_path))
        monkeypatch.undo()
        run_pipeline(spark, str(tmp_path))
        lines = len(path.read_text().splitlines())
        assert Store(spark, str(tmp_path)).table("parsed_events").count() == Store(spark, str(tmp_path)).table("clean_events").count() == lines
        assert run_pipeline(spark, str(tmp_path))["run"]["no_op"]


def test_batches_of_files_and_reasons(spark, tmp_path):
    for k in range(5):
        put(tmp_path, "genB", f"b{k}", T0 + 600 + k, [status(60 + k), "torn {"])
    with pytest.raises(ValueError):
        run_pipeline(spark, str(tmp_path), batch_files=0)
    out = run_pipeline(spark, str(tmp_path), batch_files=2)
    assert out["rows"]["parsed_events"] == 5 and out["run"]["files_processed"] == 5 and sum(r["lines"] for r in out["coverage_by_source"]) == 10
    assert {(r["firmware"], tuple(r["reasons"].items())) for r in out["rejects_by_firmware"]["by_version"]} == {("2.2.0", (("invalid_json", 5),))}
    put(tmp_path, "genB", "b9", T0 + 999, [])
    out = run_pipeline(spark, str(tmp_path))
    assert out["run"]["files_processed"] == 1 and run_pipeline(spark, str(tmp_path))["run"]["no_op"]


def test_event_moves_across_midnight(spark, tmp_path):
    header = "#UPLOAD device=a1 model=A fw=1.5.0 device_time=2026-09-28 23:59:00\n"
    lines = ["2026-09-28 23:50:00 IDLE bed=24 nozzle=25 tgt_bed=0 tgt_nozzle=0 fan=0 job=-"]
    day = int(dt.datetime(2026, 9, 28, tzinfo=UTC).timestamp())
    put(tmp_path, "genA", "a1", day + 86400 + 3600, lines, header)
    run_pipeline(spark, str(tmp_path))
    put(tmp_path, "genA", "a1", day + 86400 - 60, lines, header)
    out = run_pipeline(spark, str(tmp_path))
    clean = Store(spark, str(tmp_path)).table("clean_events").collect()
    assert out["duplicates_removed"] == 1 and out["run"]["clean_partitions_touched"] == 2 and [str(r.event_date) for r in clean] == ["2026-09-28"] and clean[0].clock_offset_seconds == 0.0


def lines_of(spark, rows):
    return spark.createDataFrame([("p" if len(r) < 4 else r[3], r[0], dt.datetime(2026, 9, 28, 9, tzinfo=UTC), r[2], i + 1, r[1]) for i, r in enumerate(rows)], "path string, source string, received_at timestamp, header string, line_number long, line string")


def test_reasons_and_lineage(spark):
    head = "#UPLOAD device=a1 model=A fw=1.5.0 device_time=2026-09-28 09:00:00"
    j = lambda o: json.dumps(o)
    rows = [
        ("genB", j(status(0, bed_temp=140, nozzle_temp=419, temp_unit="F")), "", "q"), ("genB", j(status(0, bed_temp=900)), "", "q"), ("genB", j(status(0, temp_unit="K")), "", "q"), ("genB", j(status(0) | {"t": "x"}), "", "q"), ("genB", j(b(0, "job_end") | {"job": None}), "", "q"), ("genB", '{"t": 1', "", "q"),
        ("genB", j(status(0)) + " {}", "", "q"), ("genB", j(status(0, bed_temp="1d")), "", "q"), ("genB", j(status(0) | {"dev": ""}), "", "q"), ("genB", j(status(7200)), "", "q"), ("other", "{}", "", "q"), ("genC", j({"ts": "2026-09-28T10:00:00+02:00", "device": {"id": "c", "fw": "3.1.0"}, "type": "maintenance"}), "", "c"),
        ("genC", j({"ts": "2026-09-28T10:00:00", "device": {"id": "c"}, "type": "error"}), "", "c"), ("genA", "2026-09-28 08:10:00 DBG x", head, "a"), ("genA", "2026-09-28 08:11:00 THERM bed=99.5 nozzle=254.0", head, "a"), ("prusalink", j({"received_at": "2026-09-28T08:00:00+00:00", "device": {"id": "s"}, "status": {"printer": {"temp_bed": 1, "temp_nozzle": 2, "state": "IDLE"}}, "job": {"id": 123}}), "", "s"),
    ]
    want = [None, "invalid_temperature", "unsupported_temperature_unit", "invalid_device_time", "missing_job_id", "invalid_json", "invalid_json", "missing_temperature", "missing_device", "future_event_time", "unsupported_source", "unsupported_kind", "invalid_device_time", "unsupported_kind", None, None]
    x = parse.extract(lines_of(spark, rows), 1)
    assert [r.reason for r in x.orderBy("line_number").collect()] == want
    ok = {r.line_number: r for r in parse.accepted(x, 1).collect()}
    assert ok[16].job_id == "123" and ok[16].timestamp_quality == "received_only" and ok[15].event_ts == dt.datetime(2026, 9, 28, 8, 11) and ok[1].dedupe_key and ok[15].state == "PRINTING"
    q = {r.line_number: r for r in parse.quarantine(x, 1).collect()}
    assert (q[6].device_id, q[6].firmware, q[6].firmware_source) == ("b1", "2.2.0", "same_upload") and q[14].firmware_source == "header" and q[11].firmware_source == "same_upload" and q[13].firmware_source == "same_upload"
    clean = {r.line_number: r for r in models.clean(parse.accepted(x, 1)).collect()}
    assert (clean[1].bed_c, clean[1].nozzle_c) == (60.0, 215.0)
    assert parse.extract(lines_of(spark, rows), 2).where("reason is null").count() == 4
    snap = models.job_fact(models.clean(parse.accepted(x, 1))).where("job_id = '123'").first()
    assert (snap.lifecycle_quality, snap.outcome, snap.duration_seconds) == ("observations_only", "no_end_event", None)


def test_suspects_and_decode(spark):
    schema = "source string, firmware string, reason string"
    parsed = spark.createDataFrame([("genC", "3.0.1", None), ("genC", "3.1.0", None), ("genB", "2", None)], schema)
    bad = spark.createDataFrame([("genC", "3.1.0", "unsupported_kind")] * 3 + [("genC", None, "invalid_json"), ("genB", "2", "x")], schema)
    assert [tuple(r) for r in quality.format_suspects(parsed, bad).collect()] == [("genC", "3.1.0", "unsupported_kind", 3)]
    rates = {(r.source, r.firmware): r.reject_rate for r in quality.rejects_by_firmware(parsed, bad).collect()}
    assert rates == {("genC", "3.0.1"): 0.0, ("genC", "3.1.0"): 0.75, ("genC", "unknown"): 1.0, ("genB", "2"): 0.5}
    up = spark.createDataFrame([("p", "genA", None, "#UPLOAD x", "#UPLOAD x\n a \n\n\tb")], "path string, source string, received_at timestamp, header string, content string")
    assert [(r.line_number, r.line) for r in decode(up).collect()] == [(2, "a"), (4, "\tb")]
