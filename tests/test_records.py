import datetime as dt
import json

import pytest

from layerlog.operators import records
from layerlog.plans.pipeline import Store, run_pipeline
from layerlog.sources import collector

UTC = dt.timezone.utc
ANSWERS = {
    "/api/version": {"firmware": "6.1", "api": "2", "server": "1.2"}, "/api/v1/info": {"serial": "S-77", "nozzle_diameter": 0.4},
    "/api/v1/status": {"printer": {"state": "IDLE", "temp_bed": 24.5, "temp_nozzle": 25, "target_bed": 0, "target_nozzle": 0}, "SN": "S-77"}, "/api/v1/job": {"id": 12, "file": {"api_key": "x", "name": "part"}},
}


def printer(broken=()):
    calls = iter(range(1000))

    def read(path):
        n = next(calls)
        return (500, b"") if n in broken else (200, json.dumps(ANSWERS[path]).encode())

    return collector.Printer(read)


def test_snapshots_are_appended_and_ingested(spark, tmp_path):
    at = iter([dt.datetime(2026, 9, 28, 10, 59, 58, tzinfo=UTC) + dt.timedelta(seconds=k) for k in range(99)])
    waits = []
    taken = collector.collect(printer(broken=(4, 5)), str(tmp_path / "landing"), 3, 5.0, lambda: next(at), waits.append)
    assert taken == 3 and len(waits) == 4 and max(waits) <= 5.0
    files = sorted((tmp_path / "landing").rglob("*.jsonl"))
    assert len(files) == 2 and "S-77" not in "".join(f.read_text() for f in files) and "api_key" not in files[0].read_text()
    run_pipeline(spark, str(tmp_path))
    rows = Store(spark, str(tmp_path)).table("clean_events").collect()
    assert len(rows) == 3 and {r.device_id for r in rows} == {files[0].name.split("__")[0]} and {(r.job_id, r.bed_c, r.timestamp_quality) for r in rows} == {("12", 24.5, "received_only")}


def test_collector_refuses(tmp_path):
    with pytest.raises(collector.CollectorError, match="allowed"):
        printer().get("/api/v1/job/12/cancel")
    for host in ("ftp://x", "http://u:p@x", "http://x/api", "http://x?a=1"):
        with pytest.raises(collector.CollectorError):
            collector.http_reader(host, "u", "p")
    waits = []
    with pytest.raises(collector.CollectorError):
        collector.collect(printer(broken=range(2, 99)), str(tmp_path), 1, 1.0, lambda: dt.datetime(2026, 1, 1, tzinfo=UTC), waits.append)
    assert len(waits) == 4 and waits[-1] > 15 and not list(tmp_path.iterdir())
    assert collector.Printer(lambda p: (204, b"")).get("/api/v1/job") == (204, None)
    with pytest.raises(collector.CollectorError, match="object"):
        collector.Printer(lambda p: (200, b"[1]")).get("/api/v1/job")


def test_redaction_and_findings(spark):
    rows = [('{"Serial":1,"a":[{"sn":2,"b":{"PASSWORD":3,"c":"é"}}]}',), ("not json",), (None,), ("[]",), ('{"serial_no":1}',)]
    assert [r.t for r in records.redact(spark.createDataFrame(rows, "t string"), "t").collect()] == ['{"a":[{"b":{"c":"é"}}]}', None, None, "[]", '{"serial_no":1}']
    texts = [("-----BEGIN PRIVATE KEY-----",), ("sk-ant-" + "a" * 40,), ("github_pat_" + "b" * 40,), ("'SN': 'X1'",), ("'sn': 'SYNTHETIC-4'",), (None,), ("",)]
    got = [[k for k in records.SECRETS if r[k]] for r in records.findings(spark.createDataFrame(texts, "t string"), "t").collect()]
    assert got == [["private_key"], ["api_key"], ["code_token"], ["serial"], [], [], []]
