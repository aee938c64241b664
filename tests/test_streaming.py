import datetime as dt

from layerlog.streaming.ingest import HourSink, SequenceSink, hourly_stream

SCHEMA = "device_id string, kind string, state string, event_ts timestamp, bed_c double, nozzle_c double, received_at timestamp"


def test_late_messages_correct_the_trees_of_a_stream(spark, tmp_path):
    at = dt.datetime(2025, 10, 15, 5)
    got = lambda h: at + dt.timedelta(hours=h)
    batches = [
        [("a", "status", "IDLE", at, 1.0, 2.0, at), ("a", "status", "PRINTING", at + dt.timedelta(minutes=5), 3.0, 4.0, at)],
        [("a", "status", "IDLE", at, 8.0, 9.0, got(20))],  # late
        [("a", "status", "IDLE", got(70), 1.0, 1.0, got(70)), ("a", "job_end", None, at, None, None, got(70))],
        [("a", "status", "IDLE", at, 9.0, 9.0, got(71)), ("a", "status", "IDLE", None, 9.0, 9.0, got(71))],  # too late, and no time at all
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        sink = HourSink(spark, str(tmp_path / "state"))
        hourly_stream(stream, sink, str(tmp_path / "ck")).awaitTermination()
        hours = {r.hour_s: r for r in sink.table(i).collect()}
        first = hours[int(at.replace(tzinfo=dt.timezone.utc).timestamp())]
        assert (first.now[0], first.now[3], first.published[0], first.dropped, first.open) == [(2, 4.0, 2, 0, True), (3, 12.0, 2, 0, True), (3, 12.0, 2, 0, False), (3, 12.0, 2, 1, False)][i]
    assert len(hours) == 2 and hours[first.hour_s + 70 * 3600].now[0] == 1


def test_sequence_sink_runs_again_alike(spark, tmp_path):
    sink = SequenceSink(spark, str(tmp_path / "state"), str(tmp_path / "out"), "id", "dev", ("at",))
    for n, ids in enumerate((["m-1", "m-2", "m-2"], ["m-2", "m-3"], ["m-1", "m-9"])):
        df = spark.createDataFrame([(x, "d", i) for i, x in enumerate(ids)], "id string, dev string, at long")
        sink(df, n)
        sink(df, n)
    got = sorted(r.id for n in range(3) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect())
    assert got == ["m-1", "m-2", "m-3", "m-9"]


def test_sink_keeps_one_of_every_kind_of_identifier(spark, tmp_path):
    rest = ("what",)
    sink = SequenceSink(spark, str(tmp_path / "state"), str(tmp_path / "out"), "id", "dev", ("at",), rest)
    batches = [
        # a number, a digest in two cases, free text, a null with the key of its copy beside it, two nulls without
        [("m-1", "a"), ("00ffAB", "b"), ("00FFab", "b"), ("free text", "c"), ("free text", "c"), (None, "c"), (None, "d"), (None, "d"), (None, "e"), (None, None), (None, None)],
        # copies of the above, by key and by natural id, and keys that come after their message; only the last four are new
        [("m-1", "a"), ("00ffab", "b"), (None, "a"), (None, "b"), (None, None), ("00ee", "d"), ("m-7", "e"), ("m-2", "f"), ("beef", "g"), (None, "h"), ("free", "i")],
        [("m-7", "e"), ("00EE", "d"), (None, "g"), ("m-2", "f"), (None, "f"), ("other", "d"), (None, "h"), ("m-3", "h")],
    ]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(x, "d", what, 100 * n + i) for i, (x, what) in enumerate(rows)], "id string, dev string, what string, at long")
        sink(df, n)
        sink(df, n)
    got = [sorted(((r.id, r.what) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect()), key=str) for n in range(3)]
    want = [[("m-1", "a"), ("00ffAB", "b"), ("free text", "c"), (None, "d"), (None, "e"), (None, None)], [("m-2", "f"), ("beef", "g"), (None, "h"), ("free", "i")], [("other", "d")]]
    assert got == [sorted(w, key=str) for w in want]


def test_sink_equals_one_table(spark, tmp_path):
    from layerlog.operators import delivery

    from .test_delivery import SCHEMA as ROWS, rows_of

    rows = sorted((tuple(r.values()) for r in rows_of(7, 300)), key=lambda r: (r[8], r[0], r[1]))
    sink = SequenceSink(spark, str(tmp_path / "state"), str(tmp_path / "out"), "dedupe_key", "device_id", ("received_at", "path", "line_number"))
    for n in range(3):
        sink(spark.createDataFrame(rows[100 * n : 100 * n + 100], ROWS), n)
    got = sorted((r.path, r.line_number) for n in range(3) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect())
    assert got == sorted((r.path, r.line_number) for r in delivery.keep_one(spark.createDataFrame(rows, ROWS)).collect())
