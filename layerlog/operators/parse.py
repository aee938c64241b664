"""Lines to events: extraction by source, event time, ordered validation, identity, and quarantine with lineage. All on the JVM.

The session's time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.instants import fixed

# Fixed values of the formats.
SOURCES = ("genA", "genB", "genC", "prusalink")
KINDS = ("status", "job_start", "job_end", "error", "maintenance")
#: JSON fields read, all as text; nested ones as objects
JSON_SCHEMA = """t:string, dev:string, model:string, fw:string, k:string, job:string, state:string, material:string, layers:string, ok:string, code:string, bed_temp:string,
 temp_bed:string, nozzle_temp:string, temp_nozzle:string, target_bed:string, target_nozzle:string, temp_unit:string, ts:string, type:string, outcome:string, received_at:string, device:struct<id:string,model:string,fw:string>, temps:struct<bed_c:string,nozzle_c:string,chamber_c:string>,
 targets:struct<bed_c:string,nozzle_c:string>, error:struct<code:string>, status:struct<printer:struct<state:string,temp_bed:string,temp_nozzle:string,target_bed:string,target_nozzle:string>>"""
EVENT_COLUMNS = [
    "path", "line_number", "parser_version", "source", "device_id", "model", "firmware", "kind", "device_ts_raw", "received_at", "event_ts", "event_date", "timestamp_quality", "clock_offset_seconds",
    "job_id", "state", "material", "layers", "bed_temp", "nozzle_temp", "chamber_temp", "target_bed_temp", "target_nozzle_temp", "temp_unit", "outcome", "error_code", "dedupe_key",
]
UNPARSED_COLUMNS = ["path", "line_number", "parser_version", "source", "received_at", "line", "reason", "device_id", "firmware", "firmware_source"]
EVENT_SCHEMA = """path string, line_number bigint, parser_version int, source string, device_id string, model string, firmware string, kind string, device_ts_raw string, received_at timestamp, event_ts timestamp,
 event_date date, timestamp_quality string, clock_offset_seconds double, job_id string, state string, material string, layers int, bed_temp double, nozzle_temp double, chamber_temp double, target_bed_temp double,
 target_nozzle_temp double, temp_unit string, outcome string, error_code string, dedupe_key string"""
UNPARSED_SCHEMA = "path string, line_number bigint, parser_version int, source string, received_at timestamp, line string, reason string, device_id string, firmware string, firmware_source string"


def read_object(line: Column, schema: str) -> dict[str, Column]:
    """Two parses of a text that should be one JSON object. ``j``: the object, as a value of a wrapping object; ``a``: as the only item of a
    wrapping list. Either alone lets some trailing text pass; together they admit one object and nothing else (see :func:`whole_object`)."""
    opts = {"allowSingleQuotes": "false"}
    return {"a": F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", opts), "j": F.from_json(F.concat(F.lit('{"w":'), line, F.lit("}")), f"struct<w:struct<{schema}>>", opts)["w"]}


def whole_object(a: str = "a", j: str = "j") -> Column:
    return F.coalesce((F.size(a) == 1) & F.col(a)[0].isNotNull() & F.col(j).isNotNull(), F.lit(False))


#: a number as text; underscores may stand between digits. The same contract as in :mod:`.structural`
NUMBER = r"^\s*[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?:[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"


def number(x: Column) -> Column:
    """Text as a double, null if it is none."""
    return F.when(x.rlike(NUMBER), F.replace(x, F.lit("_")).try_cast("double"))


def plain(x: Column) -> Column:
    """A JSON number that came as text in Java's notation (1.760922518906E9) as it is written without an exponent; other text stays."""
    digits = F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(x.rlike(r"^-?[0-9]\.[0-9]+E[0-9]{1,2}$"), F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)).otherwise(x)


def whole(x: Column) -> Column:
    return F.round(number(x)).try_cast("int")


def _naive(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), x.try_cast("timestamp_ntz").cast("timestamp"))


def _zoned(x: Column) -> Column:
    return F.when(x.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z") & x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.coalesce(x.try_cast("timestamp"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mmXXX"))))


def _blank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _fields(a, b, c, p) -> Column:
    """One value by source; genC's is the default, as for sources that are rejected anyway."""
    s = F.col("source")
    return F.when(s == "genA", a).when(s == "genB", b).when(s == "prusalink", p).otherwise(c)


def extract(lines: DataFrame, version: int) -> DataFrame:
    """Every line with all fields as typed nullable columns, its event time, and ``reason`` (null: accepted)."""
    rows = fixed(lines, **read_object(F.when(F.col("source") != "genA", F.col("line")), JSON_SCHEMA))
    rows = fixed(rows.withColumnRenamed("j", "_j"), j=F.when(whole_object("a", "_j"), F.col("_j"))).drop("a", "_j")
    line, head = F.col("line"), F.col("header")
    pick = lambda pattern: _blank(F.regexp_extract(line, pattern, 1))
    top = lambda pattern: F.regexp_extract(head, pattern, 1)
    j = lambda path: F.col(f"j.{path}")
    job_c = F.coalesce(F.get_json_object(j("job"), "$.id"), F.get_json_object(j("job"), "$.job.id"))
    mark = lambda label: line.rlike(rf"^(?s).{{19}} {label} ")
    kind_a = F.when(mark("(THERM|IDLE)"), "status").when(mark("JOB start"), "job_start").when(mark("JOB end"), "job_end").when(mark("ERR"), "error").otherwise("unknown")
    result = F.regexp_extract(line, " result=([^ ]+)", 1)
    said = lambda x, good, bad: F.when(x == good, "success").when(x == bad, "failure").otherwise("unknown")
    snap = "status.printer."
    rows = fixed(
        rows,
        device_id=_fields(top("device=([^ ]+)"), j("dev"), j("device.id"), j("device.id")),
        model=_fields(top("model=([^ ]+)"), j("model"), j("device.model"), j("device.model")),
        firmware=_fields(top("fw=([^ ]+)"), j("fw"), j("device.fw"), j("device.fw")),
        kind=_fields(kind_a, j("k"), j("type"), F.lit("status")),
        device_ts_raw=_fields(F.substring(line, 1, 19), plain(j("t")), j("ts"), j("received_at")),
        received=F.when(F.col("source") == "prusalink", F.when(j("received_at").rlike(r"^\d{4}-"), j("received_at").try_cast("timestamp"))).otherwise(F.col("received_at")),
        header_ts=_naive(top("device_time=(.{19})")),
        job_id=_fields(F.coalesce(pick(" id=([^ ]+)"), F.nullif(pick(" job=([^ ]+)"), F.lit("-"))), plain(j("job")), job_c, job_c),
        state=_fields(F.when(mark("THERM"), "PRINTING").otherwise("IDLE"), j("state"), j("state"), j(snap + "state")),
        material=_fields(pick('material="([^"]+)"'), j("material"), F.get_json_object(j("job"), "$.material"), F.get_json_object(j("job"), "$.material")),
        layers=_fields(pick(" layers=([^ ]+)"), j("layers"), F.get_json_object(j("job"), "$.layers"), F.get_json_object(j("job"), "$.layers")),
        bed_temp=_fields(pick(" bed=([^ ]+)"), F.coalesce(j("bed_temp"), j("temp_bed")), j("temps.bed_c"), j(snap + "temp_bed")),
        nozzle_temp=_fields(pick(" nozzle=([^ ]+)"), F.coalesce(j("nozzle_temp"), j("temp_nozzle")), j("temps.nozzle_c"), j(snap + "temp_nozzle")),
        chamber_temp=j("temps.chamber_c"),
        target_bed_temp=_fields(pick(" tgt_bed=([^ ]+)"), j("target_bed"), j("targets.bed_c"), j(snap + "target_bed")),
        target_nozzle_temp=_fields(pick(" tgt_nozzle=([^ ]+)"), j("target_nozzle"), j("targets.nozzle_c"), j(snap + "target_nozzle")),
        temp_unit=F.when(F.col("source") == "genB", F.coalesce(j("temp_unit"), F.lit("C"))).otherwise("C"),
        outcome=_fields(said(result, "ok", "fail"), said(j("ok"), "true", "false"), said(j("outcome"), "success", "failure"), said(j("outcome"), "success", "failure")),
        error_code=_fields(pick(" code=([^ ]+)"), j("code"), j("error.code"), j("error.code")),
        is_object=F.col("j").isNotNull(),
    )
    # texts are read once above; what follows only refers to them
    numbers = {c: number(F.col(c)) for c in ("bed_temp", "nozzle_temp", "chamber_temp", "target_bed_temp", "target_nozzle_temp")}
    rows = rows.withColumns(numbers | {"layers": whole(F.col("layers"))})
    offset_us = F.unix_micros("received") - F.unix_micros("header_ts")
    shifted = F.timestamp_micros(F.unix_micros(_naive(F.col("device_ts_raw"))) + offset_us)
    from_ms = F.timestamp_micros((F.round(number(F.col("device_ts_raw")) / 1000 * 1_000_000)).try_cast("long"))  # to the nearest microsecond
    event = _fields(shifted, from_ms, _zoned(F.col("device_ts_raw")), _zoned(F.col("device_ts_raw")))
    rows = fixed(rows, event_ts=event, clock_offset_seconds=F.when(F.col("source") == "genA", offset_us / 1e6))
    rows = rows.withColumn("timestamp_quality", F.when(F.col("source") == "genA", "upload_offset_estimate").when(F.col("source") == "prusalink", "received_only").otherwise("device_utc"))
    return rows.withColumn("reason", _reason(version)).drop("j", "received_at", "header").withColumnRenamed("received", "received_at")


def to_celsius(x: str, unit: str = "temp_unit") -> Column:
    return F.when(F.col(unit) == "F", (F.col(x) - 32) / F.lit(1.8)).otherwise(F.col(x))


def _reason(version: int) -> Column:
    """The first rule that a line breaks."""
    finite = lambda x: ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    status = F.col("kind") == "status"
    known = F.col("kind").isin(*KINDS) & ~((F.col("kind") == "maintenance") & F.lit(version < 2))
    bad_value = ~finite("bed_temp") | ~finite("nozzle_temp") | ~to_celsius("bed_temp").between(-50, 200) | ~to_celsius("nozzle_temp").between(-50, 500)
    rules = [
        ("unsupported_source", ~F.col("source").isin(*SOURCES)),
        ("invalid_json", (F.col("source") != "genA") & ~F.col("is_object")),
        ("missing_device", _blank(F.col("device_id")).isNull()),
        ("invalid_received_time", F.col("received").isNull()),
        ("invalid_device_time", F.col("event_ts").isNull()),
        ("future_event_time", F.col("event_ts") > F.col("received") + F.expr("INTERVAL '5' MINUTE")),
        ("unsupported_kind", ~F.coalesce(known, F.lit(False))),
        ("missing_job_id", F.col("kind").isin("job_start", "job_end") & _blank(F.col("job_id")).isNull()),
        ("missing_temperature", status & (F.col("bed_temp").isNull() | F.col("nozzle_temp").isNull())),
        ("unsupported_temperature_unit", status & ~F.col("temp_unit").isin("C", "F")),
        ("invalid_temperature", status & bad_value),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def identity_key(device="device_id", kind="kind", raw="device_ts_raw", job="job_id", state="state") -> Column:
    """SHA-256 of the message's identity as a JSON list; source and event time aren't part of it."""
    return F.sha2(F.to_json(F.array(F.col(device), F.col(kind), F.col(raw), F.coalesce(F.col(job), F.lit("")), F.when(F.col(kind) == "status", F.coalesce(F.col(state), F.lit(""))).otherwise(""))), 256)


def judged(extracted: DataFrame, version: int) -> DataFrame:
    """All lines with the columns of an event, ``reason`` and, where there is a reason, the ``line``."""
    ok = F.col("reason").isNull()
    rows = extracted.withColumn("parser_version", F.lit(version).cast("int")).withColumn("dedupe_key", F.when(ok, identity_key())).withColumn("event_date", F.when(ok, F.to_date("event_ts")))
    rows = rows.withColumn("state", F.when(F.col("kind") == "status", F.col("state"))).withColumn("outcome", F.when(F.col("kind") == "job_end", F.col("outcome")))
    return rows.withColumn("line", F.when(~ok, F.col("line"))).select(*EVENT_COLUMNS, "reason", "line", *[c for c in ("size", "sha256", "mtime_ms") if c in extracted.columns])


def accepted(extracted: DataFrame, version: int) -> DataFrame:
    return judged(extracted, version).where("reason is null").select(*EVENT_COLUMNS)


def quarantine(extracted: DataFrame, version: int) -> DataFrame:
    """Rejected lines with their reason. Device and firmware come from the line, else from the nearest earlier, then later, line of the upload that has them.

    The window runs over the lines of one upload, which are a file's and stay small.
    """
    by = W.partitionBy("path").orderBy("line_number")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)
    near = lambda c: F.coalesce(F.last(_blank(F.col(c)), True).over(before), F.first(_blank(F.col(c)), True).over(after))
    slim = extracted.select("path", "line_number", "source", "received_at", "line", "reason", "device_id", "firmware")
    rows = slim.withColumn("_d", near("device_id")).withColumn("_f", near("firmware")).where("reason is not null")
    own = _blank(F.col("firmware"))
    where = F.when(own.isNotNull(), F.when(F.col("source") == "genA", "header").otherwise("line")).when(F.col("_f").isNotNull(), "same_upload").otherwise("unknown")
    return rows.withColumn("firmware_source", where).withColumn("device_id", F.coalesce(_blank(F.col("device_id")), "_d")).withColumn("firmware", F.coalesce(own, "_f")).withColumn("parser_version", F.lit(version).cast("int")).select(*UNPARSED_COLUMNS)
