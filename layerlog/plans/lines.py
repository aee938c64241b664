"""Queries of reading lines: fields, times, reasons, lineage, casts, uploads, retraction, and whole ingestion runs; each with the same question in SQL."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, parse, quality, records
from ..session import checkpoint_dir
from ..sources.landing import decode
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _us(c: str):
    return F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c)


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """All raw lines at hand: records behind parsed events, and every unparsed line; genA lines with an upload header of a clock that is an hour slow."""
    r = table(spark, d, "raw_records").select("path", "source", "received_at", F.lit("").alias("header"), "line_number", F.col("payload").alias("line"))
    u = table(spark, d, "unparsed")
    slow = F.date_format(F.col("received_at") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit("#UPLOAD device="), F.coalesce("device_id", F.lit("")), F.lit(" model=A fw="), F.coalesce("firmware", F.lit("")), F.lit(" device_time="), slow)
    u = u.select("path", "source", "received_at", F.when(F.col("source") == "genA", F.coalesce(head, F.lit(""))).otherwise("").alias("header"), "line_number", F.trim("line").alias("line"))
    return r.unionByName(u)


#: the same lines and their fields in SQL; texts by source stand in lists, picked by the place of the source
_LINES = """raw AS (SELECT path, line_number, source, received_at, payload AS line, '' AS header FROM raw_records UNION ALL SELECT path, line_number, source, received_at, trim(line, ' '),
 if(source = 'genA', coalesce(concat_ws('', '#UPLOAD device=', coalesce(device_id, ''), ' model=A fw=', coalesce(firmware, ''), ' device_time=', NULL) || strftime(received_at - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), ''), '') FROM unparsed),
 o AS (SELECT *, list_position(['genA', 'genB', 'prusalink'], source) AS k, CASE WHEN source <> 'genA' AND json_valid(line) AND NOT regexp_matches(line, ',\\s*[}\\]]|:\\s*-?(NaN|Infinity)') THEN line::JSON END AS v FROM raw),
 p AS (SELECT *, if(json_type(v) = 'OBJECT', v, NULL) AS j, CASE substr(line, 20, 7) WHEN ' THERM ' THEN 'status' WHEN ' ERR cod' THEN 'error' END AS ka FROM o),
 t AS (SELECT path, line_number, source, header, line, j, coalesce(k, 4) AS k, received_at AS upload_at,
 [regexp_extract(header, 'device=([^ ]+)', 1), j->>'$.dev', j->>'$.device.id', j->>'$.device.id'][coalesce(k, 4)] AS device_id,
 [regexp_extract(header, 'model=([^ ]+)', 1), j->>'$.model', j->>'$.device.model', j->>'$.device.model'][coalesce(k, 4)] AS model,
 [regexp_extract(header, 'fw=([^ ]+)', 1), j->>'$.fw', j->>'$.device.fw', j->>'$.device.fw'][coalesce(k, 4)] AS firmware,
 [CASE WHEN line[20:] LIKE ' THERM %' OR line[20:] LIKE ' IDLE %' THEN 'status' WHEN line[20:] LIKE ' JOB start %' THEN 'job_start' WHEN line[20:] LIKE ' JOB end %' THEN 'job_end' WHEN line[20:] LIKE ' ERR %' THEN 'error' ELSE 'unknown' END, j->>'$.k', 'status', j->>'$.type'][coalesce(k, 4)] AS kind,
 [line[:19], j->>'$.t', j->>'$.received_at', j->>'$.ts'][coalesce(k, 4)] AS device_ts_raw,
 [coalesce(nullif(regexp_extract(line, ' id=([^ ]+)', 1), ''), nullif(nullif(regexp_extract(line, ' job=([^ ]+)', 1), ''), '-')), j->>'$.job', coalesce(j->>'$.job.id', j->>'$.job.job.id'), coalesce(j->>'$.job.id', j->>'$.job.job.id')][coalesce(k, 4)] AS job_id,
 [if(line[20:] LIKE ' THERM %', 'PRINTING', 'IDLE'), j->>'$.state', j->>'$.status.printer.state', j->>'$.state'][coalesce(k, 4)] AS state,
 [nullif(regexp_extract(line, 'material="([^"]+)"', 1), ''), j->>'$.material', j->>'$.job.material', j->>'$.job.material'][coalesce(k, 4)] AS material,
 try_cast([regexp_extract(line, ' layers=([^ ]+)', 1), j->>'$.layers', j->>'$.job.layers', j->>'$.job.layers'][coalesce(k, 4)] AS INTEGER) AS layers,
 try_cast([regexp_extract(line, ' bed=([^ ]+)', 1), coalesce(j->>'$.bed_temp', j->>'$.temp_bed'), j->>'$.status.printer.temp_bed', j->>'$.temps.bed_c'][coalesce(k, 4)] AS DOUBLE) AS bed_temp,
 try_cast([regexp_extract(line, ' nozzle=([^ ]+)', 1), coalesce(j->>'$.nozzle_temp', j->>'$.temp_nozzle'), j->>'$.status.printer.temp_nozzle', j->>'$.temps.nozzle_c'][coalesce(k, 4)] AS DOUBLE) AS nozzle_temp,
 try_cast(j->>'$.temps.chamber_c' AS DOUBLE) AS chamber_temp,
 try_cast([regexp_extract(line, ' tgt_bed=([^ ]+)', 1), j->>'$.target_bed', j->>'$.status.printer.target_bed', j->>'$.targets.bed_c'][coalesce(k, 4)] AS DOUBLE) AS target_bed_temp,
 try_cast([regexp_extract(line, ' tgt_nozzle=([^ ]+)', 1), j->>'$.target_nozzle', j->>'$.status.printer.target_nozzle', j->>'$.targets.nozzle_c'][coalesce(k, 4)] AS DOUBLE) AS target_nozzle_temp,
 if(k = 2, coalesce(j->>'$.temp_unit', 'C'), 'C') AS temp_unit,
 coalesce(map {'ok': 'success', 'fail': 'failure', 'true': 'success', 'false': 'failure', 'success': 'success', 'failure': 'failure'}[[nullif(regexp_extract(line, ' result=(ok|fail)( |$)', 1), ''), if(j->>'$.ok' IN ('true', 'false'), j->>'$.ok', NULL), if(j->>'$.outcome' IN ('success', 'failure'), j->>'$.outcome', NULL), if(j->>'$.outcome' IN ('success', 'failure'), j->>'$.outcome', NULL)][coalesce(k, 4)]], 'unknown') AS outcome,
 [nullif(regexp_extract(line, ' code=([^ ]+)', 1), ''), j->>'$.code', j->>'$.error.code', j->>'$.error.code'][coalesce(k, 4)] AS error_code,
 if(k = 3, try_cast(j->>'$.received_at' AS TIMESTAMPTZ), received_at) AS received_at, try_cast(regexp_extract(header, 'device_time=(.{19})', 1) AS TIMESTAMP) AT TIME ZONE 'UTC' AS header_at FROM p),
 x AS (SELECT *, CASE k WHEN 1 THEN received_at - (header_at - (try_cast(device_ts_raw AS TIMESTAMP) AT TIME ZONE 'UTC')) WHEN 2 THEN if(abs(try_cast(device_ts_raw AS DOUBLE)) < 9.2e15, make_timestamptz((try_cast(device_ts_raw AS DOUBLE) * 1000)::BIGINT), NULL)
 ELSE if(regexp_matches(device_ts_raw, '(Z|[+-][0-9]{2}:[0-9]{2})$'), try_cast(device_ts_raw AS TIMESTAMPTZ), NULL) END AS event_ts, if(temp_unit = 'F', 1.8, 1.0) AS slope, if(temp_unit = 'F', 32, 0) AS zero FROM t),
 g AS (SELECT *, coalesce(if(source IN ('genA', 'genB', 'genC', 'prusalink'), NULL, 'unsupported_source'), if(k <> 1 AND j IS NULL, 'invalid_json', NULL), if(coalesce(device_id, '') = '', 'missing_device', NULL), if(received_at IS NULL, 'invalid_received_time', NULL), if(event_ts IS NULL, 'invalid_device_time', NULL),
 if(epoch_us(event_ts) - epoch_us(received_at) > 300000000, 'future_event_time', NULL)) AS early,
 coalesce(if(kind LIKE 'job_%' AND coalesce(job_id, '') = '', 'missing_job_id', NULL), if(kind = 'status', coalesce(if(bed_temp + nozzle_temp IS NULL, 'missing_temperature', NULL), if(temp_unit IN ('C', 'F'), NULL, 'unsupported_temperature_unit'),
 if((bed_temp - zero) / slope BETWEEN -50 AND 200 AND (nozzle_temp - zero) / slope BETWEEN -50 AND 500, NULL, 'invalid_temperature')), NULL)) AS late FROM x),
 y AS (SELECT *, coalesce(early, if(kind IN ('status', 'job_start', 'job_end', 'error'), NULL, 'unsupported_kind'), late) AS reason, coalesce(early, if(kind IN ('status', 'job_start', 'job_end', 'error', 'maintenance'), NULL, 'unsupported_kind'), late) AS reason2 FROM g)"""


@query(f"WITH {_LINES} SELECT path, line_number, coalesce(reason, 'ok') AS reason_v1, coalesce(reason2, 'ok') AS reason_v2 FROM y")
def line_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every line with the first reason against it under either parser version."""
    lines = lines_of(spark, d)
    each = [parse.extract(lines, v).select("path", "line_number", F.coalesce("reason", F.lit("ok")).alias(f"reason_v{v}")) for v in (1, 2)]
    return each[0].join(each[1], ["path", "line_number"])


@query(f"""WITH {_LINES} SELECT path, line_number, coalesce(if(epoch_us(event_ts) > 4102444800000000, epoch_us(event_ts) // 1000000, epoch_us(event_ts)), -1) AS event_ts, coalesce(epoch_us(received_at), -1) AS received_at, coalesce(strftime(if(reason2 IS NULL, event_ts, NULL), '%Y-%m-%d'), '-') AS event_date,
 ['upload_offset_estimate', 'device_utc', 'received_only', 'device_utc'][k] AS timestamp_quality, coalesce(round(if(k = 1, (epoch_us(received_at) - epoch_us(header_at)) / 1e6, NULL), 6), -1) AS clock_offset_seconds FROM y""")
def line_times(spark: SparkSession, d: str) -> DataFrame:
    x = parse.judged(parse.extract(lines_of(spark, d), 2), 2)
    us = F.unix_micros("event_ts")  # beyond the year 2100 in whole seconds: times written in the wrong unit have no exact microseconds
    at = F.coalesce(F.when(us > 4_102_444_800_000_000, F.floor(us / 1_000_000).cast("long")).otherwise(us), F.lit(-1)).alias("event_ts")
    return x.select("path", "line_number", at, _us("received_at"), F.coalesce(F.col("event_date").cast("string"), F.lit("-")).alias("event_date"), "timestamp_quality", F.coalesce(F.round("clock_offset_seconds", 6), F.lit(-1.0)).alias("clock_offset_seconds"))


_NUMBERS = ("bed_temp", "nozzle_temp", "chamber_temp", "target_bed_temp", "target_nozzle_temp")
_TEXTS = ("device_id", "model", "firmware", "kind", "device_ts_raw", "job_id", "material", "temp_unit", "error_code")


@query(f"""WITH {_LINES} SELECT path, line_number, {", ".join(f"coalesce({c}, '-') AS {c}" for c in _TEXTS)}, coalesce(if(kind = 'status', state, NULL), '-') AS state, coalesce(if(kind = 'job_end', outcome, NULL), '-') AS outcome, coalesce(layers, -1) AS layers,
 {", ".join(f"coalesce(round({c}, 6)::VARCHAR, '-') AS {c}" for c in _NUMBERS)} FROM y WHERE reason2 IS NULL""")
def line_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every line that version 2 accepts."""
    x = parse.accepted(parse.extract(lines_of(spark, d), 2), 2)
    return x.select(
        "path", "line_number", *[F.coalesce(c, F.lit("-")).alias(c) for c in (*_TEXTS, "state", "outcome")], F.coalesce("layers", F.lit(-1)).alias("layers"), *[F.coalesce(F.round(c, 6).cast("string"), F.lit("-")).alias(c) for c in _NUMBERS]
    )


@query(f"WITH {_LINES} SELECT path, line_number, sha256(to_json(list_value(device_id, kind, device_ts_raw, ifnull(job_id, ''), if(kind = 'status', ifnull(state, ''), '')))) AS dedupe_key FROM y WHERE reason2 IS NULL")
def line_identity(spark: SparkSession, d: str) -> DataFrame:
    return parse.accepted(parse.extract(lines_of(spark, d), 2), 2).select("path", "line_number", "dedupe_key")


@query(f"""WITH {_LINES}, n AS (SELECT path, line_number, source, reason, nullif(device_id, '') AS dev, nullif(firmware, '') AS fw FROM y),
 q AS (SELECT *, coalesce(last_value(dev IGNORE NULLS) OVER b, first_value(dev IGNORE NULLS) OVER a) AS nd, coalesce(last_value(fw IGNORE NULLS) OVER b, first_value(fw IGNORE NULLS) OVER a) AS nf FROM n
 WINDOW b AS (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT path, line_number, reason, coalesce(dev, nd, '-') AS device_id, coalesce(fw, nf, '-') AS firmware, if(fw IS NULL, if(nf IS NULL, 'unknown', 'same_upload'), if(source = 'genA', 'header', 'line')) AS firmware_source FROM q WHERE reason IS NOT NULL""")
def quarantine_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with what they borrow from all other lines of their upload, accepted ones too."""
    q = parse.quarantine(parse.extract(lines_of(spark, d), 1), 1)
    return q.select("path", "line_number", "reason", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("device_id", "firmware")], "firmware_source")


_FORMS = ["{}", " {} ", "{}.5", "-{}.5", "+{}", "{}_000", "1__{}", "{}d", "{}e2", ".{}", "{},5", "nan", "inf", "", "x{}"]


@query("""SELECT p_partkey, form, coalesce(round(try_cast(s AS DOUBLE), 6)::VARCHAR, '-') AS number, coalesce(try_cast(s AS INTEGER), -1) AS whole
 FROM (SELECT p_partkey, f AS form, replace(f, '{}', p_partkey::VARCHAR) AS s FROM part, (SELECT unnest([""" + ", ".join(repr(f) for f in _FORMS) + "]) AS f))")
def number_casts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written as text, as the parser takes them."""
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(f) for f in _FORMS])).alias("form"))
    s = F.replace("form", F.lit("{}"), F.col("p_partkey").cast("string"))
    value = F.regexp_replace(F.lower(F.round(parse.number(s), 6).cast("string")), "^infinity$", "inf")
    return p.select("p_partkey", "form", F.coalesce(value, F.lit("-")).alias("number"), F.coalesce(parse.whole(s), F.lit(-1)).alias("whole"))


@query("""SELECT path, line_number, coalesce(json_type(if(json_valid(s), s, NULL)) <> 'OBJECT', true) AS broken FROM (SELECT path, line_number, source, unnest([line, line || ' x', '[' || line || ']', line || line, replace(line, '"', ''''), line[2:]]) AS s, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS n
 FROM (SELECT path, line_number, source, payload AS line FROM raw_records)) WHERE n > 0""")
def json_strict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a line is one JSON object and nothing else, for sound lines and for lines broken in five ways."""
    r = table(spark, d, "raw_records")
    p = F.col("payload")
    ways = F.array(p, F.concat(p, F.lit(" x")), F.concat(F.lit("["), p, F.lit("]")), F.concat(p, p), F.replace(p, F.lit('"'), F.lit("'")), F.substring(p, 2, 1 << 30))
    lines = r.select("path", "source", "received_at", F.lit("").alias("header"), "line_number", F.explode(ways).alias("line"))
    return parse.extract(lines, 2).select("path", "line_number", F.coalesce(F.col("reason") == "invalid_json", F.lit(False)).alias("broken"))


@query("""SELECT path, line_number, line FROM (SELECT path, source, generate_subscripts(l, 1)::BIGINT AS line_number, trim(unnest(l), ' ') AS line FROM (SELECT path, source, string_split(content, chr(10)) AS l FROM
 (SELECT path, source, if(source = 'genA', '#UPLOAD device=x' || chr(10), '') || string_agg(line, chr(10) || ' ' || chr(10) ORDER BY line_number) || chr(10) AS content FROM unparsed WHERE line IS NOT NULL GROUP BY path, source)))
 WHERE line <> '' AND NOT (source = 'genA' AND starts_with(line, '#UPLOAD'))""")
def upload_lines(spark: SparkSession, d: str) -> DataFrame:
    """Uploads put together from lines, with headers and blank lines, and taken apart again."""
    u = table(spark, d, "unparsed").where("line is not null").groupBy("path", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n \n").alias("body"))
    content = F.concat(F.when(F.col("source") == "genA", "#UPLOAD device=x\n").otherwise(""), "body", F.lit("\n"))
    ups = u.select("path", "source", F.lit(None).cast("timestamp").alias("received_at"), F.substring_index(content, "\n", 1).alias("header"), content.alias("content"))
    return decode(ups).select("path", "line_number", "line")


@query("""WITH gone AS (SELECT dedupe_key FROM parsed_events WHERE path LIKE '%-retry%'), r AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY received_at, path, line_number) AS was, row_number() OVER (PARTITION BY dedupe_key, path LIKE '%-retry%' ORDER BY received_at, path, line_number) AS is_
 FROM parsed_events WHERE dedupe_key IN (FROM gone)) SELECT strftime(event_date, '%Y-%m-%d') AS event_date, sum(t)::BIGINT AS before, sum(n)::BIGINT AS after FROM (SELECT event_date, (was = 1)::INT AS t, (is_ = 1 AND path NOT LIKE '%-retry%')::INT AS n FROM r) WHERE event_date IS NOT NULL GROUP BY event_date HAVING before + after > 0""")
def retracted_dates(spark: SparkSession, d: str) -> DataFrame:
    """Files that are withdrawn: the messages they take back, decided again; for each date touched, the canonical rows of those messages before and after."""
    e = table(spark, d, "parsed_events").select("path", "line_number", "received_at", "event_date", "dedupe_key")
    gone = F.col("path").like("%-retry%")
    keys = e.where(gone & F.col("dedupe_key").isNotNull()).select("dedupe_key").distinct()
    concerned = e.join(keys, "dedupe_key", "left_semi")
    count = lambda df, name: models.canonical(df).groupBy("event_date").agg(F.count(F.lit(1)).alias(name))
    both = count(concerned, "before").join(count(concerned.where(~gone), "after"), "event_date", "full_outer").where("event_date is not null")
    return both.select(F.col("event_date").cast("string").alias("event_date"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])


@query("SELECT source, firmware, to_json(map_from_entries(list((reason, n) ORDER BY reason))) AS reasons FROM (SELECT source, coalesce(firmware, 'unknown') AS firmware, reason, count(*) AS n FROM unparsed WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def reasons_by_firmware(spark: SparkSession, d: str) -> DataFrame:
    return quality.reasons_by_firmware(table(spark, d, "unparsed")).withColumn("reasons", F.to_json("reasons"))


# --- records ---------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, '{"name":' || to_json(c_name) || ',"parts":[{"fw":"1"},[{"x":' || c_custkey || '}]],"deep":{"kept":null}}' AS record FROM customer""")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Records with identity fields at every depth, without them."""
    c = table(spark, d, "customer")
    text = F.concat(F.lit('{"SERIAL":"a","name":'), F.to_json(F.struct("c_name")).substr(F.lit(11), F.length(F.to_json(F.struct("c_name"))) - 11), F.lit(',"parts":[{"sn":1,"fw":"1"},[{"Password":{"a":1},"x":'), F.col("c_custkey"), F.lit('}]],"deep":{"api_key":"k","kept":null}}'))
    return records.redact(c.select("c_custkey", text.alias("record")), "record")


@query("""SELECT c_custkey, regexp_matches(t, 'BEGIN ([A-Z0-9 ]+ )?PRIVATE KEY') AS private_key, regexp_matches(t, '\\b(AKIA|ASIA)[A-Z0-9]{16}\\b') AS access_key, regexp_matches(t, '\\bgh[pousr]_[A-Za-z0-9]{30,}\\b') AS code_token, regexp_matches(t, '"serial":"[^S]') AS serial
 FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'x -----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN 'AKIA' || upper(substr(md5(c_name), 1, 16)) WHEN 2 THEN 'ghp_' || md5(c_name) WHEN 3 THEN '"serial":"' || c_name || '"' WHEN 4 THEN '"serial":"SYNTHETIC-1"' ELSE c_name END AS t FROM customer)""")
def secrets_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with what must not be published in them: private keys, access keys, tokens, serials that aren't synthetic."""
    n = F.col("c_name")
    text = F.when(F.col("c_custkey") % 6 == 0, "x -----BEGIN RSA PRIVATE KEY-----").when(F.col("c_custkey") % 6 == 1, F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(n), 1, 16)))).when(F.col("c_custkey") % 6 == 2, F.concat(F.lit("ghp_"), F.md5(n)))
    text = text.when(F.col("c_custkey") % 6 == 3, F.concat(F.lit('"serial":"'), n, F.lit('"'))).when(F.col("c_custkey") % 6 == 4, '"serial":"SYNTHETIC-1"').otherwise(n)
    found = records.findings(table(spark, d, "customer").select("c_custkey", text.alias("t")), "t")
    return found.select("c_custkey", "private_key", "access_key", "code_token", "serial")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def jsonl_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    """A table as JSON lines, read with inferred types and kept as Parquet."""
    at = f"{checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    table(spark, d, "nation").write.json(f"{at}/lines")
    return records.convert_json_lines(spark, f"{at}/lines", f"{at}/table").select("n_nationkey", "n_name", "n_regionkey")


# --- whole runs ------------------------------------------------------------------------------------------------------------------------------


def _landed(spark: SparkSession, d: str):
    """Ingests the raw records in two runs: half of the files, then all of them; the store after the second."""
    from .pipeline import Store, run_pipeline

    root = f"{checkpoint_dir(spark).removeprefix('file:')}/landed-{uuid.uuid4().hex}"
    target = F.concat(F.lit("landing/received_date=2025-10-20/source="), "source", F.lit("/"), F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "__[0-9]*|\\.[a-z]+$", ""), F.lit("-"), F.substring(F.md5("path"), 1, 12), F.lit("__1761955200.jsonl"))
    files = table(spark, d, "raw_records").groupBy("path", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "payload"))), lambda x: x["payload"]), "\n").alias("body")).select(target.alias("to"), "body", (F.length("path") % 2).alias("odd"))

    def write(batches):
        for pdf in batches:
            for to, body in zip(pdf["to"], pdf["body"]):
                full = os.path.join(root, to)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w") as f:
                    f.write(body + "\n")
            yield pdf[["to"]]

    for part in (files.where("odd = 0"), files.where("odd = 1")):
        part.mapInPandas(write, "to string").count()
        if os.path.isdir(os.path.join(root, "landing")):
            run_pipeline(spark, root, 2)
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(root))
    shutil.rmtree(os.path.join(root, "landing"), ignore_errors=True)
    return Store(spark, root)


_INGESTED = _LINES.replace("UNION ALL SELECT path, line_number, source, received_at, trim(line, ' '),", "UNION ALL SELECT path, line_number, source, received_at, line,").replace("SELECT path, line_number, source, received_at, payload AS line, '' AS header FROM raw_records", "SELECT path, line_number, source, make_timestamptz(1761955200000000) AS received_at, payload AS line, '' AS header FROM raw_records").replace("FROM unparsed)", "FROM unparsed WHERE false)", 1)
_KEYED = f"""WITH {_INGESTED}, i AS (SELECT *, sha256(to_json(list_value(device_id, kind, device_ts_raw, ifnull(job_id, ''), if(kind = 'status', ifnull(state, ''), '')))) AS dedupe_key FROM y WHERE reason2 IS NULL)"""


@query(f"""{_KEYED} SELECT dedupe_key, min(epoch_us(event_ts)) AS event_ts, count(DISTINCT (epoch_us(received_at))) > 0 AS received, round(min((bed_temp - zero) / slope), 4) AS bed_c FROM i GROUP BY dedupe_key""")
def ingested_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean events after two runs over landing files made from the raw records. Copies of a message may differ in what isn't its identity: the least reading of its parsed
    copies is compared."""
    store = _landed(spark, d)
    parsed, clean = store.table("parsed_events"), store.table("clean_events")
    least = parsed.withColumn("_c", parse.to_celsius("bed_temp")).groupBy("dedupe_key").agg(F.min(F.unix_micros("event_ts")).alias("event_ts"), F.round(F.min("_c"), 4).alias("bed_c"))
    return clean.select("dedupe_key", F.col("received_at").isNotNull().alias("received")).join(least, "dedupe_key").select("dedupe_key", "event_ts", "received", "bed_c")


@query(f"""{_KEYED} SELECT source, count(*) AS lines, count(*) FILTER (reason2 IS NULL) AS parsed FROM y GROUP BY source""")
def ingested_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = _landed(spark, d).table("manifest")
    return m.groupBy("source").agg(F.sum("lines").alias("lines"), F.sum("parsed").alias("parsed"))


@query(f"""{_KEYED} SELECT device_id, count(DISTINCT dedupe_key) AS event_count, epoch_us(min(event_ts)) AS first_seen_ts, epoch_us(max(event_ts)) AS last_seen_ts, count(DISTINCT job_id) AS jobs_observed FROM i GROUP BY device_id""")
def ingested_devices(spark: SparkSession, d: str) -> DataFrame:
    x = _landed(spark, d).table("dim_printer")
    return x.select("device_id", "event_count", F.unix_micros("first_seen_ts").alias("first_seen_ts"), F.unix_micros("last_seen_ts").alias("last_seen_ts"), "jobs_observed")


#: p3_found in SQL: waiting lines, genA ones by whole shapes
WAITING = f"""WITH {_LINES}, w AS (SELECT y.*, CASE WHEN early IS NOT NULL AND NOT (k = 1 AND early = 'future_event_time') THEN early WHEN kind NOT IN ('status', 'job_start', 'job_end', 'error', 'maintenance') OR kind IS NULL THEN 'unsupported_kind'
 WHEN k = 1 AND length(replace(line, '"', '')) % 2 <> length(line) % 2 THEN 'broken_quoting' WHEN k = 1 AND NOT regexp_full_match(line[20:], ' (THERM|IDLE) +bed=[^ ]* +nozzle=[^ ]* +tgt_bed=[^ ]* +tgt_nozzle=[^ ]* +fan=[^ ]* +job=[^ ]* *| JOB start +id=[^ ]* +material=([^" ]|"[^"]*")* +layers=[^ ]* *| JOB end +id=[^ ]* +result=[^ ]* *| ERR +code=[^ ]* +job=[^ ]* *') THEN 'wrong_field_count'
 ELSE late END AS verdict FROM y SEMI JOIN (SELECT path, line_number FROM unparsed WHERE reason IS NULL) u USING (path, line_number)) SELECT path, line_number, verdict AS reason FROM w WHERE verdict IS NOT NULL"""
