"""The pN_ queries of the core: each problem's operator on its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import clocks, delivery, drift, lateness, spikes, structural, units

ID = ["path", "line_number"]
KEYS = ["device_id", "dedupe_key", "kind", "device_ts_raw", "job_id", "state", "received_at"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "clean_events"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    m = delivery.keep_one(table(spark, d, "parsed_events").select(*ID, *KEYS, "event_ts").where("kind = 'status'"), columns=["device_id", "event_ts", "received_at"])
    return lateness.stale_hours(m)


def p2_hours(spark: SparkSession, d: str) -> DataFrame:
    """agg_status_hourly as it is to stand, in °C, with what was published and how many messages came late or too late."""
    by = ["device_id", "source", "model", "firmware"]
    temps = ["temp_unit", "bed_temp", "nozzle_temp", "chamber_temp", "target_bed_temp", "target_nozzle_temp"]
    e = table(spark, d, "parsed_events").select(*ID, *KEYS, *by[1:], "event_ts", *temps).where("kind = 'status'")
    m = units.status_units(delivery.keep_one(e, columns=[*by, "kind", "job_id", "state", "event_ts", "received_at", *temps])).withColumn("chamber_c", F.col("chamber_temp"))
    return lateness.correct_table(table(spark, d, "agg_status_hourly"), m, by)


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The waiting lines that load under version 2, as typed fields."""
    waiting = table(spark, d, "unparsed").where("reason is null")
    return structural.load_lines(waiting).where("verdict is null").drop("verdict")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return structural.rejects(table(spark, d, "unparsed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.surplus(table(spark, d, "parsed_events").select(*ID, *KEYS), columns=ID)


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Messages of producers that count, in three batches by receipt: numbers by ranges, every tenth line by its digest. The accepted rows."""
    counted = F.concat("source", F.lit("-"), "line_number")
    e = table(spark, d, "parsed_events").select(*ID, *KEYS, "source").withColumn("id", F.when(F.col("line_number") % 10 == 0, F.coalesce("dedupe_key", "path")).otherwise(counted))
    at = F.coalesce(F.to_date("received_at"), F.lit("2025-01-01").cast("date"))
    edges = ("1970-01-01", "2025-10-24", "2025-10-29", "9999-01-01")
    batches = [e.where((at >= F.lit(a).cast("date")) & (at < F.lit(b).cast("date"))) for a, b in zip(edges, edges[1:])]
    return delivery.accept_all(batches, "id", "device_id", columns=ID)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_units(table(spark, d, "parsed_events"))


def p5_celsius(spark: SparkSession, d: str) -> DataFrame:
    """Every status row with its true unit and its values in °C."""
    need = [*ID, "device_id", "job_id", "kind", "temp_unit", "bed_temp", "nozzle_temp", "target_bed_temp", "target_nozzle_temp"]
    return units.status_units(table(spark, d, "parsed_events").select(*need)).select(*ID, "unit", "label_unit", "bed_c", "nozzle_c", "target_bed_c", "target_nozzle_c")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clocks.misdated(table(spark, d, "parsed_events"), table(spark, d, "dim_printer"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_records")).select("path", "change", "old_field", "new_field")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_records"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_hours": p2_hours, "p3_found": p3_found, "p3_rows": p3_rows, "p5_celsius": p5_celsius, "p4_found": p4_found, "p4_sequences": p4_sequences, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_table": p7_table}
