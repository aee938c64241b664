"""Models over clean events: canonical events, job facts, hourly status, devices, failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import to_celsius

RANK = ("received_at", "path", "line_number")
CLEAN_COLUMNS = [
    "path", "line_number", "parser_version", "source", "device_id", "model", "firmware", "kind", "device_ts_raw", "received_at", "event_ts", "event_date", "timestamp_quality", "clock_offset_seconds",
    "job_id", "state", "material", "layers", "outcome", "error_code", "dedupe_key", "bed_c", "nozzle_c", "chamber_c", "target_bed_c", "target_nozzle_c",
]


def canonical(events: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One row for each key: earliest receipt, then path, then line. An aggregate, so repeats are combined before the shuffle and no group is sorted."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*RANK)).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in events.columns])


def clean(events: DataFrame) -> DataFrame:
    """Canonical events in °C; the chamber is reported in °C by every source."""
    one = canonical(events)
    temps = {f"{x}_c": to_celsius(f"{x}_temp") for x in ("bed", "nozzle", "target_bed", "target_nozzle")}
    return one.withColumns({**temps, "chamber_c": F.col("chamber_temp")}).select(*CLEAN_COLUMNS)


def _when(value: str, cond: Column) -> Column:
    return F.when(cond, F.col(value))


def _at(pick, value: str, extra: Column | None = None, ties=()) -> Column:
    """min_by/max_by over rows whose value isn't null (and that satisfy `extra`); ties in time go by receipt, path and line."""
    ok = F.col(value).isNotNull() & F.col("event_ts").isNotNull()
    return pick(value, F.when(ok if extra is None else ok & extra, F.struct("event_ts", *ties)))


def job_fact(events: DataFrame) -> DataFrame:
    """One row for each (device_id, job_id); what is missing stays visible in lifecycle_quality and outcome."""
    status, end = F.col("kind") == "status", F.col("kind") == "job_end"
    first = lambda c: _at(F.min_by, c, None, RANK).alias(c)
    jobs = events.where("job_id is not null").groupBy("device_id", "job_id").agg(
        first("source"), first("model"), first("firmware"), first("material"), F.max("layers").alias("layers"),
        F.min(_when("event_ts", F.col("kind") == "job_start")).alias("start_ts"), F.max(_when("event_ts", end)).alias("end_ts"),
        F.min("event_ts").alias("first_observed_ts"), F.max("event_ts").alias("last_observed_ts"), F.count_if(status).alias("readings"),
        *[F.max(_when(f"{x}_c", status)).alias(f"max_{x}_c") for x in ("bed", "nozzle", "chamber")],
        F.count_if(F.col("kind") == "error").alias("error_count"), first("timestamp_quality"), _at(F.max_by, "outcome", end, RANK).alias("_said"),
    )
    s, e = F.col("start_ts"), F.col("end_ts")
    quality = F.when(s.isNull() & e.isNull(), "observations_only").when(s.isNull(), "no_start_event").when(e.isNull(), "no_end_event").when(e < s, "end_before_start").otherwise("complete")
    return jobs.withColumns({
        "duration_seconds": F.when(e >= s, (F.unix_micros(e) - F.unix_micros(s)) / 1e6),
        "outcome": F.when(e.isNull(), "no_end_event").otherwise(F.coalesce("_said", F.lit("unknown"))),
        "lifecycle_quality": quality,
    }).drop("_said")


def status_hourly(events: DataFrame) -> DataFrame:
    """Samples (not uptime) by device, source, model, firmware and hour of event time."""
    return events.where("kind = 'status'").groupBy("device_id", "source", "model", "firmware", F.date_trunc("hour", "event_ts").alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("state") == "PRINTING").alias("printing_samples"), F.count_if(F.col("state") == "IDLE").alias("idle_samples"),
        F.avg("bed_c").alias("avg_bed_c"), F.avg("nozzle_c").alias("avg_nozzle_c"), F.max("nozzle_c").alias("max_nozzle_c"), F.avg("chamber_c").alias("avg_chamber_c"),
    )


def device_dim(events: DataFrame) -> DataFrame:
    """Latest non-null attributes and counts of each device. Distinct values are counted in two combined steps, so no device is collected."""
    last = lambda c, name: _at(F.max_by, c, None, RANK).alias(name)
    base = events.groupBy("device_id").agg(last("source", "source"), last("model", "model"), F.min("event_ts").alias("first_seen_ts"), F.max("event_ts").alias("last_seen_ts"), last("firmware", "current_firmware"), F.count(F.lit(1)).alias("event_count"))
    count = lambda c, name: events.groupBy("device_id", c).agg(F.lit(1)).groupBy("device_id").agg(F.count(c).alias(name)).withColumnRenamed("device_id", "_d")
    out = base
    for c, name in (("firmware", "firmware_versions_seen"), ("job_id", "jobs_observed")):
        n = count(c, name)
        out = out.join(n, out.device_id.eqNullSafe(n._d), "left").drop("_d")
    return out.select("device_id", "source", "model", "first_seen_ts", "last_seen_ts", "current_firmware", "firmware_versions_seen", "event_count", "jobs_observed")


def failure_rates(jobs: DataFrame) -> DataFrame:
    """Failures among jobs with a recorded result, by model, firmware and material; the rate is always made from counts."""
    o = F.col("outcome")
    counts = jobs.groupBy("model", "firmware", "material").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(o.isin("success", "failure")).alias("labelled_jobs"), F.count_if(o == "failure").alias("failures"),
        F.count_if(o == "unknown").alias("unknown_jobs"), F.count_if(o == "no_end_event").alias("no_end_jobs"),
    )
    return counts.withColumn("failure_rate", F.try_divide(F.col("failures").cast("double"), F.col("labelled_jobs")))
