"""Quality of ingestion: coverage, reasons, rejects by firmware, suspected format changes, lateness, outcomes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def coverage(manifest: DataFrame) -> DataFrame:
    """(source, lines, parsed, coverage); a source without lines has a null coverage."""
    sums = manifest.groupBy("source").agg(F.sum("lines").cast("long").alias("lines"), F.sum("parsed").cast("long").alias("parsed"))
    return sums.withColumn("coverage", F.try_divide(F.col("parsed").cast("double"), F.col("lines")))


def line_counts(extracted: DataFrame) -> DataFrame:
    """(path, lines, parsed) of each upload."""
    return extracted.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("parsed"))


def rejects_by_firmware(parsed: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(source, firmware, accepted, rejected, reject_rate): full outer over both tables; a null firmware is 'unknown'."""
    known = F.coalesce("firmware", F.lit("unknown")).alias("firmware")
    a = parsed.groupBy("source", known).agg(F.count(F.lit(1)).alias("accepted"))
    r = unparsed.groupBy("source", known).agg(F.count(F.lit(1)).alias("rejected"))
    both = a.join(r, ["source", "firmware"], "full_outer").select("source", "firmware", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return both.withColumn("reject_rate", F.col("rejected") / (F.col("accepted") + F.col("rejected")))


def reasons_by_firmware(unparsed: DataFrame) -> DataFrame:
    """(source, firmware, reasons): the lines of each reason as a map; a null firmware is 'unknown'. Reasons are a dozen."""
    counts = unparsed.groupBy("source", F.coalesce("firmware", F.lit("unknown")).alias("firmware"), "reason").agg(F.count(F.lit(1)).alias("lines"))
    known = counts.where("reason is not null").groupBy("source", "firmware").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "lines")))).alias("reasons"))
    return known


def format_suspects(parsed: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(source, firmware, reason, lines): a reason that exactly one known firmware of a source gives, where the source has several.

    Both counts run over tables reduced to one row for each firmware or reason.
    """
    versions = parsed.select("source", "firmware").unionByName(unparsed.select("source", "firmware")).where("firmware is not null and firmware <> 'unknown'").distinct()
    several = versions.groupBy("source").count().where("count > 1").select("source")
    reasons = unparsed.where("firmware is not null and firmware <> 'unknown' and reason is not null").groupBy("source", "firmware", "reason").agg(F.count(F.lit(1)).alias("lines"))
    alone = reasons.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("source", "reason"))).where("_n = 1").drop("_n")
    return alone.join(several, "source", "left_semi").select("source", "firmware", "reason", "lines")


def lateness(clean: DataFrame, points=((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) -> DataFrame:
    """(source, p50, p95, p99, over_one_day) of seconds from event to receipt; exact, interpolated percentiles.

    Values are counted first; running counts are taken within hours of lateness and over the hours, so that no task holds the values of a source, and the values at
    the ranks are picked. Rows without either time bear no lateness, but their source is listed.
    """
    us = F.unix_micros("received_at") - F.unix_micros("event_ts")
    counts = clean.select("source", us.alias("_v")).groupBy("source", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_h", F.floor(F.col("_v") / 3_600_000_000)).where("_v is not null")
    hours = counts.groupBy("source", "_h").agg(F.sum("_c").alias("_hc"))
    whole = hours.groupBy("source").agg(F.sum("_hc").alias("_n"))
    hours = hours.withColumn("_before", F.sum("_hc").over(W.partitionBy("source").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)))  # one row an hour of lateness
    hours = hours.join(whole, "source").withColumn("_before", F.coalesce("_before", F.lit(0)))
    low = {n: F.floor((F.col("_n") - 1) * p).cast("long") for p, n in points}
    wanted = F.array_distinct(F.array(*[x for n in low for x in (low[n], F.least(low[n] + 1, F.col("_n") - 1))]))
    # only hours that hold a rank are looked into
    hit = hours.withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_hc")))).where(F.size("_ranks") > 0)
    near = counts.join(hit.select("source", "_h", "_before", "_ranks", "_n"), ["source", "_h"])
    end = F.col("_before") + F.sum("_c").over(W.partitionBy("source", "_h").orderBy("_v"))
    at = near.withColumn("_end", end).withColumn("_rank", F.explode("_ranks")).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    value = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_v")))
    picked = []
    for p, n in points:
        k = (F.col("_n") - 1) * F.lit(p)
        a, b = value(low[n]), value(F.least(low[n] + 1, F.col("_n") - 1))
        picked.append(((a + (b - a) * F.max(k - low[n])) / 1e6).alias(n))
    got = at.groupBy("source").agg(*picked)
    over = clean.groupBy("source").agg(F.count_if(us > 86_400_000_000).alias("over_one_day")).withColumnRenamed("source", "_s")
    return over.join(got, F.col("_s").eqNullSafe(F.col("source")), "left").select(F.col("_s").alias("source"), *[n for _, n in points], "over_one_day")


def counts_by(df: DataFrame, *keys: str, name: str = "lines") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def report(tables: dict[str, DataFrame], manifest: DataFrame) -> dict:
    """The report as plain values. Every section is an aggregate of a few rows (sources, firmware, reasons, models); they run side by side."""
    from .models import failure_rates

    parsed, clean, bad, jobs = (tables[t] for t in ("parsed_events", "clean_events", "unparsed", "fact_print_job"))
    rows = lambda df, *order: [r.asDict() for r in df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()]
    work = {
        "rows": lambda: {r.t: r.n for r in reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(k)) for k, df in tables.items()]).collect()},
        "coverage_by_source": lambda: rows(coverage(manifest), "source"),
        "unparsed_reasons": lambda: rows(counts_by(bad, "source", "reason"), "source", "reason"),
        "by_version": lambda: rows(rejects_by_firmware(parsed, bad).join(reasons_by_firmware(bad), ["source", "firmware"], "left").withColumn("reasons", F.coalesce("reasons", F.create_map().cast("map<string,bigint>"))), "source", "firmware"),
        "format_change_suspects": lambda: rows(format_suspects(parsed, bad), "source", "firmware", "reason"),
        "lateness_seconds": lambda: rows(lateness(clean), "source"),
        "timestamp_quality": lambda: rows(counts_by(clean, "timestamp_quality", name="events"), "timestamp_quality"),
        "outcomes": lambda: rows(counts_by(jobs, "outcome", name="jobs"), "outcome"),
        "failure_rates": lambda: rows(failure_rates(jobs), "model", "firmware", "material"),
    }
    out = side_by_side(work)
    out["rejects_by_firmware"] = {k: out.pop(k) for k in ("by_version", "format_change_suspects")}
    return {**out, "duplicates_removed": out["rows"]["parsed_events"] - out["rows"]["clean_events"]}


def side_by_side(work: dict) -> dict:
    """Runs independent Spark actions from threads of their own; the first error is raised once all have ended."""
    with ThreadPoolExecutor(max_workers=min(8, max(1, len(work)))) as pool:
        started = {k: pool.submit(f) for k, f in work.items()}
    return {k: f.result() for k, f in started.items()}
