"""Incremental ingestion: landing files to parsed, clean and modelled tables, committed as one snapshot.

Every run writes immutable directories and one small commit file that lists, for each table and event date, the live directories; the commit takes
effect when ``CURRENT`` is replaced.  Readers see whole snapshots, a failed run leaves the last one in force, and what it wrote is swept away by the
next run.  Files are read and parsed once, in portions of `batch_files`, and written by event date with their rejected lines beside them; size and hash of
a file are those of the content that was parsed.  Only messages whose key occurs in new or changed files are decided again, only event dates they touch are
rewritten, and only devices they concern are modelled anew.  The manifest is a table.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, parse, quality
from ..session import cut
from ..sources.landing import OF_FILE, Upload, decode, discover, read_uploads

FILE_BYTES = 16 << 20  #: raw bytes of one date for each file written
REJECTED = "rejected"  #: stands for the date of lines that have none
MODELS = ("fact_print_job", "agg_status_hourly", "dim_printer")
CLEAN_SCHEMA = """path string, line_number bigint, parser_version int, source string, device_id string, model string, firmware string, kind string, device_ts_raw string, received_at timestamp, event_ts timestamp,
 event_date date, timestamp_quality string, clock_offset_seconds double, job_id string, state string, material string, layers int, outcome string, error_code string, dedupe_key string, bed_c double, nozzle_c double,
 chamber_c double, target_bed_c double, target_nozzle_c double"""
MANIFEST = "path string, size bigint, sha256 string, mtime_ms bigint, parser_version int, source string, lines bigint, parsed bigint"
SCHEMAS = {"parsed_events": parse.EVENT_SCHEMA, "clean_events": CLEAN_SCHEMA, "unparsed": parse.UNPARSED_SCHEMA, "manifest": MANIFEST}
EMPTY = {"tables": {"parsed_events": {}, "clean_events": {}, "unparsed": [], "manifest": []}, "models": {}, "dirty": False}


class Store:
    """Tables of one data directory by committed snapshots."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.pointer = os.path.join(self.root, "state", "CURRENT")

    def commit(self) -> dict:
        try:
            with open(self.pointer) as f:
                return json.load(f)
        except FileNotFoundError:
            return json.loads(json.dumps(EMPTY))

    def publish(self, commit: dict) -> None:
        _write_json(self.pointer, commit)

    def partitions(self, table: str, commit: dict, dates=None) -> DataFrame:
        """Rows of a dated table, of all dates or some."""
        live = [d for day, ds in commit["tables"][table].items() if dates is None or day in dates for d in ds]
        if not live:
            return self.spark.createDataFrame([], SCHEMAS[table])
        base = os.path.join(self.root, "data", table)
        return self.spark.read.option("basePath", base).schema(SCHEMAS[table] + ", run string").parquet(*[os.path.join(base, d) for d in live]).drop("run")

    def plain(self, table: str, commit: dict) -> DataFrame:
        live = commit["tables"][table]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[os.path.join(self.root, "data", table, d) for d in live]) if live else self.spark.createDataFrame([], SCHEMAS[table])

    def write_dated(self, df: DataFrame, table: str, run: str, files: int) -> dict[str, list[str]]:
        """Writes a run's rows, one directory a date, in up to `files` files; {date: [directory]}. Rows without a date go to REJECTED."""
        target = os.path.join(self.root, "data", table, f"run={run}")
        # a date may hold most of a run, and a device most of a date: it is spread by device and quarter of the day; adaptive execution joins what is small
        rows = df.withColumn("_day", F.coalesce(F.col("event_date").cast("string"), F.lit(REJECTED)))
        spread = F.pmod(F.xxhash64("device_id", (F.hour("event_ts") / 6).cast("int")), F.lit(max(1, files)))
        rows = rows.repartition("_day", spread).sortWithinPartitions("_day", "device_id", "event_ts", "kind")
        rows.drop("event_date").withColumnRenamed("_day", "event_date").write.partitionBy("event_date").option("compression", "zstd").parquet(target)
        made = sorted(n for n in os.listdir(target) if n.startswith("event_date="))
        return {n.split("=", 1)[1]: [f"run={run}/{n}"] for n in made}

    def write_plain(self, df: DataFrame, table: str, run: str) -> str:
        df.write.option("compression", "zstd").parquet(os.path.join(self.root, "data", table, f"run={run}"))
        return f"run={run}"

    def table(self, name: str) -> DataFrame:
        commit = self.commit()
        if name in MODELS:
            return self.spark.read.parquet(os.path.join(self.root, "data", name, commit["models"][name]))
        return self.plain(name, commit) if name in ("unparsed", "manifest") else self.partitions(name, commit)

    def known(self, commit: dict) -> dict[str, tuple]:
        """{path: (size, mtime_ms, sha256, parser_version)} of the files ingested, for planning: as long as the listing of the landing zone."""
        out: dict[str, tuple] = {}
        for d in commit["tables"]["manifest"]:
            t = pq.read_table(os.path.join(self.root, "data", "manifest", d), columns=["path", "size", "mtime_ms", "sha256", "parser_version"])
            out.update(zip(t["path"].to_pylist(), zip(*[t[c].to_pylist() for c in ("size", "mtime_ms", "sha256", "parser_version")])))
        return out

    def sweep(self, *commits: dict) -> None:
        """Deletes directories of runs that none of the snapshots needs (the one in force, and the one before it, which may still be read)."""
        keep: set[str] = set()
        for c in commits:
            keep |= {d.split("/")[0] for t in ("parsed_events", "clean_events") for ds in c["tables"][t].values() for d in ds} | {*c["tables"]["unparsed"], *c["tables"]["manifest"], *c["models"].values()}
        data = os.path.join(self.root, "data")
        for t in os.listdir(data) if os.path.isdir(data) else []:
            for d in os.listdir(os.path.join(data, t)):
                if d.startswith("run=") and d not in keep:
                    shutil.rmtree(os.path.join(data, t, d), ignore_errors=True)


def _write_json(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w") as f:
        json.dump(value, f, indent=1, default=lambda x: x.isoformat())
    os.replace(path + ".tmp", path)


def plan(spark: SparkSession, files: list[Upload], known: dict[str, tuple], reprocess: bool) -> tuple[list[Upload], list[Upload], list[str]]:
    """(files to process, files only touched, paths among the first that were ingested before). Equal size and time: unchanged; else the content decides."""
    todo = [f for f in files if reprocess or known.get(f.path, (None, None))[:2] != (f.size, f.mtime_ms)]
    unsure = [] if reprocess else [f for f in todo if f.path in known]
    same = {r.path for r in read_uploads(spark, unsure).select("path", "sha256").collect() if r.sha256 == known[r.path][2]} if unsure else set()  # only files touched since
    touched = [f for f in unsure if f.path in same]
    todo = [f for f in todo if f.path not in same]
    return todo, touched, [f.path for f in todo if f.path in known]


def run_pipeline(spark: SparkSession, root: str, parser_version: int = 1, reprocess: bool = False, batch_files: int | None = None) -> dict:
    """Ingests new and changed landing files of `root`, parsing `batch_files` at a time (None: all); returns the quality report. Raises ValueError where going on would be unsafe."""
    if parser_version not in (1, 2) or (batch_files is not None and batch_files < 1):
        raise ValueError("parser_version must be 1 or 2, batch_files positive")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError("the session's time zone must be UTC")
    began = time.perf_counter()
    store = Store(spark, root)
    old = store.commit()
    known = store.known(old)
    if {m[3] for m in known.values()} - {parser_version} and not reprocess:
        raise ValueError("these files were parsed by another parser version; reprocess them, versions can't be mixed")
    files = discover(os.path.join(store.root, "landing"))
    if not files:
        raise ValueError("there are no landing files to ingest")
    if missing := set(known) - {f.path for f in files}:
        raise ValueError(f"raw files that were ingested are missing ({len(missing)}); bring them back first")
    todo, touched, changed = plan(spark, files, known, reprocess)
    dirty, run = old["dirty"], uuid.uuid4().hex
    new = json.loads(json.dumps(EMPTY if reprocess else old))
    days: set[str] = set()
    devices = None
    if touched:
        _touch(store, new, run, touched)
    if todo:
        days, devices = _ingest(store, new, run, todo, changed if not reprocess else [], parser_version, batch_files or len(todo))
        new["dirty"] = True
    if todo or touched:
        store.publish(new)
    if todo or dirty:
        new = _model(store, new, run, None if dirty or reprocess else devices)
        store.publish(new)
        store.sweep(new, old)
    out = _report(store, new)
    out["run"] = {
        "files_processed": len(todo), "files_changed": len(changed), "files_total": len(files), "parser_version": parser_version, "reprocess": reprocess, "recovered_exports": dirty,
        "clean_partitions_touched": len(days), "no_op": not todo and not dirty, "seconds": round(time.perf_counter() - began, 3),
    }
    _write_json(os.path.join(store.root, "quality.json"), out)
    return out


def _touch(store: Store, new: dict, run: str, touched: list[Upload]) -> None:
    """Notes new times of files whose content is known."""
    times = store.spark.createDataFrame([(f.path, f.mtime_ms) for f in touched], "path string, _ms long")
    rows = store.plain("manifest", new).join(times, "path", "left").withColumn("mtime_ms", F.coalesce("_ms", "mtime_ms")).drop("_ms")
    new["tables"]["manifest"] = [store.write_plain(rows, "manifest", run + "-touched")]


def _ingest(store: Store, new: dict, run: str, todo: list[Upload], changed: list[str], version: int, batch_files: int) -> tuple[set[str], DataFrame | None]:
    """Parses files, withdraws what changed files said before, decides affected messages again. Fills the commit; returns the clean dates touched and, unless all
    is new, the devices concerned."""
    spark, tables = store.spark, new["tables"]
    first = not tables["manifest"]
    width = lambda files: -(-sum(f.size for f in files) // FILE_BYTES)
    affected = []
    if changed:  # rewrite the dates that hold rows of changed files, and keep the keys they take back
        gone = spark.createDataFrame([(p,) for p in changed], "path string")
        hit = cut(store.partitions("parsed_events", new).join(gone, "path", "left_semi").select("dedupe_key", "device_id", F.col("event_date").cast("string").alias("day")))
        affected.append(hit.select("dedupe_key", "device_id"))
        stale = {r.day for r in hit.select("day").distinct().collect()}
        if stale:
            kept = store.partitions("parsed_events", new, stale).join(gone, "path", "left_anti")
            tables["parsed_events"] = {d: v for d, v in tables["parsed_events"].items() if d not in stale} | store.write_dated(kept, "parsed_events", run + "-kept", width(todo))
        for t in ("unparsed", "manifest"):
            tables[t] = [store.write_plain(store.plain(t, new).join(gone, "path", "left_anti"), t, run + "-kept")]
    fresh: dict[str, list[str]] = {}
    for k in range(0, len(todo), batch_files):
        some = todo[k : k + batch_files]
        name = f"{run}-{k}"
        rows = parse.judged(parse.extract(decode(read_uploads(spark, some)), version), version)
        dirs = store.write_dated(rows, "parsed_events", name, width(some))
        base = os.path.join(store.root, "data", "parsed_events")
        shape = parse.EVENT_SCHEMA.replace("event_date date", "event_date string") + ", reason string, line string, size bigint, sha256 string, mtime_ms bigint"
        lines = spark.read.schema(shape).parquet(os.path.join(base, f"run={name}"))
        # what the manifest says of a file lies beside the lines that were read from it; files without lines are known by the listing
        listed = spark.createDataFrame([(f.path, f.size, f.mtime_ms) for f in some], "path string, _size long, _ms long")
        read = lines.groupBy("path").agg(*[F.first(c).alias(c) for c in OF_FILE], F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("parsed"))
        counted = listed.join(read, "path", "left").select(
            "path", F.coalesce("size", "_size").alias("size"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"), F.coalesce("mtime_ms", "_ms").alias("mtime_ms"), F.lit(version).cast("int").alias("parser_version"),
            F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("parsed", F.lit(0)).alias("parsed"),
        )
        done = quality.side_by_side({"unparsed": lambda lines=lines, name=name: store.write_plain(parse.quarantine(lines, version), "unparsed", name), "manifest": lambda c=counted, name=name: store.write_plain(c, "manifest", name)})
        for t in ("unparsed", "manifest"):
            tables[t].append(done[t])
        dirs.pop(REJECTED, None)
        for day, ds in dirs.items():
            fresh.setdefault(day, []).extend(ds)
            tables["parsed_events"].setdefault(day, []).extend(ds)
    events = store.partitions("parsed_events", new)
    if first:
        made = store.write_dated(models.clean(events), "clean_events", run, width(todo))
        tables["clean_events"] = made
        return set(made), None
    affected.append(store.partitions("parsed_events", {"tables": {"parsed_events": fresh}}).select("dedupe_key", "device_id"))
    keys = cut((affected[0] if len(affected) == 1 else affected[0].unionByName(affected[1])).distinct())
    only = keys.select("dedupe_key").distinct()
    replaced = cut(models.clean(events.join(only, "dedupe_key", "left_semi")))
    outdated = store.partitions("clean_events", new).join(only, "dedupe_key", "left_semi").select("event_date")
    days = {str(r.event_date) for r in outdated.unionByName(replaced.select("event_date")).distinct().collect()}  # dates touched
    kept = store.partitions("clean_events", new, days).join(only, "dedupe_key", "left_anti")
    tables["clean_events"] = {d: v for d, v in tables["clean_events"].items() if d not in days} | store.write_dated(kept.unionByName(replaced), "clean_events", run, width(todo))
    return days, keys.select("device_id").distinct()


def _model(store: Store, commit: dict, run: str, devices: DataFrame | None) -> dict:
    """Models of all devices, or of `devices` only, the others as they were."""
    clean = store.partitions("clean_events", commit)
    concerned = clean if devices is None else clean.join(devices, "device_id", "left_semi")
    built = {"fact_print_job": models.job_fact(concerned), "agg_status_hourly": models.status_hourly(concerned), "dim_printer": models.device_dim(concerned)}
    if devices is not None:
        built = {n: store.spark.read.parquet(os.path.join(store.root, "data", n, commit["models"][n])).join(devices, "device_id", "left_anti").unionByName(df) for n, df in built.items()}
    work = {name: (lambda name=name, df=df: store.write_plain(df, name, run + "-" + uuid.uuid4().hex[:8])) for name, df in built.items()}
    return {**commit, "models": quality.side_by_side(work), "dirty": False}


def _report(store: Store, commit: dict) -> dict:
    """The quality report of a snapshot; made once for each and kept beside it."""
    kept = os.path.join(store.root, "state", "report.json")
    of = hashlib.sha256(json.dumps([commit["tables"], commit["models"]], sort_keys=True).encode()).hexdigest()
    out = None
    if os.path.exists(kept):
        with open(kept) as f:
            old = json.load(f)
        out = old["report"] if old["of"] == of else None
    if out is None:
        tables = {"parsed_events": store.partitions("parsed_events", commit), "clean_events": store.partitions("clean_events", commit), "unparsed": store.plain("unparsed", commit)}
        tables |= {m: store.spark.read.parquet(os.path.join(store.root, "data", m, commit["models"][m])) for m in MODELS}
        out = quality.report(tables, store.plain("manifest", commit))
        _write_json(kept, {"of": of, "report": out})
    size = lambda d: sum(os.path.getsize(os.path.join(t, n)) for t, _, ns in os.walk(d) for n in ns)
    out["bytes"] = {"landing": size(os.path.join(store.root, "landing"))} | {t: size(os.path.join(store.root, "data", t)) for t in (*SCHEMAS, *MODELS)}
    return out
