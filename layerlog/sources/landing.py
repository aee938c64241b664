"""The landing zone: raw upload files under received_date=<day>/source=<source>/, read as uploads and as numbered lines."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".jsonl")


@dataclass(frozen=True)
class Upload:
    path: str
    size: int
    mtime_ms: int


def discover(landing: str) -> list[Upload]:
    """Metadata of all upload files, in order of path. Nothing is read."""
    out = []
    for top, _, names in os.walk(landing):
        parts = top.split(os.sep)
        if len(parts) < 2 or not parts[-1].startswith("source=") or not parts[-2].startswith("received_date="):
            continue
        for n in names:
            p = os.path.join(top, n)
            if n.endswith(SUFFIXES) and os.path.isfile(p):
                st = os.stat(p)
                out.append(Upload(p, st.st_size, st.st_mtime_ns // 1_000_000))
    return sorted(out, key=lambda u: u.path)


def read_uploads(spark: SparkSession, files: list[Upload]) -> DataFrame:
    """(path, content, source, received_at, header, size, sha256, mtime_ms), one row a file; source and receipt are taken from the path, size and hash from the content
    that was read, so that what is appended later is seen as a change. Empty files have no row."""
    named = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    folders = sorted({os.path.dirname(f.path) for f in files})
    raw = spark.read.text(folders, wholetext=True, pathGlobFilter="*.{txt,jsonl}").withColumns({"path": named, "mtime_ms": F.unix_millis("_metadata.file_modification_time")})
    there = sum(e.name.endswith(SUFFIXES) for f in folders for e in os.scandir(f))
    if there > len(files):  # other files lie in the same folders
        raw = raw.join(spark.createDataFrame([(f.path,) for f in files], "path string"), "path", "left_semi")
    seconds = F.regexp_extract("path", "__([0-9]+)", 1).try_cast("double")
    body = F.col("value")
    return raw.select(
        "path", body.alias("content"), F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), seconds.try_cast("timestamp").alias("received_at"), F.substring_index(body, "\n", 1).alias("header"),
        F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"), "mtime_ms",
    )


OF_FILE = ("size", "sha256", "mtime_ms")  #: what lines know of the content they were read from


def decode(uploads: DataFrame) -> DataFrame:
    """(path, source, received_at, header, line_number, line) of every line that isn't blank or an upload header; lines count from 1, blank ones included. Columns OF_FILE come along."""
    head = ["path", "source", "received_at", "header", *[c for c in OF_FILE if c in uploads.columns]]
    each = uploads.select(*head, F.posexplode(F.split("content", "\n")).alias("_pos", "_line"))
    lines = each.select(*head, (F.col("_pos") + 1).cast("long").alias("line_number"), F.trim("_line").alias("line"))
    return lines.where((F.col("line") != "") & ~((F.col("source") == "genA") & F.col("line").startswith("#UPLOAD")))
