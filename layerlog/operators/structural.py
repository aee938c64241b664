"""Rows that fail to parse: structural indexing of lines, then checks that accept a line or give the first reason that applies.

A batch of lines becomes one byte buffer.  Masks of quotes (escaped ones taken out by the parity of the backslashes before them) and their
prefix parity tell inside from outside of quotes for all lines at once; delimiters outside of quotes are the ends of fields (text lines) or the
brackets whose running depth must close exactly at the record's end (JSON lines).  Only lines whose structure holds are read in full.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UTC = dt.timezone.utc
# Fixed values of the line formats.
SOURCES = ("genA", "genB", "genC", "prusalink")
KINDS = ("status", "job_start", "job_end", "error", "maintenance")
SHAPES = {
    "status": ("bed", "nozzle", "tgt_bed", "tgt_nozzle", "fan", "job"),
    "job_start": ("id", "material", "layers"),
    "job_end": ("id", "result"),
    "error": ("code", "job"),
}
FUTURE = dt.timedelta(minutes=5)
LIMITS = {"bed": (-50.0, 200.0), "nozzle": (-50.0, 500.0)}

_NUMBER = re.compile(r"\s*[+-]?(?:\d+(?:_\d+)*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*\Z|\s*[+-]?(?:nan|inf|infinity)\s*\Z", re.I)
_TIME = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?)?\s*(Z|UTC|[+-]\d{2}(?::?\d{2})?)?\Z")
_ZONED = re.compile(r"(Z|[+-][0-9]{2}:[0-9]{2})\Z")


class Structure:
    """Index of a batch of lines: line i is bytes start[i]:end[i] of `buf`."""

    def __init__(self, lines: list[str], escapes: np.ndarray):
        """escapes: which lines know backslash escapes (JSON)."""
        parts = [x.encode("utf-8", "surrogatepass") for x in lines]
        self.buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.fromiter((len(x) for x in parts), dtype=np.int64, count=len(parts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        line = np.repeat(np.arange(len(parts)), size)
        quote = self.buf == 34
        back = (self.buf == 92) & (escapes[line] if len(line) else False)
        if back.any():  # a quote after an odd run of backslashes is text
            pos = np.arange(len(self.buf))
            last = np.maximum.accumulate(np.where(back, -1, pos))
            run = np.minimum(pos - 1 - np.r_[-1, last[:-1]], pos - self.start[line]) if len(pos) else pos
            quote &= run % 2 == 0
        total = np.cumsum(quote)
        before = np.r_[0, total][self.start]  # quotes before each line
        self.quotes = np.r_[0, total][self.end] - before
        self.inside = ((total - quote - np.repeat(before, size)) % 2 == 1) | quote
        step = np.where(self.inside, 0, ((self.buf == 123) | (self.buf == 91)).astype(np.int8) - ((self.buf == 125) | (self.buf == 93)).astype(np.int8))
        depth = np.cumsum(step)
        base = np.r_[0, depth][self.start]
        self.depth_end = np.r_[0, depth][self.end] - base
        rel = depth - np.repeat(base, size)
        low = np.zeros(len(parts), dtype=np.int64)
        if len(rel):
            full = size > 0
            low[full] = np.minimum.reduceat(rel, self.start[full])
        self.depth_low = low
        self.parts = parts
        self._space = np.flatnonzero((self.buf == 32) & ~self.inside)
        self._at = np.searchsorted(self._space, self.start), np.searchsorted(self._space, self.end)

    def whole_object(self, i: int) -> bool:
        """Could line i be one JSON object? Brackets and quotes close, and nothing stands outside."""
        p = self.parts[i].strip(b" \t\r\n")
        return p[:1] == b"{" and p[-1:] == b"}" and self.depth_end[i] == 0 and self.depth_low[i] >= 0 and self.quotes[i] % 2 == 0

    def fields(self, i: int) -> list[str]:
        """Fields of line i between runs of blanks outside of quotes."""
        a, b = self._at[0][i], self._at[1][i]
        cuts = [*(self._space[a:b] - self.start[i]), len(self.parts[i])]
        out, at = [], 0
        for c in cuts:
            if c > at:
                out.append(self.parts[i][at:c].decode("utf-8", "replace"))
            at = c + 1
        return out


def number(x) -> float | None:
    """A number, or a number as text; None for anything else. Booleans are no numbers."""
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, str) and _NUMBER.match(x):
        return float(x.replace("_", ""))
    return None


def instant(text, zoned: bool) -> dt.datetime | None:
    """A written time; `zoned`: it must carry Z or ±hh:mm. Without a zone it is UTC."""
    if not isinstance(text, str) or (zoned and not _ZONED.search(text)):
        return None
    m = _TIME.match(text.strip())
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        at = dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0")[:6].ljust(6, "0")), UTC)
        if zone and zone not in ("Z", "UTC"):
            off = dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:] if len(zone) > 3 else 0))
            at -= off if zone[0] == "+" else -off
    except (ValueError, OverflowError):
        return None
    return at


def epoch_ms(x) -> dt.datetime | None:
    v = number(x)
    if v is None or not math.isfinite(v):
        return None
    try:
        return dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(milliseconds=v)
    except OverflowError:
        return None


def _first(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def _reject_constant(x):
    raise ValueError(x)


_DECODER = json.JSONDecoder(object_pairs_hook=_first, parse_constant=_reject_constant)


def read_object(text: str) -> dict | None:
    """One strictly valid JSON object, the first of repeated keys counting; None otherwise."""
    try:
        out = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def dig(obj, *path):
    for p in path:
        obj = obj.get(p) if isinstance(obj, dict) else None
    return obj


def as_text(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _text_line(s: Structure, i: int, line: str) -> dict:
    """Fields of a genA line, `shape` true if it has exactly those of its kind, in order."""
    f = s.fields(i)
    head = line[19:]
    kind = next((k for label, k in ((" THERM ", "status"), (" IDLE ", "status"), (" JOB start ", "job_start"), (" JOB end ", "job_end"), (" ERR ", "error")) if head.startswith(label)), None)
    own = f[4 if kind in ("job_start", "job_end") else 3:]
    pairs = [x.partition("=") for x in own]
    values: dict = {}
    for k, eq, v in pairs:
        if eq:
            values.setdefault(k, v)
    job = values.get("id") or (values.get("job") if values.get("job") != "-" else None)
    state = {" THERM ": "PRINTING"}.get(head[:7], "IDLE") if kind == "status" else None
    return {
        "kind": kind, "raw": line[:19], "event": instant(line[:19], False), "job_id": job or None, "state": state, "material": (values.get("material") or "").strip('"') or None,
        "layers": number(values.get("layers")), "bed": number(values.get("bed")), "nozzle": number(values.get("nozzle")), "t_bed": number(values.get("tgt_bed")), "t_nozzle": number(values.get("tgt_nozzle")),
        "chamber": None, "unit": "C", "outcome": {"ok": "success", "fail": "failure"}.get(values.get("result"), "unknown"), "error_code": values.get("code"),
        "shape": kind is None or (all(eq for _, eq, _ in pairs) and tuple(k for k, _, _ in pairs) == SHAPES[kind]), "quotes": s.quotes[i] % 2 == 0,
    }


def _json_line(source: str, j: dict) -> dict:
    if source == "genB":
        pick = lambda a, b: dig(j, a) if dig(j, a) is not None else dig(j, b)
        return {
            "device": as_text(dig(j, "dev")), "firmware": as_text(dig(j, "fw")), "model": as_text(dig(j, "model")), "kind": as_text(dig(j, "k")), "raw": as_text(dig(j, "t")), "event": epoch_ms(dig(j, "t")), "job_id": as_text(dig(j, "job")),
            "state": as_text(dig(j, "state")), "material": as_text(dig(j, "material")), "layers": number(dig(j, "layers")), "bed": number(pick("bed_temp", "temp_bed")), "nozzle": number(pick("nozzle_temp", "temp_nozzle")),
            "t_bed": number(dig(j, "target_bed")), "t_nozzle": number(dig(j, "target_nozzle")), "chamber": number(dig(j, "temps", "chamber_c")), "unit": "C" if dig(j, "temp_unit") is None else as_text(dig(j, "temp_unit")),
            "outcome": {True: "success", False: "failure", "true": "success", "false": "failure"}.get(dig(j, "ok") if isinstance(dig(j, "ok"), (bool, str)) else None, "unknown"), "error_code": as_text(dig(j, "code")),
        }
    snap = source == "prusalink"
    at = ("status", "printer") if snap else ()
    temp = ("temp_bed", "temp_nozzle") if snap else ("bed_c", "nozzle_c")
    job = dig(j, "job", "id")
    raw = as_text(dig(j, "received_at" if snap else "ts"))
    return {
        "device": as_text(dig(j, "device", "id")), "firmware": as_text(dig(j, "device", "fw")), "model": as_text(dig(j, "device", "model")), "kind": "status" if snap else as_text(dig(j, "type")), "raw": raw, "event": instant(raw, True),
        "job_id": as_text(job if job is not None else dig(j, "job", "job", "id")), "state": as_text(dig(j, *at, "state")), "material": as_text(dig(j, "job", "material")), "layers": number(dig(j, "job", "layers")),
        "bed": number(dig(j, *(at or ("temps",)), temp[0])), "nozzle": number(dig(j, *(at or ("temps",)), temp[1])), "chamber": number(dig(j, "temps", "chamber_c")),
        "t_bed": number(dig(j, *at, "target_bed") if snap else dig(j, "targets", "bed_c")), "t_nozzle": number(dig(j, *at, "target_nozzle") if snap else dig(j, "targets", "nozzle_c")),
        "unit": "C", "outcome": dig(j, "outcome") if dig(j, "outcome") in ("success", "failure") else "unknown", "error_code": as_text(dig(j, "error", "code")), "received": instant(raw, False) if snap else None,
    }


def _celsius(x: float, unit: str) -> float:
    return (x - 32) / 1.8 if unit == "F" else x


def judge(source: str, f: dict | None, device: str | None, received: dt.datetime | None, version: int) -> str | None:
    """The first reason that applies, or None."""
    if source not in SOURCES:
        return "unsupported_source"
    if f is None:
        return "invalid_json"
    if not device:
        return "missing_device"
    if received is None:
        return "invalid_received_time"
    if f["event"] is None:
        return "invalid_device_time"
    if source != "genA" and f["event"] > received + FUTURE:  # a genA time needs its upload's header
        return "future_event_time"
    kind = f["kind"]
    if kind not in KINDS or (kind == "maintenance" and version < 2):
        return "unsupported_kind"
    if source == "genA" and not f["quotes"]:
        return "broken_quoting"
    if source == "genA" and not f["shape"]:
        return "wrong_field_count"
    if kind in ("job_start", "job_end") and not f["job_id"]:
        return "missing_job_id"
    if kind == "status":
        if f["bed"] is None or f["nozzle"] is None:
            return "missing_temperature"
        if f["unit"] not in ("C", "F"):
            return "unsupported_temperature_unit"
        for what in ("bed", "nozzle"):
            lo, hi = LIMITS[what]
            if not math.isfinite(f[what]) or not lo <= _celsius(f[what], f["unit"]) <= hi:
                return "invalid_temperature"
    return None


_COLUMNS = "device_id_read string, firmware_read string, model string, kind string, device_ts_raw string, received_read timestamp, event_read timestamp, job_id string, state string, material string, layers int, bed_temp double, nozzle_temp double, chamber_temp double, target_bed_temp double, target_nozzle_temp double, temp_unit string, outcome string, error_code string, verdict string"


def load_lines(lines: DataFrame, version: int = 2) -> DataFrame:
    """Every row of `lines` (path, line_number, source, received_at, line, device_id) with the fields read from the line and ``verdict``: null if the
    line loads under parser `version`, else its first reason.

    genA headers are taken as sound: device_id is the header's, and the event time is left to the clock offset (event_read is the written time).
    Nulls: a null line is invalid_json (genA: invalid_device_time), a null source is unsupported_source. Empty and very long lines are read whole. Repeated
    rows stay. Extra columns are not carried.
    """
    keys = ["path", "line_number", "source", "received_at", "line", "device_id"]
    names = [x.split()[0] for x in _COLUMNS.split(", ")]

    def run(batches):
        for pdf in batches:
            source = [x if isinstance(x, str) else None for x in pdf["source"]]
            line = [x.strip(" ") if isinstance(x, str) else "" for x in pdf["line"]]
            s = Structure(line, np.array([x != "genA" for x in source], dtype=bool))
            received = [None if pd.isna(x) else x.to_pydatetime().replace(tzinfo=UTC) for x in pdf["received_at"]]
            rows = []
            for i, src in enumerate(source):
                f = None
                if src == "genA":
                    f = _text_line(s, i, line[i])
                    device = pdf["device_id"].iat[i]
                    device = device if isinstance(device, str) else None
                elif src in SOURCES:
                    j = read_object(line[i]) if s.whole_object(i) else None
                    f = None if j is None else _json_line(src, j)
                    device = f and f["device"]
                else:
                    device = None
                got = f.get("received") if f and src == "prusalink" else received[i]
                why = judge(src, f, device, got, version)
                f = f or {}
                stamp = lambda t: None if t is None else t.replace(tzinfo=None)
                status = f.get("kind") == "status"
                layers = f.get("layers")
                rows.append((device, f.get("firmware"), f.get("model"), f.get("kind"), f.get("raw"), stamp(got), stamp(f.get("event")), f.get("job_id"), f.get("state") if status else None, f.get("material"),
                    int(round(layers)) if layers is not None and abs(layers) < 2**31 - 1 else None, f.get("bed"), f.get("nozzle"), f.get("chamber"), f.get("t_bed"), f.get("t_nozzle"), f.get("unit"),
                    f.get("outcome") if f.get("kind") == "job_end" else None, f.get("error_code"), why))
            out = pd.DataFrame(rows, columns=names, dtype=object)
            for k in ("received_read", "event_read"):
                out[k] = pd.to_datetime(out[k], errors="coerce")
            yield pd.concat([pdf[["path", "line_number", "source"]].reset_index(drop=True), out], axis=1)

    return lines.select(*keys).mapInPandas(run, "path string, line_number long, source string, " + _COLUMNS)


def rejects(unparsed: DataFrame, version: int = 2) -> DataFrame:
    """(path, line_number, reason) of waiting lines (reason null) that don't load."""
    return load_lines(unparsed.where("reason is null"), version).where("verdict is not null").select("path", "line_number", "verdict").withColumnRenamed("verdict", "reason")
