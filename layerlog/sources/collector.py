"""Snapshots of live printers over HTTP, read only: GET of a few allowed paths, digest authentication, no redirects. Records are appended to hourly files of the
landing zone, from which they are ingested like any upload (source prusalink)."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from ..operators.records import without_identity

UTC = dt.timezone.utc
# What may be asked for.
ALLOWED = ("/api/version", "/api/v1/info", "/api/v1/status", "/api/v1/job")
MOST_FAILURES, LONGEST_WAIT = 5, 60.0


class CollectorError(RuntimeError):
    """What went wrong, without host, user or secret in its text."""


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a):
        return None  # an answer elsewhere is no answer of this printer


def http_reader(host: str, user: str, secret: str, timeout: float = 10.0) -> Callable[[str], tuple[int, bytes]]:
    """A function from path to (status, body). `host` is a bare http(s) host."""
    url = urllib.parse.urlsplit(host if "://" in host else f"http://{host}")
    if url.scheme not in ("http", "https") or not url.hostname or "@" in url.netloc or url.path.strip("/") or url.query or url.fragment:
        raise CollectorError("the printer's address must be a bare http(s) host")
    base = f"{url.scheme}://{url.netloc}"
    keys = urllib.request.HTTPPasswordMgrWithDefaultRealm()
    keys.add_password(None, base, user, secret)
    web = urllib.request.build_opener(_Stay, urllib.request.HTTPDigestAuthHandler(keys))

    def read(path: str) -> tuple[int, bytes]:
        try:
            with web.open(urllib.request.Request(base + path, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, b""
        except OSError:
            raise CollectorError("the printer did not answer") from None

    return read


class Printer:
    """A printer behind a reader (:func:`http_reader`, or any function of that kind)."""

    def __init__(self, read: Callable[[str], tuple[int, bytes]]):
        self.read = read

    def get(self, path: str) -> tuple[int, dict | None]:
        """(status, object) of an allowed path; 204 has no object."""
        if path not in ALLOWED:
            raise CollectorError("that path is not allowed")
        status, body = self.read(path)
        if status == 204:
            return status, None
        if not 200 <= status < 300:
            raise CollectorError(f"the printer answered with status {status}")
        try:
            found = json.loads(body)
        except ValueError:
            found = None
        if not isinstance(found, dict):
            raise CollectorError("the printer's answer is no JSON object")
        return status, found

    def device(self) -> dict:
        """Who it is; the serial is only kept as a digest."""
        version, info = (self.get(p)[1] or {} for p in ALLOWED[:2])
        serial = info.get("serial")
        if not (isinstance(serial, str) and serial.strip()):
            raise CollectorError("the printer names no serial")
        return {
            "id": f"prusa-{hashlib.sha256(serial.encode()).hexdigest()[:24]}", "model": "Prusa Core One", "fw": version.get("firmware", "unknown"), "api_version": version.get("api"), "prusalink_version": version.get("server"),
            "nozzle_diameter": info.get("nozzle_diameter"),
        }

    def snapshot(self, device: dict, now: Callable[[], dt.datetime]) -> dict:
        """One record, free of identity fields."""
        asked = now()
        (status, state), (job_status, job) = self.get(ALLOWED[2]), self.get(ALLOWED[3])
        if status != 200 or not isinstance((state or {}).get("printer"), dict):
            raise CollectorError("the printer gave no state")
        return {"source": "prusalink", "received_at": now().isoformat(), "request_started_at": asked.isoformat(), "timestamp_quality": "received_only", "device": device, "status": without_identity(state), "job_http_status": job_status, "job": without_identity(job)}


def append(landing: str, record: dict) -> str:
    """Adds a record to its device's file of the hour; the file."""
    at = dt.datetime.fromisoformat(record["received_at"])
    folder = os.path.join(landing, f"received_date={at.date()}", "source=prusalink")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{record['device']['id']}__{int(at.timestamp()) // 3600 * 3600}.jsonl")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, separators=(",", ":")) + "\n")
    return path


def collect(printer: Printer, landing: str, samples: int, interval: float = 5.0, now=lambda: dt.datetime.now(UTC), sleep=time.sleep) -> int:
    """Takes `samples` snapshots (0: until interrupted), `interval` seconds apart; the number taken. After failures in a row the wait doubles up to a minute; the fifth ends it."""
    if interval < 1 or samples < 0:
        raise ValueError("interval must be at least 1, samples not negative")
    device, taken, failed = printer.device(), 0, 0
    while samples == 0 or taken < samples:
        began = time.monotonic()
        try:
            append(landing, printer.snapshot(device, now))
            taken, failed = taken + 1, 0
        except CollectorError:
            failed += 1
            if failed == MOST_FAILURES:
                raise
        if samples == 0 or taken < samples:
            wait = max(interval, min(LONGEST_WAIT, 2.0**failed)) if failed else interval
            sleep(max(0.0, wait - (time.monotonic() - began)))
    return taken
