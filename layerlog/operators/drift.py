"""Schemas that drift between files: profiles of fields, matching of versions, one consistent table.

Every file is profiled by field (dotted path): types seen, range of numbers, and a k-minimum-values sketch of the distinct values, which for numbers are the
values themselves, a sample of their distribution.  A file is compared with the one before it of the same device; fields that vanished and fields that
appeared are the two sides of a bipartite graph whose edges weigh name similarity and similarity of value sketches.  The best assignment gives the
renames, the rest are removals and additions.

Records are read once: a batch becomes one packed profile for each file in it, profiles meet by file, and one row a file is stored.  Files are put in
order without their profiles; those of files that differ from the one before are joined back.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import stored

KMV = 24  #: values in a sketch
NAME_WEIGHT, VALUE_WEIGHT, NUMBER_VALUE = 0.6, 0.4, 0.3
ACCEPT = 0.39  #: least weight of a rename
WIDE = 1_000  #: typed columns of the unified table; less frequent fields stand in its map
_UNITS = {"c", "f", "k", "degc", "degf", "celsius", "ms", "s", "us"}


# --- profiles ------------------------------------------------------------------------------------------------------------------------------


def flatten(obj, prefix: str = "", names=None, values=None) -> tuple[list, list]:
    """(dotted paths, values) of the leaves; lists are leaves, empty objects too."""
    if names is None:
        names, values = [], []
    for k, v in obj.items():
        if type(v) is dict and v:
            flatten(v, f"{prefix}{k}.", names, values)
        else:
            names.append(prefix + k)
            values.append(v)
    return names, values


_KINDS = {bool: "b", int: "n", float: "n", str: "s", type(None): ""}


def kind_of(v) -> str:
    """'n' number, 's' string, 'b' boolean, 'o' list or empty object, '' null."""
    return _KINDS.get(type(v), "o")


def _number(v):
    if isinstance(v, bool) or v is None:
        return None
    try:
        x = float(v) if isinstance(v, (int, float, str)) else None
    except (ValueError, OverflowError):
        return None
    return x if x is not None and math.isfinite(x) else None


def _floats(values: set) -> set:
    """The finite ones of some numbers."""
    try:
        out = set(map(float, values))
    except OverflowError:
        return {x for x in map(_number, values) if x is not None}
    return out if math.isfinite(sum(out)) else {x for x in out if math.isfinite(x)}


class _Texts(dict):
    """What a string is: (number or None, hash). Strings come again and again."""

    def __missing__(self, text):
        if len(self) > 200_000:
            self.clear()
        out = self[text] = (_number(text), int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big"))
        return out


_TEXTS = _Texts()


def _sample(numbers: set) -> tuple:
    """At most KMV of the numbers, by the least hashes of their bits (splitmix64), in order of size."""
    if len(numbers) <= KMV:
        return tuple(sorted(numbers))
    x = np.sort(np.fromiter(numbers, np.float64, len(numbers)))
    z = (x + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return tuple(x[np.sort(np.argsort(z ^ (z >> np.uint64(31)), kind="stable")[:KMV])].tolist())


class Profile(NamedTuple):
    """What is known of a field: kinds, whether a string is no number, range and sample of its numbers (also those written as text), sketch of its other values."""

    code: str = ""
    words: bool = False
    lo: float = math.inf
    hi: float = -math.inf
    numbers: tuple = ()
    texts: tuple = ()

    @classmethod
    def of(cls, values) -> "Profile":
        """Of the values of a field in some records."""
        kinds = {_KINDS.get(t, "o") for t in set(map(type, values))} - {""}
        if kinds <= {"n"}:
            numbers, texts = _floats(set(values) - {None}), set()
        else:
            each = set(values) if "o" not in kinds else {v if kind_of(v) != "o" else json.dumps(v, sort_keys=True) for v in values}
            numbers, texts = set(), set()
            for v in each:
                if v is None:
                    continue
                x, h = _TEXTS[v] if isinstance(v, str) else (None, _TEXTS[repr(v)][1]) if isinstance(v, bool) else (_number(v), None)
                if x is not None:
                    numbers.add(x)
                elif h is not None:
                    texts.add(h)
        words = "s" in kinds and any(isinstance(v, str) and _TEXTS[v][0] is None for v in each)
        return cls("".join(sorted(kinds)), words, min(numbers, default=math.inf), max(numbers, default=-math.inf), _sample(numbers), tuple(sorted(texts)[:KMV]))

    def plus(self, o: "Profile") -> "Profile":
        code = self.code if self.code == o.code else "".join(sorted({*self.code, *o.code}))
        return Profile(code, self.words or o.words, min(self.lo, o.lo), max(self.hi, o.hi), _sample({*self.numbers, *o.numbers}), tuple(sorted({*self.texts, *o.texts})[:KMV]))


def _pack(fields: dict[str, Profile]) -> bytes:
    return pickle.dumps({k: tuple(p) for k, p in fields.items()}, 5)


def _unpack(raw: bytes) -> dict[str, Profile]:
    """Of bytes that :func:`_pack` made in this job."""
    return {k: Profile(*p) for k, p in pickle.loads(raw).items()}


def _merge(a: dict[str, Profile], b: dict[str, Profile]) -> dict[str, Profile]:
    for k, p in b.items():
        a[k] = a[k].plus(p) if k in a else p
    return a


def _parse(payload):
    try:
        j = json.loads(payload) if isinstance(payload, str) else None
    except (ValueError, RecursionError):
        return None
    return j if isinstance(j, dict) else None


def _file(key: tuple, at, n: int, fields: dict[str, Profile]) -> tuple:
    names = sorted(fields)
    return (*key, at, n, "\x02".join(names), "\x02".join(f"{k}\x01{fields[k].code}" for k in names), _pack(fields))


_FILE = ["path", "source", "received", "records", "fields", "layout", "blob"]
_SHAPE = "path string, source string, received long, records long, fields string, layout string, blob binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FILE).astype({"received": "Int64"})


def _columns(pdf: pd.DataFrame, *names: str):
    return zip(*[pdf[c].astype("Int64").to_numpy(dtype=object, na_value=None) if c == "received" else pdf[c] for c in names])


def _read(batches):
    """A row for each file in a batch. Records of one layout are turned into columns."""
    for pdf in batches:
        layouts: dict = {}
        newest: dict = {}
        for path, source, at, payload in _columns(pdf, "path", "source", "received", "payload"):
            key = (path, source)
            newest[key] = max((x for x in (newest.get(key), at) if x is not None), default=None)
            j = _parse(payload)
            if j:
                names, values = flatten(j)
                layouts.setdefault(key, {}).setdefault(tuple(names), []).append(values)
        rows = []
        for key, by in layouts.items():
            fields: dict = {}
            for names, records in by.items():
                own = {n: Profile.of(c) for n, c in zip(names, zip(*records))}
                fields = _merge(fields, own) if fields else own
            rows.append(_file(key, newest[key], sum(map(len, by.values())), fields))
        yield _frame(rows)


def _together(batches):
    """One row a file from rows sorted by file. Most files lie in one batch and pass as they are."""
    held: tuple | None = None
    for pdf in batches:
        rows = []
        for row in _columns(pdf, *_FILE):
            if held is not None and row[:2] == held[:2]:
                at = max((x for x in (held[2], row[2]) if x is not None), default=None)
                held = _file(row[:2], at, held[3] + row[3], _merge(_unpack(held[6]), _unpack(row[6])))
                continue
            if held is not None:
                rows.append(held)
            held = row
        yield _frame(rows)
    if held is not None:
        yield _frame([held])


def profiles(records: DataFrame) -> DataFrame:
    """(path, source, received, records, fields, layout, blob): one row for each file (path, line's source) with a readable record, stored. `records`: path, source,
    received_at, payload.

    Payloads that aren't JSON objects have no fields; null paths are one file.
    """
    parts = records.select("path", "source", F.unix_micros("received_at").alias("received"), "payload").mapInPandas(_read, _SHAPE)
    met = parts.repartition("path", "source").sortWithinPartitions("path", "source")
    return stored(met.mapInPandas(_together, _SHAPE))


# --- matching ------------------------------------------------------------------------------------------------------------------------------


def _tokens(path: str) -> list[str]:
    raw = [t for t in re.split(r"[._\-]|(?<=[a-z])(?=[A-Z])", path) if t]
    words = [t.lower() for t in raw]
    words = [w for w in words if w not in _UNITS] or words
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words]


def _token_sim(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    it = iter(long_)
    return 0.9 if short[0] == long_[0] and len(short) < len(long_) and all(ch in it for ch in short) else 0.0


def name_similarity(a: str, b: str) -> float:
    """Soft Jaccard of the words of two paths; a word may be the abbreviation of another. Order and units don't count."""
    x, y = list(dict.fromkeys(_tokens(a))), list(dict.fromkeys(_tokens(b)))
    rest, hit = y[:], 0.0
    for t in x:
        best = max(rest, key=lambda u: _token_sim(t, u), default=None)
        if best is not None and _token_sim(t, best) > 0:
            hit += _token_sim(t, best)
            rest.remove(best)
    return hit / (len(x) + len(y) - (len(y) - len(rest)))


def value_similarity(a: Profile, b: Profile) -> float:
    """Of two fields' values. Numbers: overlap of their ranges and of their distributions, as far as the sketches show it. Others: share of common values."""
    x, y = len(a.numbers) > 0, len(b.numbers) > 0
    if not (x or len(a.texts)) or not (y or len(b.texts)):
        return 0.0
    if x and y:
        lo, hi, span = max(a.lo, b.lo), min(a.hi, b.hi), max(a.hi, b.hi) - min(a.lo, b.lo)
        ranges = 1.0 if span == 0 else max(0.0, (hi - lo) / span)
        at = sorted({*a.numbers, *b.numbers})
        share = lambda v: np.searchsorted(v, at, "right") / len(v)
        return NUMBER_VALUE * (0.8 * ranges + 0.2 * (1.0 - float(np.abs(share(a.numbers) - share(b.numbers)).max())))
    if x != y or (a.code == "b") != (b.code == "b"):
        return 0.0
    u, v = set(a.texts), set(b.texts)
    both = sorted(u | v)[:KMV]
    return sum(h in u and h in v for h in both) / len(both)


def similarity(x: str, a: Profile, y: str, b: Profile) -> float:
    """Weight of an edge between two fields; 0 below ACCEPT."""
    w = NAME_WEIGHT * name_similarity(x, y) + VALUE_WEIGHT * value_similarity(a, b)
    return w if w >= ACCEPT else 0.0


def assign(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight assignment, by shortest augmenting paths with potentials; O(n² m)."""
    n, m = len(weight), len(weight[0]) if weight else 0
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*weight)])]
    cost = [[-w for w in row] for row in weight]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        dist, prev, used = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    d = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if d < dist[j]:
                        dist[j], prev[j] = d, j0
                    if dist[j] < delta:
                        delta, j1 = dist[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    dist[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[prev[j0]]
            j0 = prev[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def pairs(old: dict[str, Profile], new: dict[str, Profile]) -> list[tuple[str, str]]:
    """The best matching of two sets of fields."""
    a, b = sorted(old), sorted(new)
    if not a or not b:
        return []
    w = [[similarity(x, old[x], y, new[y]) for y in b] for x in a]
    return [(a[i], b[j]) for i, j in assign(w) if w[i][j] > 0]


def compare(a: dict[str, Profile], b: dict[str, Profile]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) between two versions."""
    gone, came = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    out = [("retyped", k, k) for k in sorted(a.keys() & b.keys()) if a[k].code and b[k].code and a[k].code != b[k].code]
    renamed = pairs({k: a[k] for k in gone}, {k: b[k] for k in came})
    left, right = {x for x, _ in renamed}, {y for _, y in renamed}
    return out + [("renamed", x, y) for x, y in renamed] + [("removed", x, "") for x in gone if x not in left] + [("added", "", y) for y in came if y not in right]


def changes(records: DataFrame, device: str = r"([^/]*?)(?:__[^/]*)?$") -> DataFrame:
    """(path, source, change, old_field, new_field): what each file changed against the one before it of its device (`device`: pattern of the
    device in the path), files ordered by latest receipt, then path.

    The file before is found by day and then between days, so that a device with a third of all files is spread over its days. A device's
    first file reports nothing. Null receipts come first; a file without a readable record has no fields and is passed over.
    """
    return _changes(profiles(records), device)


def _changes(files: DataFrame, device: str = r"([^/]*?)(?:__[^/]*)?$") -> DataFrame:
    at = F.coalesce("received", F.lit(-(1 << 62)))
    slim = files.select("path", "source", F.regexp_extract("path", device, 1).alias("_device"), at.alias("_at"), F.floor(at / 86_400_000_000).alias("_day"), F.unhex(F.md5("layout")).alias("_layout"))
    this = F.struct("_at", "path", "source", "_layout")
    in_day = W.partitionBy("_device", "_day").orderBy("_at", "path", "source")
    days = slim.groupBy("_device", "_day").agg(F.max(this).alias("_last"))
    days = days.withColumn("_before", F.lag("_last").over(W.partitionBy("_device").orderBy("_day"))).drop("_last")  # one row a day
    seq = slim.withColumn("_in", F.lag(this).over(in_day)).join(days, ["_device", "_day"], "left").withColumn("_before", F.coalesce("_in", "_before"))
    moved = seq.where(F.col("_before").isNotNull() & (F.col("_before._layout") != F.col("_layout"))).select("path", "source", F.col("_before.path").alias("_p"), F.col("_before.source").alias("_s"))
    new = files.select(F.col("path").alias("_np"), F.col("source").alias("_ns"), F.col("blob").alias("_new"))
    old = files.select(F.col("path").alias("_op"), F.col("source").alias("_os"), F.col("blob").alias("_old"))
    both = moved.join(new, moved.path.eqNullSafe(new._np) & moved.source.eqNullSafe(new._ns)).join(old, moved._p.eqNullSafe(old._op) & moved._s.eqNullSafe(old._os))

    def run(batches):
        for pdf in batches:
            rows = [(path, source, *c) for path, source, a, b in zip(pdf["path"], pdf["source"], pdf["_old"], pdf["_new"]) for c in compare(_unpack(a), _unpack(b))]
            yield pd.DataFrame(rows, columns=["path", "source", "change", "old_field", "new_field"])

    return both.select("path", "source", "_old", "_new").mapInPandas(run, "path string, source string, change string, old_field string, new_field string")


# --- one table -----------------------------------------------------------------------------------------------------------------------------


def canonical_names(renames: dict, layouts: list, usage: dict) -> dict:
    """{(source, field): name} within each source. renames: {(source, old, new): times reported}, layouts: (source, fields of one layout), usage: {(source, field): records}.

    Renames link fields, the often reported first; a link that would join two fields which stand side by side in some layout is none, so that one wrong
    rename can't run fields together. Linked fields share the name that most records use (ties: the least).
    """
    group: dict = {}
    beside: dict = {}
    for source, fields in layouts:
        for f in fields:
            group.setdefault((source, f), {(source, f)})
            beside.setdefault((source, f), set()).update((source, g) for g in fields if g != f)
    for (source, a, b), _ in sorted(renames.items(), key=lambda x: (-x[1], x[0])):
        x, y = group[source, a], group[source, b]
        if x is not y and not any(beside[f] & y for f in x):
            x |= y
            for f in y:
                group[f] = x
    return {f: min(g, key=lambda k: (-usage.get(k, 0), k[1]))[1] for f, g in group.items()}


def across_sources(names: dict, seen: dict, size: dict) -> dict:
    """The same with one name for a quantity of several sources: the fields of each further source are matched with those named before, the source with the most records
    first. names: {(source, field): name}, seen: {(source, name): Profile}, size: {source: records}."""
    known: dict[str, Profile] = {}
    out: dict = {}
    for source in sorted(size, key=lambda s: (-size[s], str(s))):
        own = {n: p for (s, n), p in seen.items() if s == source}
        same = {n: n for n in own if n in known}
        rest = {n: p for n, p in own.items() if n not in same}
        same.update((x, y) for x, y in pairs(rest, {k: p for k, p in known.items() if k not in same}))
        for n, p in own.items():
            name = same.get(n, n)
            known[name] = known[name].plus(p) if name in known else p
        out.update({(s, f): same.get(n, n) for (s, f), n in names.items() if s == source})
    return out


def column_type(p: Profile) -> str:
    """double for numbers, also where some are written as text; boolean; else string. Strings that merely look like numbers stay strings."""
    return "double" if p.code in ("n", "ns") and not p.words else "boolean" if p.code == "b" else "string"


def _schema(files: DataFrame) -> tuple[dict, dict]:
    """({(source, field): name}, {name: type}) of the unified table. What the driver sees is the schema: layouts, renames and a profile for each source, not records."""

    def by_source(batches):
        found: dict = {}
        for pdf in batches:
            for source, records, blob in zip(pdf["source"], pdf["records"], pdf["blob"]):
                n, fields = found.get(source, (0, {}))
                found[source] = (n + records, _merge(fields, _unpack(blob)))
        yield pd.DataFrame([(s, n, _pack(f)) for s, (n, f) in found.items()], columns=["source", "records", "blob"])

    shape = "source string, records long, blob binary"
    rows = files.select("source", "records", "blob").mapInPandas(by_source, shape).repartition("source").mapInPandas(by_source, shape).collect()
    layouts = [(r.source, r.fields.split("\x02"), r.n) for r in files.groupBy("source", "fields").agg(F.sum("records").alias("n")).collect()]
    usage: dict = {}
    for source, fields, n in layouts:
        for f in fields:
            usage[source, f] = usage.get((source, f), 0) + n
    found = _changes(files).where("change = 'renamed'").groupBy("source", "old_field", "new_field").count().collect()
    renames = {(r.source, r.old_field, r.new_field): r["count"] for r in found if (r.source, r.old_field) in usage and (r.source, r.new_field) in usage}
    names = canonical_names(renames, [(s, f) for s, f, _ in layouts], usage)
    seen: dict = {}
    for r in rows:
        for f, p in _unpack(r.blob).items():
            key = (r.source, names[r.source, f])
            seen[key] = seen[key].plus(p) if key in seen else p
    final = across_sources(names, seen, {r.source: r.records for r in rows})
    whole, count = {}, {}
    for (source, f), name in final.items():
        count[name] = count.get(name, 0) + usage[source, f]
    for (source, n), p in seen.items():
        name = next(final[source, f] for f in (k[1] for k, v in names.items() if k[0] == source and v == n))
        whole[name] = whole[name].plus(p) if name in whole else p
    wide = sorted(sorted(whole, key=lambda n: (-count[n], n))[:WIDE])
    return final, {n: column_type(whole[n]) for n in wide}


def unified(records: DataFrame) -> DataFrame:
    """(path, line_number, source, one typed column for each field, others): every record with its fields under one name each, over all sources.

    Types: see :func:`column_type`; values of string columns that are no strings stand as JSON. `others` is a map of what has no place of its own, by its own path,
    as text: the second of two fields of a record that share a name, a value that its column's type can't hold, and fields beyond the WIDE most frequent ones. So
    no value is lost or changed. A payload that isn't an object gives nulls.
    """
    files = profiles(records)
    names, types = _schema(files)
    place = {n: i for i, n in enumerate(types)}
    kinds = list(types.values())
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(batches):
        for pdf in batches:
            rows = []
            for source, payload in zip(pdf["source"], pdf["payload"]):
                row, rest = [None] * len(place), {}
                for field, v in zip(*flatten(_parse(payload) or {})):
                    if v is None:
                        continue
                    i = place.get(names.get((source, field), field))
                    x = None
                    if i is not None and row[i] is None:
                        x = text(v) if kinds[i] == "string" else _number(v) if kinds[i] == "double" else v if isinstance(v, bool) else None
                    if x is None:
                        rest[field] = text(v)
                    else:
                        row[i] = x
                rows.append((*row, rest or None))
            out = pd.DataFrame(rows, columns=[*types, "others"], dtype=object)
            yield pd.concat([pdf[["path", "line_number", "source"]].reset_index(drop=True), out.set_axis([f"_{i}" for i in range(len(types))] + ["others"], axis=1)], axis=1)

    shape = "path string, line_number long, source string, " + "".join(f"_{i} {k}, " for i, k in enumerate(kinds)) + "others map<string,string>"
    out = records.select("path", "line_number", "source", "payload").mapInPandas(run, shape)
    clash = {"path", "line_number", "source", "others"}
    return out.select("path", "line_number", "source", *[F.col(f"_{i}").alias(f"record.{n}" if n in clash else n) for i, n in enumerate(types)], "others")
