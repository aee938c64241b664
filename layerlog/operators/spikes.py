"""Implausible readings: spikes, stuck values and physically impossible values, relative to each device's normal behaviour.

Readings are laid out by device and time.  From level, difference, phase of the job (the season of a printer: warming up after a start) and run
length an isolation forest per device scores every reading; a reading beyond the range that a node has seen is isolated there, so that what no tree drew
is found all the same.  Readings with a score of `ANOMALOUS` or more are the spike candidates (about one reading in seven); an exact check follows: does a
candidate lie more than ``TIMES`` times the device's steady scatter outside of what its set point and its neighbours lead to expect?  Explicit limits of
what is physically possible, and runs of ``RUN`` equal readings, are rules beside it.

A device's time line is one block of rows unless it has more than ``BLOCK_ROWS``; then it is cut at full hours into blocks that see ``HALO`` rows
of their neighbours.  Its statistics are taken over all of its rows, and it has one forest, grown from rows drawn over all of its blocks, which every block
uses.  So a device with a third of all rows is many tasks, and block size has no say in its scores.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut

HOUR_US = 3_600_000_000
NO_DEVICE = "\0"  #: stands for a null device
TIMES = 10.0
RUN = 6
BLOCK_ROWS = 20_000
HALO = 40
RAMP = 6  #: readings after a start or move that don't count as steady
NEAR = 5  #: neighbours on each side whose median is an expectation
TREES, PSI = 16, 64  #: trees of a forest and the rows each is grown from: the method's own samples
ANOMALOUS = 0.55  #: score of a candidate
FEW = 8  #: a device with fewer readings can't be told apart by a forest: all of them are candidates
RESOLUTION = 3  #: digits of residuals whose counts make a large device's statistics, so that these are of bounded size
LEAST_SCATTER = 0.03
AMBIENT = 25.0
PHASES = 2 * (RAMP + 2)  #: phases of a season, in heat and at rest
WINDOW, FINEST = 4.0, 0.1  #: scatter is taken within so many median deviations, and within that of readings so coarse at least
#: kinds of readings that the scatter is taken from, best first, and how many of them must be there
CLASSES = (("steady", 4), ("warm", 4), ("heating", 3), ("rest", 3))
#: physically possible °C: (lowest anywhere, highest anywhere, lowest while the heater holds a set point in a job)
POSSIBLE = {"nozzle_c": (-20.0, 350.0, 5.0), "bed_c": (-20.0, 150.0, 5.0)}
TARGET = {"nozzle_c": "target_nozzle_c", "bed_c": "target_bed_c"}
FIELDS = ("bed_c", "nozzle_c")


# --- isolation forest over many groups at once ----------------------------------------------------------------------------------------------


def _mix(*parts) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the parts only (splitmix64)."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (np.asarray(p).astype(np.uint64) + x) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(n.astype(float), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _draw(x: np.ndarray, group: np.ndarray, seed: np.ndarray, given: dict, trees: int, psi: int):
    """The points that each tree grows from: (points, tree of each point, points of a tree by group). Trees are numbered through, `trees` to a group."""
    n_groups = int(group[-1]) + 1
    first = np.searchsorted(group, np.arange(n_groups))
    size = np.diff(np.r_[first, len(group)])
    take = np.where([g in given for g in range(n_groups)], [len(given.get(g, ())) // trees for g in range(n_groups)], np.minimum(size, psi))
    tree = np.repeat(np.arange(n_groups * trees), np.repeat(take, trees))
    at = np.arange(len(tree)) - np.repeat(np.cumsum(np.repeat(take, trees)) - np.repeat(take, trees), np.repeat(take, trees))
    g = tree // trees
    drawn = np.where(size[g] > psi, (_mix(seed[g], tree % trees, at) * size[g]).astype(np.int64), at)
    points = x[first[g] + np.minimum(drawn, size[g] - 1)]
    for k, rows in given.items():
        points[g == k] = rows[: take[k] * trees]
    return points, tree, take


def forest_scores(x: np.ndarray, group: np.ndarray, seed: np.ndarray, given: dict | None = None, trees: int = TREES, psi: int = PSI) -> np.ndarray:
    """Isolation score in (0, 1] of every row of x, by a forest of its own for each group.

    group: 0, 0, 1, 1, 1 ... (sorted); seed: a number for each group; given: {group: rows drawn beforehand} for groups of which x holds a part only. All trees
    of all groups grow level by level together. Groups up to `psi` rows are used whole, larger ones by `psi` draws for each tree. A row that lies beyond a
    node's range by more than that range is isolated at that node.
    """
    if not len(group):
        return np.zeros(0)
    points, tree, take = _draw(x, group, seed, given or {}, trees, psi)
    depth = max(1, math.ceil(math.log2(max(2, psi))))
    width = 1 << (depth + 1)
    nodes_all = len(take) * trees * width
    feat, count = np.full(nodes_all, -1, dtype=np.int8), np.zeros(nodes_all, dtype=np.int32)
    at_cut, low, high = np.zeros(nodes_all), np.zeros(nodes_all), np.zeros(nodes_all)
    node, live = np.ones(len(tree), dtype=np.int64), np.arange(len(tree))
    for _ in range(depth):
        if not len(live):
            break
        key = tree[live] * width + node[live]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        nodes, n = key[start], np.diff(np.r_[start, len(key)])
        count[nodes] = n
        lo, hi = np.minimum.reduceat(points[live], start, axis=0), np.maximum.reduceat(points[live], start, axis=0)
        can = hi > lo
        gs, ts, ns = seed[nodes // width // trees], nodes // width % trees, nodes % width
        k = can.sum(axis=1)
        f = np.argmax(np.cumsum(can, axis=1) > (_mix(gs, ts, ns, 1) * k).astype(np.int64)[:, None], axis=1)
        r = np.arange(len(nodes))
        lo, hi = lo[r, f], hi[r, f]
        cut = lo + (hi - lo) * (0.02 + 0.96 * _mix(gs, ts, ns, 2))
        split = (k > 0) & (n > 1)
        feat[nodes], at_cut[nodes] = np.where(split, f, -1), cut
        low[nodes], high[nodes] = lo - (hi - lo), hi + (hi - lo)
        own = np.repeat(r, n)
        keep = split[own]
        live, own = live[keep], own[keep]
        node[live] = 2 * node[live] + (points[live, f[own]] >= cut[own])
    if len(live):
        np.add.at(count, tree[live] * width + node[live], 1)
    total = np.zeros(len(x))
    for t in range(trees):
        base = (group.astype(np.int64) * trees + t) * width
        at, steps, beyond = np.ones(len(x), dtype=np.int64), np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        go = np.arange(len(x))
        for _ in range(depth):
            k = base[go] + at[go]
            go, k = go[feat[k] >= 0], k[feat[k] >= 0]
            if not len(go):
                break
            v = x[go, feat[k]]
            steps[go] += 1
            at[go] = 2 * at[go] + (v >= at_cut[k])
            out = (v < low[k]) | (v > high[k])
            beyond[go[out]] = True
            go = go[~out]
        total += steps + np.where(beyond, 0.0, _average_path(count[base + at]))
    norm = _average_path(take)[group]
    return np.where(norm > 0, 2.0 ** (-(total / trees) / np.where(norm > 0, norm, 1.0)), 0.5)


# --- features ---------------------------------------------------------------------------------------------------------------------------------


def _shift(a: np.ndarray, seg: np.ndarray, k: int) -> np.ndarray:
    """a moved by k rows within segments; NaN where that leaves the segment."""
    out = np.full(len(a), np.nan)
    if abs(k) < len(a):
        if k > 0:
            out[k:] = np.where(seg[k:] == seg[:-k], a[:-k], np.nan)
        else:
            out[:k] = np.where(seg[:k] == seg[-k:], a[-k:], np.nan)
    return out


def _row_median(m: np.ndarray) -> np.ndarray:
    s = np.sort(m, axis=1)  # NaN last
    n = (~np.isnan(s)).sum(axis=1)
    r = np.arange(len(s))
    a, b = s[r, np.maximum(0, (n - 1) // 2)], s[r, np.minimum(s.shape[1] - 1, n // 2)]
    return np.where(n > 0, (a + b) / 2, np.nan)


def _group_median(v: np.ndarray, g: np.ndarray, n: int, least: int = 1) -> np.ndarray:
    """Median by group (NaN: fewer than `least` values)."""
    s = pd.Series(v).groupby(g)
    med, cnt = s.median(), s.count()
    out = np.full(n, np.nan)
    ok = cnt.to_numpy() >= least
    out[med.index.to_numpy()[ok]] = med.to_numpy()[ok]
    return out


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


class Layout:
    """Rows of whole blocks, sorted by (block, time): runs, stretches (same job, state and set point) and steady readings of one field."""

    def __init__(self, pdf: pd.DataFrame, group: np.ndarray, field: str):
        self.field, low, high, hot = field, *POSSIBLE[field]
        all_v = pdf[field].to_numpy(dtype=float, na_value=np.nan)
        state = pdf["state"].fillna("").to_numpy()
        t = pdf[TARGET[field]].to_numpy(dtype=float, na_value=np.nan)
        t = np.where(np.isnan(t), 0.0, t)
        # runs over successive status rows; a null ends a run
        new = _starts(group) | np.isnan(all_v)
        new[1:] |= all_v[1:] != all_v[:-1]
        rid = np.cumsum(new)
        run = np.bincount(rid)[rid]
        run[np.isnan(all_v)] = 0
        keep = np.flatnonzero(~np.isnan(all_v))
        self.keep, self.v, self.t, self.group, self.run = keep, all_v[keep], t[keep], group[keep], run[keep]
        job = pdf["job_id"].fillna("").to_numpy()[keep]
        self.state = state[keep]
        begin = _starts(self.group, job, self.state, self.t) if len(keep) else np.zeros(0, bool)
        self.stretch = np.cumsum(begin)
        at = np.flatnonzero(begin)
        self.pos = np.arange(len(keep)) - np.repeat(at, np.diff(np.r_[at, len(keep)])) if len(keep) else np.zeros(0, int)
        self.rest = self.t <= 0
        active = np.isin(self.state, ("PRINTING", "PAUSED")) & ~self.rest
        self.impossible = (self.v < low) | (self.v > high) | np.isinf(self.v) | (active & (self.v < hot))
        self.sound = ~self.impossible & (self.run < RUN)
        self.resid = self.v - self.t
        hot_ = self.sound & ~self.rest
        self.classes = {"steady": hot_ & (self.pos >= RAMP), "warm": hot_ & (self.pos >= RAMP // 2), "heating": hot_, "rest": self.sound & self.rest}

    def phase(self) -> np.ndarray:
        """Place in the season: readings since the stretch began, at rest and in heat."""
        return np.minimum(self.pos, RAMP + 1) + np.where(self.rest, PHASES // 2, 0)

    def features(self, stats: dict) -> tuple[np.ndarray, np.ndarray]:
        """(features, distance from expectation in scatters) of every reading. stats: bias, scatter, ambient and season by group.

        Features: level, the distance from every expectation; difference, from the readings on both sides; season, from what is usual in that phase, both held
        within a half and twice the level; run length up to the rule's.
        """
        g, v = self.group, self.v
        sd, bias, ambient = stats["scatter"][g], stats["bias"][g], stats["ambient"][g]
        want = np.where(self.rest, ambient, self.t + bias)
        clean = np.where(self.impossible, np.nan, v)
        before = np.column_stack([_shift(clean, self.stretch, k) for k in range(1, NEAR + 1)])
        after = np.column_stack([_shift(clean, self.stretch, -k) for k in range(1, NEAR + 1)])
        fore, aft = _row_median(before), _row_median(after)
        start = np.isnan(fore) & (self.pos == 0)
        prior = _shift(clean, g, 1)

        def outside(*bounds):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                m = np.column_stack(bounds)
                return np.maximum(0.0, np.maximum(np.nanmin(m, axis=1) - v, v - np.nanmax(m, axis=1)))

        # a stretch begins anywhere between where the last one ended (or room temperature) and its set point
        off = outside(want, fore, aft, np.where(start, prior, np.nan), np.where(start, ambient, np.nan))
        # where set point and both sides agree, the expectation is a point, their median
        three = np.column_stack([want, fore, aft])
        agree = ~np.isnan(three).any(axis=1) & (three.max(axis=1) - three.min(axis=1) <= WINDOW * sd)
        off = np.where(agree, np.abs(v - np.median(three, axis=1)), off)
        first = off > TIMES * sd
        # again between the nearest neighbours that passed: a drop while warming up
        passed = np.where(first | self.impossible | (self.run >= RUN), np.nan, v)
        s = pd.Series(passed)
        left, right = (_shift(x.to_numpy(), self.stretch, k) for x, k in ((s.groupby(self.stretch).ffill(), 1), (s.groupby(self.stretch).bfill(), -1)))
        near = outside(want, left, right)
        off = np.where((self.pos > 0) & ~np.isnan(left) & ~agree, np.maximum(off, near), off) / sd
        with np.errstate(invalid="ignore"):
            level = np.clip(np.nan_to_num(off, nan=0.0, posinf=1e3), 0.0, 1e3)
            held = lambda x: np.clip(np.nan_to_num(x / sd, posinf=1e3), level / 2, 2 * level)
            usual = want + stats["season"][g, self.phase()]
            difference = held(outside(want, _row_median(before[:, :3]), _row_median(after[:, :3])))
            season = held(outside(want, usual, np.where(np.isnan(before[:, 0]), after[:, 0], before[:, 0]), after[:, 0]))
        return np.column_stack([level, difference, season, np.minimum(self.run, RUN - 1)]), off

    def score(self, stats: dict, seed: np.ndarray, given: dict | None = None) -> pd.DataFrame:
        """Score of every reading, and which are implausible and why."""
        x, off = self.features(stats)
        if not len(x):
            return pd.DataFrame({"row": self.keep, "score": off, "off": off, "reason": np.zeros(0, object)})
        here = _starts(self.group)
        groups = self.group[here]  # those with a reading
        code = np.cumsum(here) - 1
        given = {i: given[g] for i, g in enumerate(groups) if g in given} if given else {}
        score = forest_scores(x, code, seed[groups], given)
        few = (np.bincount(code)[code] < FEW) & ~np.isin(code, list(given))
        spike = ((score >= ANOMALOUS) | few) & (off > TIMES)
        reason = np.where(self.impossible, "impossible", np.where(self.run >= RUN, "stuck", np.where(spike, "spike", "")))
        return pd.DataFrame({"row": self.keep, "score": score, "off": off, "reason": reason})


def own_stats(lay: Layout, n: int) -> dict:
    """bias, scatter and ambient of each group from its own rows: medians, and the deviation of what lies within WINDOW median deviations."""
    out = {"bias": np.full(n, np.nan), "scatter": np.full(n, np.nan)}
    for name, least in CLASSES:
        m = lay.classes[name]
        g, r = lay.group[m], lay.resid[m]
        med = _group_median(r, g, n, least)
        mad = _group_median(np.abs(r - med[g]), g, n, least) * 1.4826
        near = np.abs(r - med[g]) <= WINDOW * np.maximum(mad, FINEST)[g]
        with np.errstate(invalid="ignore", divide="ignore"):
            dev = np.sqrt(np.bincount(g[near], ((r - med[g]) ** 2)[near], n) / np.bincount(g[near], minlength=n))
        if name != "rest":
            out["bias"] = np.where(np.isnan(out["bias"]), med, out["bias"])
        out["scatter"] = np.where(np.isnan(out["scatter"]), np.where(np.isnan(med), np.nan, dev), out["scatter"])
    out["ambient"] = _group_median(lay.v[lay.classes["rest"]], lay.group[lay.classes["rest"]], n)
    at = lay.group.astype(np.int64) * PHASES + lay.phase()
    out["season"] = _group_median(lay.resid, at, n * PHASES).reshape(n, PHASES)
    return out


def _settle(stats: dict) -> dict:
    out = {
        "bias": np.nan_to_num(stats["bias"]),
        "scatter": np.maximum(np.where(np.isnan(stats["scatter"]), 1.0, stats["scatter"]), LEAST_SCATTER),
        "ambient": np.where(np.isnan(stats["ambient"]), AMBIENT, stats["ambient"]),
    }
    # seasons come as medians of residuals, and are used as distances from what the set point leads to expect
    usual = np.where(np.arange(PHASES) < PHASES // 2, out["bias"][:, None], out["ambient"][:, None])
    return {**out, "season": np.nan_to_num(stats["season"] - usual)}


# --- Spark ------------------------------------------------------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """(device_id, _hour, _block, _all, _core) for the hours of devices with more than `block_rows` rows; an hour also belongs, not as core, to blocks
    whose first row lies less than `halo` rows behind it or whose last row less than `halo` rows before it."""
    hours = rows.groupBy("device_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy("device_id").orderBy("_hour")  # one row an hour
    hours = hours.withColumn("_c1", F.sum("_n").over(by)).withColumn("_c0", F.col("_c1") - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy("device_id")))
    hours = hours.where(F.col("_all") > block_rows).withColumn("_block", F.floor(F.col("_c0") / block_rows))
    spans = hours.groupBy("device_id", "_block").agg(F.min("_c0").alias("_s"), F.max("_c1").alias("_e"))
    h = hours.select("device_id", "_hour", "_c0", "_c1", "_all", F.col("_block").alias("_own"))
    return h.join(spans, "device_id").where((F.col("_c1") > F.col("_s") - halo) & (F.col("_c0") < F.col("_e") + halo)).select("device_id", "_hour", "_block", "_all", (F.col("_own") == F.col("_block")).alias("_core"))


def _chunks(batches, rows: int = 40_000):
    """Frames of whole blocks from sorted batches, each of about `rows` rows or one block."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n < rows:
            continue
        all_ = pd.concat(held, ignore_index=True)
        d, k = all_["device_id"].fillna("\0").to_numpy(), all_["_block"].to_numpy()
        new = np.flatnonzero((d[1:] != d[:-1]) | (k[1:] != k[:-1])) + 1
        if len(new):
            yield all_.iloc[: new[-1]].reset_index(drop=True)
            all_ = all_.iloc[new[-1] :].reset_index(drop=True)
        held, n = [all_], len(all_)
    if n:
        yield pd.concat(held, ignore_index=True)


def _groups(pdf: pd.DataFrame) -> tuple[np.ndarray, int]:
    new = _starts(pdf["device_id"].fillna("\0").to_numpy(), pdf["_block"].to_numpy())
    g = np.cumsum(new) - 1
    return g, int(g[-1]) + 1 if len(g) else 0


_STATS, _WIDTH = 3 + PHASES, 4  #: numbers of a field's statistics; features


class Model:
    """What a block knows of its whole device: for each field bias, scatter, ambient, season, and the rows its forest grows from (none yet: empty)."""

    def __init__(self, stats: np.ndarray, drawn: list[np.ndarray] | None = None):
        self.stats, self.drawn = stats, drawn or [np.zeros((0, _WIDTH)) for _ in FIELDS]

    def pack(self) -> bytes:
        return np.concatenate([self.stats.ravel(), *([len(d)] for d in self.drawn), *(d.ravel() for d in self.drawn)]).astype(np.float64).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Model":
        a, k = np.frombuffer(raw, np.float64), len(FIELDS)
        stats, n = a[: k * _STATS].reshape(k, _STATS), a[k * _STATS : k * (_STATS + 1)].astype(int)
        at = k * (_STATS + 1) + np.r_[0, np.cumsum(n * _WIDTH)]
        return cls(stats, [a[at[i] : at[i + 1]].reshape(-1, _WIDTH) for i in range(k)])


def _laid(pdf: pd.DataFrame):
    """(rows without the model rows, groups, number of groups, {group: Model}) of a chunk."""
    models = pdf["_model"].notna().to_numpy()
    g, n = _groups(pdf)
    known = {int(k): Model.unpack(raw) for k, raw in zip(g[models], pdf["_model"][models])}
    return pdf[~models].reset_index(drop=True), g[~models], n, known


def _stats_of(lay: Layout, n: int, known: dict, field: int) -> dict:
    st = own_stats(lay, n)
    for k, m in known.items():
        st["bias"][k], st["scatter"][k], st["ambient"][k] = m.stats[field, :3]
        st["season"][k] = m.stats[field, 3:]
    return _settle(st)


def _residuals(batches):
    """(device_id, field, class, resid) of the core rows that a device's statistics are taken from; classes by name, and the phases of the season."""
    for pdf in _chunks(batches):
        pdf, g, _, _ = _laid(pdf)
        device, core = pdf["device_id"].to_numpy(), pdf["_core"].to_numpy(dtype=bool)
        for f in FIELDS:
            lay = Layout(pdf, g, f)
            sets = {**lay.classes, "season": np.ones(len(lay.v), bool)}
            for name, m in sets.items():
                at = m & core[lay.keep]
                kind = np.char.add("s", lay.phase()[at].astype(str)) if name == "season" else name
                yield pd.DataFrame({"device_id": device[lay.keep[at]], "field": f, "class": kind, "resid": np.round(lay.resid[at], RESOLUTION)})


def _device_stats(laid: DataFrame) -> DataFrame:
    """(device_id, _model) of devices in several blocks, without forest: statistics over all of their rows, by counts of values and weighted medians."""
    counts = laid.mapInPandas(_residuals, "device_id string, field string, class string, resid double").groupBy("device_id", "field", "class", "resid").agg(F.count(F.lit(1)).alias("n"))
    key = ["device_id", "field", "class"]
    med = counts.groupBy(key).agg(F.percentile("resid", F.lit(0.5), F.col("n")).alias("med"), F.sum("n").alias("all"))
    named = counts.where(~F.col("class").rlike("^s[0-9]"))
    away = named.join(med, key).withColumn("away", F.abs(F.col("resid") - F.col("med")))
    mad = away.groupBy(key).agg((F.percentile("away", F.lit(0.5), F.col("n")) * 1.4826).alias("mad"))
    near = away.join(mad, key).where(F.col("away") <= WINDOW * F.greatest(F.col("mad"), F.lit(FINEST)))
    dev = near.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("away") ** 2) / F.sum("n")).alias("dev"))
    found = med.join(dev, key, "left").groupBy("device_id").agg(F.collect_list(F.struct("field", "class", "med", "all", "dev")).alias("of"))  # a few dozen rows a device

    def pack(batches):
        for pdf in batches:
            out = []
            for of in pdf["of"]:
                got = {(r["field"], r["class"]): r for r in of}
                stats = np.full((len(FIELDS), _STATS), np.nan)
                for i, f in enumerate(FIELDS):
                    for name, least in reversed(CLASSES):
                        r = got.get((f, name))
                        if r is not None and r["all"] >= least:
                            stats[i, 1] = r["dev"]
                            if name != "rest":
                                stats[i, 0] = r["med"]
                    if (f, "rest") in got:
                        stats[i, 2] = got[f, "rest"]["med"]
                    stats[i, 3:] = [got[f, f"s{k}"]["med"] if (f, f"s{k}") in got else np.nan for k in range(PHASES)]
                out.append(Model(stats).pack())
            yield pd.DataFrame({"device_id": pdf["device_id"], "_model": out})

    return found.mapInPandas(pack, "device_id string, _model binary")


def _draws(large: DataFrame, blocks: DataFrame, stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """(device_id, field, h, x): rows for the forests of devices in several blocks, drawn by a hash of the reading over all blocks. The chance of being drawn falls
    with the size of the device, so that about four times the rows that a forest needs come together, whatever its size."""

    def run(batches):
        for pdf in _chunks(batches):
            pdf, g, n, known = _laid(pdf)
            device, core, rate = pdf["device_id"].to_numpy(), pdf["_core"].to_numpy(dtype=bool), pdf["_rate"].to_numpy(dtype=float)
            h = _mix(pd.util.hash_array(pdf["dedupe_key"].fillna("").to_numpy(dtype=object)), pdf["_us"].to_numpy().astype(np.int64))
            for i, f in enumerate(FIELDS):
                lay = Layout(pdf, g, f)
                x, _ = lay.features(_stats_of(lay, n, known, i))
                at = core[lay.keep] & (h[lay.keep] < rate[lay.keep])
                yield pd.DataFrame({"device_id": device[lay.keep[at]], "field": f, "h": h[lay.keep[at]], "x": list(x[at])})

    rate = sizes.select("device_id", F.least(F.lit(1.0), F.lit(4.0 * TREES * PSI) / F.col("_all")).alias("_rate"))
    laid = _sorted(_with_models(large.join(rate, "device_id"), blocks, stats))
    return laid.mapInPandas(run, "device_id string, field string, h double, x array<double>")


def _forests(stats: DataFrame, draws: DataFrame) -> DataFrame:
    """(device_id, _model) with the rows that the forests grow from: those with the least hashes, at most TREES x PSI a field."""
    rows = draws.groupBy("device_id").agg(F.collect_list(F.struct("field", "h", "x")).alias("rows"))  # of bounded size by construction, see _draws

    def pack(batches):
        for pdf in batches:
            out = []
            for raw, rows in zip(pdf["_model"], pdf["rows"]):
                m, drawn = Model.unpack(raw), []
                for f in FIELDS:
                    own = sorted((r["h"], tuple(r["x"])) for r in rows if r["field"] == f)[: TREES * PSI] if rows is not None else []
                    own = own[: len(own) // TREES * TREES]
                    drawn.append(np.array([x for _, x in own]).reshape(-1, _WIDTH))
                out.append(Model(m.stats, drawn).pack())
            yield pd.DataFrame({"device_id": pdf["device_id"], "_model": out})

    return stats.join(rows, "device_id", "left").select("device_id", "_model", "rows").mapInPandas(pack, "device_id string, _model binary")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows by block, a block's model first, then by time."""
    return rows.repartition("device_id", "_block").sortWithinPartitions("device_id", "_block", F.col("_model").isNull(), "_us", "dedupe_key")


def _with_models(rows: DataFrame, blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Adds a row with its device's model to each block of a device in several blocks."""
    own = blocks.select("device_id", "_block").distinct().join(models, "device_id")
    return rows.unionByName(own, allowMissingColumns=True)


def score_readings(events: DataFrame, block_rows: int = BLOCK_ROWS, halo: int = HALO, only_found: bool = False) -> DataFrame:
    """Every non-null bed_c and nozzle_c of the status rows: (dedupe_key, device_id, field, score, off, reason).

    score: of the isolation forest of its device; off: distance from expectation in scatters; reason: 'spike', 'stuck', 'impossible' or ''.
    `only_found` returns those with a reason. Nulls: null readings aren't scored and end runs of equal values; rows without event_ts come first
    on the device's time line, in the order of a hash of their key; a null set point counts as rest; null devices form one group. NaN is null, infinity impossible.
    Rows that tie in time are ordered by dedupe_key. Repeated rows are successive rows. An empty table gives no rows.
    """
    need = ["dedupe_key", "device_id", "state", "job_id", *FIELDS, *TARGET.values()]
    timeless = -(F.pmod(F.xxhash64("dedupe_key"), F.lit(1 << 16)) + 1) * HOUR_US
    rows = events.where("kind = 'status'").select(*need, F.coalesce(F.unix_micros("event_ts"), timeless).alias("_us")).withColumn("_hour", F.floor(F.col("_us") / HOUR_US))
    for c in (*FIELDS, *TARGET.values()):
        rows = rows.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None)))
    rows = rows.withColumn("device_id", F.coalesce("device_id", F.lit(NO_DEVICE))).withColumn("_model", F.lit(None).cast("binary"))
    cut_ = cut(_blocks(rows, block_rows, halo))  # a row for each hour of the large devices
    if cut_.isEmpty():
        laid = rows.drop("_hour").withColumns({"_block": F.lit(0).cast("bigint"), "_core": F.lit(True)})
    else:
        blocks = cut_.drop("_all")
        large = rows.join(blocks, ["device_id", "_hour"]).drop("_hour")
        stats = cut(_device_stats(_sorted(large)))
        sizes = cut_.groupBy("device_id").agg(F.max("_all").alias("_all"))
        models = cut(_forests(stats, _draws(large, blocks, stats, sizes)))
        laid = rows.join(blocks, ["device_id", "_hour"], "left").drop("_hour").withColumns({"_block": F.coalesce("_block", F.lit(0)), "_core": F.coalesce("_core", F.lit(True))})
        laid = _with_models(laid, blocks, models)
    schema = "dedupe_key string, device_id string, field string, score double, off double, reason string"

    def run(batches):
        for pdf in _chunks(batches):
            pdf, g, n, known = _laid(pdf)
            device, key, core = pdf["device_id"].to_numpy(), pdf["dedupe_key"].to_numpy(), pdf["_core"].to_numpy(dtype=bool)
            head = np.zeros(n, dtype=object)
            head[g] = device
            seed = pd.util.hash_array(head).astype(np.int64) & 0x7FFFFFFF
            for i, f in enumerate(FIELDS):
                lay = Layout(pdf, g, f)
                out = lay.score(_stats_of(lay, n, known, i), seed, {k: m.drawn[i] for k, m in known.items() if len(m.drawn[i])})
                out = out[core[out["row"].to_numpy()]]
                if only_found:
                    out = out[out["reason"] != ""]
                at = out.pop("row").to_numpy()
                own = pd.Series(device[at], dtype=object)
                yield pd.DataFrame({"dedupe_key": key[at], "device_id": own.where(own != NO_DEVICE, None), "field": f, "score": out["score"].to_numpy(), "off": out["off"].to_numpy(), "reason": out["reason"].to_numpy()})

    return _sorted(laid).mapInPandas(run, schema)


def implausible(events: DataFrame) -> DataFrame:
    """(dedupe_key, field) of readings that are implausible."""
    return score_readings(events, only_found=True).select("dedupe_key", "field")
