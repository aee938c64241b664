"""Per-period aggregates by event time that are corrected as late records arrive, with a cut-off.

The state of one source is a finger B-tree of partial aggregates keyed by period: leaves hold (period, partial), inner nodes the sum of their
subtree.  Insertion starts at the right finger, climbs to the subtree that covers the key and updates the partials of its ancestors only; when
the watermark moves, whole subtrees left of it are cut off at once.  A period is published by reading its partial from the tree when its time has come;
what the tree holds later is its correction, and what the tree refuses, as the period was cut off, was too late.  Nothing else decides.

Spark first reduces messages to one partial per (source, period, hours of delay), so a tree never sees single rows, and splits a source's time line into
spans, so that a source with a third of all rows is many trees.  :func:`advance` takes the rows of a stored state and those of a batch; an empty state and all
messages as one batch give the corrected table of :func:`corrected_hours`, a stored state and a stream's batch give the stream's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600
GRACE_H = 1  #: an hour is published so many hours after its end
CUTOFF_H = 48  #: messages received more than so many hours after its end are too late
SPAN_H = 24 * 14  #: hours of one tree
FANOUT = 8


def combine(a, b):
    """Sums of all but the last value, maximum of the last; None is neutral."""
    if a is None or b is None:
        return a if b is None else b
    last = b[-1] if a[-1] is None else a[-1] if b[-1] is None else max(a[-1], b[-1])
    return tuple(x + y for x, y in zip(a[:-1], b[:-1])) + (last,)


class _Node:
    __slots__ = ("keys", "vals", "kids", "agg", "up")

    def __init__(self, leaf=True):
        self.keys, self.vals, self.kids, self.agg, self.up = [], [], None if leaf else [], None, None


class FingerTree:
    """B-tree of (key, partial) with a finger at its right spine: inserts near the newest key touch few nodes."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.root = fanout, _Node()
        self.finger = self.root
        self.floor = None  # keys below it were evicted

    def insert(self, key, value) -> bool:
        """Adds value to the partial of key; False if the key lies below the cut-off."""
        if self.floor is not None and key < self.floor:
            return False
        node = self.finger
        while node.up is not None and self._low(node) > key:  # climb from the right finger
            node = node.up
        while node.kids is not None:
            node = node.kids[max(0, bisect_right(node.keys, key) - 1)]
        i = bisect_left(node.keys, key)
        if i < len(node.keys) and node.keys[i] == key:
            node.vals[i] = combine(node.vals[i], value)
        else:
            node.keys.insert(i, key)
            node.vals.insert(i, value)
        self._lift(node, value, i == 0)
        if len(node.keys) > self.fanout:
            self._split(node)
        return True

    def get(self, key):
        """The partial of key, or None; from the right finger, like an insertion."""
        node = self.finger
        while node.up is not None and self._low(node) > key:
            node = node.up
        while node.kids is not None:
            node = node.kids[max(0, bisect_right(node.keys, key) - 1)]
        i = bisect_left(node.keys, key)
        return node.vals[i] if i < len(node.keys) and node.keys[i] == key else None

    def _low(self, node):
        while node.kids:
            node = node.kids[0]
        return node.keys[0] if node.keys else key_min

    def _lift(self, node, value, first):
        low = node.keys[0]
        while node is not None:
            node.agg = combine(node.agg, value)
            if first and node.up is not None:
                i = node.up.kids.index(node)
                node.up.keys[i] = min(node.up.keys[i], low)
            node = node.up

    def _sum(self, node):
        out = None
        for x in node.vals if node.kids is None else (k.agg for k in node.kids):
            out = combine(out, x)
        return out

    def _split(self, node):
        while len(node.keys) > self.fanout:
            half = len(node.keys) // 2
            right = _Node(node.kids is None)
            right.keys, node.keys = node.keys[half:], node.keys[:half]
            if node.kids is None:
                right.vals, node.vals = node.vals[half:], node.vals[:half]
            else:
                right.kids, node.kids = node.kids[half:], node.kids[:half]
                for k in right.kids:
                    k.up = right
            node.agg, right.agg = self._sum(node), self._sum(right)
            up = node.up
            if up is None:
                up = self.root = _Node(False)
                up.keys, up.kids, node.up = [node.keys[0]], [node], up
                up.agg = combine(node.agg, right.agg)
            i = up.kids.index(node)
            up.keys.insert(i + 1, right.keys[0])
            up.kids.insert(i + 1, right)
            right.up = up
            node = up
        node = self.root
        while node.kids is not None:
            node = node.kids[-1]
        self.finger = node

    def evict_below(self, key) -> list[tuple]:
        """Cuts off everything below key, whole subtrees at a time, and returns it in order."""
        if self.floor is not None and key <= self.floor:
            return []
        self.floor = key
        out: list[tuple] = []
        node = self.root
        while node is not None:
            if node.kids is None:
                n = bisect_left(node.keys, key)
                out += zip(node.keys[:n], node.vals[:n])
                del node.keys[:n], node.vals[:n]
                break
            n = max(0, bisect_right(node.keys, key) - 1)
            for k in node.kids[:n]:
                out += self._items(k)
            del node.kids[:n], node.keys[:n]
            node = node.kids[0]
        while node is not None:  # partials and low keys of the cut path
            if node.kids is not None:
                while node.kids and not node.kids[0].keys and len(node.kids) > 1:
                    del node.kids[0], node.keys[0]
                if node.kids[0].keys:
                    node.keys[0] = node.kids[0].keys[0]
            node.agg = self._sum(node)
            node = node.up
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.up = None
        node = self.root
        while node.kids is not None:
            node = node.kids[-1]
        self.finger = node
        return out

    def _items(self, node):
        if node.kids is None:
            return list(zip(node.keys, node.vals))
        return [x for k in node.kids for x in self._items(k)]

    def items(self) -> list[tuple]:
        return self._items(self.root)

    def total(self):
        return self.root.agg


key_min = float("-inf")

_VALUES = ["n", "printing", "idle", "bed_sum", "bed_n", "nozzle_sum", "nozzle_n", "chamber_sum", "chamber_n", "nozzle_max"]


KEYS = ("device_id",)
#: a row of the state is an hour: `published` as it stood when it was due (null: nothing in time), or as it stands while it waits for that, `now` as it stands,
#: messages refused, whether it is still open (in the tree) and waits, and the floor of its tree, below which hours are cut off
STATE = "hour_s long, published array<double>, now array<double>, dropped long, open boolean, waiting boolean, floor_s long"


def partials(messages: DataFrame, by=KEYS) -> DataFrame:
    """(`by`, hour_s, delay_h, values): messages reduced by hour of event time and whole hours from the hour's end to receipt, rounded up."""
    start = F.floor(F.unix_micros("event_ts") / 1_000_000 / HOUR).cast("long") * HOUR
    delay = F.ceil((F.unix_micros("received_at") - (start + HOUR) * 1_000_000) / (HOUR * 1_000_000)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).cast("double")
    has = lambda c: c in messages.columns
    value = {c: F.col(c) if has(c) else F.lit(None).cast("double") for c in ("bed_c", "nozzle_c", "chamber_c")}
    rows = messages.withColumns({**value, "state": F.col("state") if has("state") else F.lit(None).cast("string"), "hour_s": start, "delay_h": F.greatest(F.coalesce(delay, F.lit(0)), F.lit(0))})
    return rows.groupBy(*by, "hour_s", "delay_h").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("state") == "PRINTING").cast("double").alias("printing"), F.count_if(F.col("state") == "IDLE").cast("double").alias("idle"),
        total("bed_c").alias("bed_sum"), F.count("bed_c").cast("double").alias("bed_n"), total("nozzle_c").alias("nozzle_sum"), F.count("nozzle_c").cast("double").alias("nozzle_n"),
        total("chamber_c").alias("chamber_sum"), F.count("chamber_c").cast("double").alias("chamber_n"), F.max("nozzle_c").alias("nozzle_max"),
    )


class Span:
    """The tree of one source and span, and what became of its hours."""

    def __init__(self, grace: int, cutoff: int):
        self.grace, self.cutoff, self.tree = grace * HOUR, cutoff * HOUR, FingerTree()
        self.due: list[int] = []  # hours that wait to be published, in order
        self.published, self.closed, self.dropped = {}, {}, {}

    def restore(self, hour, published, now, dropped, open_, waiting, floor) -> None:
        """Takes an hour of a stored state, hours in order."""
        if dropped:
            self.dropped[hour] = dropped
        if open_:
            self.tree.insert(hour, now)
        elif now is not None:
            self.closed[hour] = now
        if waiting:
            insort(self.due, hour)
        elif published is not None:
            self.published[hour] = published
        if floor is not None:
            self.tree.floor = floor if self.tree.floor is None else max(self.tree.floor, floor)

    def take(self, arrivals: list[tuple]) -> None:
        """(hour, hours of delay, partial) in order of arrival."""
        for hour, delay, values in sorted(arrivals, key=lambda r: (r[0] + r[1] * HOUR, r[0])):
            at = hour + (1 + delay) * HOUR
            self._publish(at)
            self.closed.update(self.tree.evict_below(at - HOUR - self.cutoff))
            if not self.tree.insert(hour, values):
                self.dropped[hour] = self.dropped.get(hour, 0) + int(values[0])
            elif hour + HOUR + self.grace >= at:
                i = bisect_left(self.due, hour)
                if i == len(self.due) or self.due[i] != hour:
                    self.due.insert(i, hour)

    def _publish(self, at: int) -> None:
        """Publishes the hours that were due before `at` from the tree."""
        n = bisect_left(self.due, at - HOUR - self.grace)
        for hour in self.due[:n]:
            if hour not in self.published:
                self.published[hour] = self.tree.get(hour)
        del self.due[:n]

    def rows(self) -> list[tuple]:
        """Rows of the state, hours in order; hours that aren't due yet have nothing to correct."""
        live = dict(self.tree.items())
        now = {**self.closed, **live}
        waiting = set(self.due)
        return [(h, self.published.get(h, now.get(h) if h in waiting else None), now.get(h), self.dropped.get(h, 0), h in live, h in waiting, self.tree.floor) for h in sorted({*now, *self.dropped})]


def advance(state: DataFrame | None, parts: DataFrame, by=KEYS, grace: int = GRACE_H, cutoff: int = CUTOFF_H, span_h: int = SPAN_H) -> DataFrame:
    """The state after a batch: (`by`, as text, STATE), one row an hour. `state` comes from an earlier call (None: nothing yet), `parts` from :func:`partials`.

    Only the trees that a batch touches change, and those only along the paths of its hours; the arrivals of a batch are taken in order of receipt. Batches are
    to come in that order too; what comes later than the cut-off of its hour is refused.
    """
    keys = ", ".join(f"`{k}` string" for k in by)
    span = F.floor(F.col("hour_s") / (span_h * HOUR)).alias("_span")
    none = lambda kind: F.lit(None).cast(kind)
    parts = parts.withColumns({k: F.col(k).cast("string") for k in by})
    rows = parts.select(*by, span, "hour_s", F.col("delay_h"), F.array(*_VALUES).alias("now"), none("array<double>").alias("published"), none("long").alias("dropped"), none("boolean").alias("open"), none("boolean").alias("waiting"), none("long").alias("floor_s"))
    if state is not None:
        rows = rows.unionByName(state.select(*by, span, "hour_s", none("long").alias("delay_h"), "now", "published", "dropped", "open", "waiting", "floor_s"))

    names = [*by, *[x.split()[0] for x in STATE.split(", ")]]
    shape = pa.schema([(n, t) for n, t in zip(names, [*[pa.string()] * len(by), pa.int64(), *[pa.list_(pa.float64())] * 2, pa.int64(), pa.bool_(), pa.bool_(), pa.int64()])])
    tupled = lambda x: x if x is None else tuple(x)

    def run(batches):
        key, tree, news, out = None, None, [], []
        for batch in batches:
            cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
            heads = zip(*[cols[c] for c in (*by, "_span")])
            for k, hour, delay, now, *rest in zip(heads, *[cols[c] for c in ("hour_s", "delay_h", "now", "published", "dropped", "open", "waiting", "floor_s")]):
                if k != key:
                    if tree is not None:
                        tree.take(news)
                        out += [(*key[:-1], *r) for r in tree.rows()]
                    key, tree, news = k, Span(grace, cutoff), []
                if delay is None:
                    published, dropped, open_, waiting, floor = rest
                    tree.restore(hour, tupled(published), tupled(now), dropped, open_, waiting, floor)
                else:
                    news.append((hour, delay, tuple(now)))
            if len(out) > 10_000:
                yield _rows(out, shape)
                out = []
        if tree is not None:
            tree.take(news)
            out += [(*key[:-1], *r) for r in tree.rows()]
        if out:
            yield _rows(out, shape)

    laid = rows.repartition(*by, "_span").sortWithinPartitions(*by, "_span", "hour_s")
    return laid.mapInArrow(run, f"{keys}, {STATE}")


def _rows(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)


def corrected_hours(messages: DataFrame, by=KEYS, grace: int = GRACE_H, cutoff: int = CUTOFF_H, span_h: int = SPAN_H) -> DataFrame:
    """For each source and hour of event time: what was published `grace` hours after the hour's end (``published``), what the tree holds when messages
    received up to `cutoff` hours after its end are counted (``now``), and ``dropped``, the number of messages that the tree refused.

    `messages`: `by`, event_ts, received_at and, where they are to be summed, state, bed_c, nozzle_c, chamber_c, one row per message. Rows with a null event_ts are
    left out; a null receipt counts as in time; null devices form one group. An hour with nothing in time has no published partial; one with nothing but dropped
    messages has no partial at all. Other columns are left out; no rows give none.
    """
    return advance(None, partials(messages.where("event_ts is not null"), by), by, grace, cutoff, span_h)


def corrected(state: DataFrame) -> Column:
    """Whether the tree's partial of an hour is no longer the one published."""
    return F.col("now").isNotNull() & (F.col("published").isNull() | (F.col("now")[0] != F.col("published")[0]))


def figures(partial: str, prefix: str = "") -> list[Column]:
    """The figures of a partial as columns."""
    v = lambda name: F.col(partial)[_VALUES.index(name)]
    whole = {"samples": "n", "printing_samples": "printing", "idle_samples": "idle"}
    avg = lambda x: F.try_divide(v(f"{x}_sum"), v(f"{x}_n"))
    return [*[v(c).cast("long").alias(prefix + n) for n, c in whole.items()], avg("bed").alias(prefix + "avg_bed_c"), avg("nozzle").alias(prefix + "avg_nozzle_c"), v("nozzle_max").alias(prefix + "max_nozzle_c"), avg("chamber").alias(prefix + "avg_chamber_c")]


def stale_hours(messages: DataFrame, grace: int = GRACE_H, cutoff: int = CUTOFF_H) -> DataFrame:
    """(device_id, hour_s, outcome): 'corrected' and 'dropped' hours, by the partials of the trees."""
    found = corrected_hours(messages, KEYS, grace, cutoff)
    kinds = F.array_compact(F.array(F.when(corrected(found), "corrected"), F.when(F.col("dropped") > 0, "dropped")))
    return found.select("device_id", "hour_s", F.explode(kinds).alias("outcome"))


def correct_table(published: DataFrame, messages: DataFrame, by=("device_id", "source", "model", "firmware")) -> DataFrame:
    """`published` (agg_status_hourly: `by`, hour_ts and figures) brought up to date: (`by`, hour_s, figures as they stand, published_samples, late, dropped, change).

    change: 'kept' (the table's count stands), 'corrected', 'added' (an hour the table doesn't have), 'unknown' (an hour of the table without messages at hand, which
    keeps its figures). Nulls in `by` equal each other.
    """
    names = ["samples", "printing_samples", "idle_samples", "avg_bed_c", "avg_nozzle_c", "max_nozzle_c", "avg_chamber_c"]
    hours = corrected_hours(messages, by)
    new = hours.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("hour_s").alias("_hour"), *[c.alias(f"_{n}") for c, n in zip(figures("now"), names)], F.coalesce(F.col("published")[0].cast("long"), F.lit(0)).alias("_before"), "dropped")
    old = published.select(*by, F.floor(F.unix_micros("hour_ts") / 1_000_000).cast("long").alias("hour_s"), *names)
    same = F.col("hour_s") == F.col("_hour")
    for k in by:
        same = same & old[k].eqNullSafe(new[f"_{k}"])
    both = old.join(new, same, "full_outer")
    change = F.when(F.col("_hour").isNull(), "unknown").when(F.col("hour_s").isNull(), "added").when(F.col("samples") == F.col("_samples"), "kept").otherwise("corrected")
    here = F.col("_hour").isNotNull()
    return both.where(F.col("_hour").isNull() | F.col("_samples").isNotNull() | F.col("hour_s").isNotNull()).select(
        *[F.when(here, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in by], F.coalesce("hour_s", "_hour").alias("hour_s"), *[F.when(F.col("_samples").isNotNull(), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names],
        F.col("samples").alias("published_samples"), (F.col("_samples") - F.col("_before")).alias("late"), F.coalesce("dropped", F.lit(0)).alias("dropped"), change.alias("change"),
    )
