"""True instants of device times written in mixed notations and zones.

A time with its own zone or offset is read as it stands; a genA time is the written time plus the upload's clock offset.  For the others the
zone of the device's wall clock is estimated: every zone in use is tried on the device's zone-free times, and a time counts as a violation if
it would lie after its receipt (an event can't be received before it happens; `SLACK_US` is allowed) or more than `DELAY_US` before it.  The
zone with the fewest violations wins; the zone declared for the device is given `PRIOR` as a head start, so it is only overruled by
evidence that no reading of it explains.  Where even the best zone leaves violations, the device may have moved: the history of zones over its days with the
fewest violations is chosen, each change counting as `SWITCH` of them; where no zone is declared, the time between a row and its receipt counts too, as a part of a
violation (a zone too far west lies before the receipt, never after it).  Named zones carry their own history of offsets, so daylight saving needs no case of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shielded
from ..functions.instants import US, explicit, fixed, in_zone, with_written, zones
from ..session import cut, stored

SLACK_US = 300 * US
DELAY_US = 30 * 86_400 * US
#: share of a device's zone-free times by which another zone must do better than the declared one
PRIOR = 0.5
SWITCH = 20  #: violations that a change of zone must save


def _tried(free: DataFrame, devices: DataFrame) -> DataFrame:
    """(device_id, day, zone, bad, delay, off) of each row of `free` in each zone that any device declares; day: of its receipt, off: 1 for a violation, else the delay in days,
    1 at most: how badly the row is aligned with its receipt."""
    used = [r.tz_name for r in devices.select("tz_name").distinct().collect()]  # names of zones, at most those of the tz database
    rows = free.select("device_id", "received_us", "us", F.explode(F.array(*[F.lit(z) for z in sorted(zones() & {*used})]).cast("array<string>")).alias("zone"))
    at = in_zone(F.col("us"), F.col("zone"), known=True)
    bad = (at > F.col("received_us") + SLACK_US) | (at < F.col("received_us") - DELAY_US) | at.isNull()
    rows = rows.select("device_id", _day().alias("day"), "zone", F.coalesce(bad, F.lit(False)).cast("double").alias("bad"), F.abs(F.col("received_us") - at).alias("delay"))
    return rows.withColumn("off", F.when(F.col("bad") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("delay") / (86_400 * US), F.lit(0.0)))))


def _day():
    return F.floor(F.coalesce("received_us", "us") / (86_400 * US)).cast("long")


def _histories(batches):
    """(device_id, day, zone): the cheapest sequence of zones over a device's days. Rows come by device and day."""

    def best(days: list[tuple]) -> list[tuple]:
        # (violations less head start and with the price of changes, delay) is least; ties go to the first zone by name
        paths: dict = {}
        for day, costs in days:
            if not paths:
                paths = {z: (c, [(day, z)]) for z, c in costs.items()}
                continue
            change = min(((c[0] + SWITCH, c[1]), z) for z, (c, _) in paths.items())
            nxt = {}
            for z, (v, delay) in costs.items():
                stay = (paths[z][0], z) if z in paths else change
                before, come = min(stay, change)
                nxt[z] = ((before[0] + v, before[1] + delay), [*paths[come][1], (day, z)])
            paths = nxt
        return min((c, z, p) for z, (c, p) in paths.items())[2]

    held, device, days = [], None, []
    for pdf in batches:
        for d, day, zone, cost, delay in zip(pdf["device_id"].where(pdf["device_id"].notna(), None), pdf["day"], pdf["zone"], pdf["cost"], pdf["delay"].fillna(0.0)):
            if days and d != device:
                held += [(device, *x) for x in best(days)]
                days = []
            device = d
            if not days or days[-1][0] != day:
                days.append((day, {}))
            days[-1][1][zone] = (cost, delay)
        yield pd.DataFrame(held, columns=["device_id", "day", "zone"])
        held = []
    if days:
        yield pd.DataFrame([(device, *x) for x in best(days)], columns=["device_id", "day", "zone"])


def estimate_zones(free: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((device_id, zone), (device_id, day, zone)) for the devices in `free` (device_id, us: wall microseconds, received_us): the one zone of each device, and the
    zones by day of receipt of those devices whose one zone leaves more than SWITCH violations (of a device that declares none: misalignment with receipts).
    `devices`: device_id, tz_name.

    Candidates are the zones that any device declares, at most the few hundred of the tz database, whatever the number of rows; counting is
    combined before the shuffle. One zone: fewest violations, the declared zone's head start counted, then the least mean delay, then the first by name. A history of
    zones costs its violations and SWITCH for each change, so that a device with few violations has none. Null receipts violate nothing. No candidates: no rows.
    """
    tried = _tried(free, devices)
    declared = devices.groupBy("device_id").agg(F.min("tz_name").alias("tz_name"))
    lead = F.when(F.col("zone") == F.col("tz_name"), PRIOR).otherwise(0.0)
    score = tried.groupBy("device_id", "zone").agg(F.avg("bad").alias("bad"), F.avg("delay").alias("delay"), F.sum("off").alias("off"), F.count(F.lit(1)).alias("n"))
    ranked = score.join(declared, "device_id", "left").withColumn("cost", F.col("bad") - lead)
    one = ranked.groupBy("device_id").agg(F.min_by(F.struct("zone", F.when(F.col("tz_name").isNull(), F.col("off")).otherwise(F.col("bad") * F.col("n")).alias("wrong")), F.struct("cost", F.coalesce("delay", F.lit(0.0)), "zone")).alias("_z"))
    one = cut(one.select("device_id", "_z.zone", "_z.wrong"))  # a row a device
    doubtful = one.where(F.col("wrong") > SWITCH).select("device_id")
    daily = tried.join(doubtful, "device_id", "left_semi").groupBy("device_id", "day", "zone").agg(F.sum("bad").alias("bad"), F.sum("off").alias("off"), F.sum("delay").alias("delay"), F.count(F.lit(1)).alias("n"))
    cost = F.when(F.col("tz_name").isNull(), F.col("off")).otherwise(F.col("bad") - lead * F.col("n"))
    daily = daily.join(declared, "device_id", "left").select("device_id", "day", "zone", cost.alias("cost"), F.col("delay").cast("double").alias("delay"))
    by_day = daily.repartition("device_id").sortWithinPartitions("device_id", "day", "zone").mapInPandas(_histories, "device_id string, day long, zone string")
    return one.select("device_id", "zone"), by_day


@shielded
def true_instants(events: DataFrame, devices: DataFrame) -> DataFrame:
    """`events` with ``event_us``, the instant that device_ts_raw denotes (null if it is unreadable), and ``time_basis``: 'offset' (genA, by
    the clock offset), 'written' (its own zone), 'estimated' (zone of the device).

    Only zone-free rows meet the devices' zones in a join; all others are read where they lie. Nulls: no raw time, no instant. Repeated rows
    stay. Columns named event_us or time_basis are replaced.
    """
    rows = with_written(events.drop("event_us", "time_basis"), "device_ts_raw")
    shifted = F.coalesce((F.col("source") == "genA") & (F.col("_zone") == "") & F.col("clock_offset_seconds").isNotNull(), F.lit(False))
    own = F.when(shifted, F.col("_us") + F.round(F.col("clock_offset_seconds") * US).cast("long")).otherwise(explicit(F.col("_us"), F.col("_zone")))
    rows = fixed(rows, event_us=own, _shifted=shifted).withColumn("time_basis", F.when(F.col("_shifted"), "offset").when(F.col("event_us").isNotNull(), "written")).drop("_shifted")
    open_ = F.coalesce(F.col("event_us").isNull() & (F.col("_zone") == ""), F.lit(False))
    done = rows.where(~open_).drop("_us", "_zone")
    free = stored(rows.where(open_))  # few rows, read three times below
    us, received = F.col("_us").alias("us"), F.unix_micros("received_at").alias("received_us")
    one, by_day = estimate_zones(free.select("device_id", us, received), devices)
    day = F.floor(F.coalesce(F.unix_micros("received_at"), F.col("_us")) / (86_400 * US)).cast("long")
    placed = free.drop("event_us").withColumn("_day", day).join(one.withColumnRenamed("zone", "_one"), "device_id", "left")
    placed = placed.join(by_day.select("device_id", F.col("day").alias("_day"), F.col("zone").alias("_then")), ["device_id", "_day"], "left")
    found = fixed(placed, event_us=in_zone(F.col("_us"), F.coalesce("_then", "_one"), known=True))
    found = found.withColumn("time_basis", F.when(F.col("event_us").isNotNull(), "estimated")).select(*done.columns)
    return done.unionByName(found)


def misdated(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows whose stored event_ts is null or isn't the true instant, with event_us. Rows without a readable time are left out."""
    need = ["path", "line_number", "source", "device_id", "device_ts_raw", "received_at", "event_ts", "clock_offset_seconds"]
    t = true_instants(events.select(*need), devices)
    return t.where(F.col("event_us").isNotNull() & (F.col("event_ts").isNull() | (F.unix_micros("event_ts") != F.col("event_us")))).select("path", "line_number", "event_us")
