"""Reading written times of many notations as instants, in epoch microseconds, on the JVM and whatever the session's time zone."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000
DAY = 86_400 * US

# Usual abbreviations of zones and their offsets in minutes. Those that several zones share stand for the one named first.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AST": -240, "ADT": -180,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


#: (pattern of a date at the start, its replacement by year-month-day); a month may stay a name
_DATES = (
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[Tt, ]+", "$3-$2-$1 "),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})[Tt, ]+", "$3-$1-$2 "),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[- ]([A-Za-z]{3})[a-z]*\.?[- ](\d{4}),?\s+", "$3-$2-$1 "),
    (r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3 $4:$5:$6"),
)
#: year, month, day, hour, minute, second, fraction, half of the day, zone
_PARTS = r"^(\d{4})[-/](\d{1,2}|[A-Za-z]{3})[-/](\d{1,2})(?:[Tt]|\s+)(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,9}))?\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?\s*(.*)$"
_NUMBER = r"^[+-]?\d{9,13}(\.\d+)?$|^\d{15,19}$|^\d(\.\d+)?[eE]\+?\d+$"


def zones() -> frozenset[str]:
    """Names of the tz database; at most a few hundred."""
    return frozenset(zoneinfo.available_timezones())


def number_us(raw: Column) -> Column:
    """A plain number as an instant: seconds, milliseconds, microseconds or nanoseconds by its magnitude (1973 to 5138); null otherwise."""
    x = raw.try_cast("decimal(38,9)")
    a = F.abs(x)
    us = F.when(a < 100_000_000, None).when(a < 10**11, x * US).when(a < 10**14, x * 1000).when(a < 10**17, x).otherwise(F.floor(x / 1000))
    return F.floor(us).cast("long")


def with_written(df: DataFrame, raw: str, us: str = "_us", zone: str = "_zone") -> DataFrame:
    """Adds the written time of any notation: `us`, microseconds on the clock it was written by (null if unreadable), and `zone`: 'number' for
    epoch numbers, '' where no zone is written, else the zone as written. Null, empty or unreadable text gives nulls.

    Done in steps of columns, each used by name, so that no step is evaluated twice.
    """
    text = F.trim(F.col(raw))
    for pattern, to in _DATES:
        text = F.regexp_replace(text, pattern, to)
    out = df.withColumn("_n", F.when(F.trim(F.col(raw)).rlike(_NUMBER), number_us(F.trim(F.col(raw))))).withColumn("_t", F.when(F.col("_n").isNull(), text))
    out = out.withColumn("_p", F.when(F.col("_t").rlike(_PARTS), F.split(F.regexp_replace("_t", _PARTS, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", 9)))
    p = lambda i: F.col("_p")[i]
    month = F.when(p(1).rlike("^[0-9]"), F.lpad(p(1), 2, "0")).otherwise(F.lpad(((F.instr(F.lit(MONTHS), F.lower(p(1))) + 2) / 3).cast("int").cast("string"), 2, "0"))
    hour = p(3).cast("int")
    hour = F.when(p(7) == "", hour).otherwise(hour % 12 + F.when(F.lower(F.substring(p(7), 1, 1)) == "p", 12).otherwise(0))
    out = out.withColumn("_d", F.concat_ws("-", p(0), month, F.lpad(p(2), 2, "0")).try_cast("date")).withColumn("_h", hour)
    clock = F.col("_h").cast("long") * 3600 + p(4).cast("long") * 60 + F.when(p(5) == "", 0).otherwise(F.try_to_number(F.rpad(p(5), 2, "0"), F.lit("99"))).cast("long")
    good = (F.col("_h") < 24) & (p(4).cast("int") < 60)
    local = F.when(good, F.unix_date("_d").cast("long") * DAY + clock * US + F.rpad(F.substring(p(6), 1, 6), 6, "0").cast("long"))
    named = F.when(F.col("_n").isNotNull(), "number").when(local.isNotNull(), F.regexp_replace(p(8), r"^\[|\]$", ""))
    return fixed(out, **{us: F.coalesce("_n", local), zone: named}).drop("_n", "_t", "_p", "_d", "_h")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns through a generator of one row. Filters on such columns aren't pushed below it, which would evaluate the columns' long
    expressions once more inside every filter."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def in_zone(us: Column, zone: Column, known: bool = False) -> Column:
    """Wall microseconds in a named zone as an instant; a wall time that occurs twice means the first, unknown zones give null. `known`: zones were held against the list before."""
    if known:
        return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))
    known = F.expr("array(" + ", ".join(f"'{z}'" for z in sorted(zones())) + ")")  # folded to a constant
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.when(F.array_contains(known, zone), zone)))


def offset_us(zone: Column) -> Column:
    """Microseconds of a written offset or abbreviation, which are exact; null for names of zones and for no zone."""
    table = F.expr("map(" + ", ".join(f"'{z}', {m}" for z, m in ABBREVIATIONS.items()) + ")")
    iso = r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract(zone, iso, 1) == "-", -1).otherwise(1)
    minutes = F.regexp_extract(zone, iso, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(zone, iso, 3).try_cast("int"), F.lit(0))
    return F.when(zone == "number", F.lit(0)).when(zone.rlike(iso), sign * minutes).when(zone.rlike("^[A-Za-z]+$"), F.try_element_at(table, F.upper(zone))).cast("long") * 60 * US


def explicit(us: Column, zone: Column) -> Column:
    """The instant of a written time that names its own zone or offset; null where that is missing or unknown."""
    return F.when(zone != "", F.coalesce(us - offset_us(zone), F.when(zone.rlike("^[A-Z][A-Za-z]+(/|$)"), in_zone(us, zone))))
