"""Temperatures recorded in several units, with labels that may be missing, odd or wrong: the true unit and the value in °C.

A label is segmented into prefix, root, factor and exponent (:mod:`layerlog.functions.unitlabels`); its readings, weighed by the prior that a temperature field
holds temperatures, are the prior of the row's unit.  Each row then gives every unit a score: that prior, and how well set points and readings, taken in
that unit, agree with what printers do (set points are whole degrees Celsius in the range of the heater, or zero at rest; readings lie near them).  As all
rows of a job share a unit, scores are added over the job, combined before the shuffle, and the unit with the most wins.  Rows without a job stand for
themselves.  So labels decide where the values of a job leave several units open, and many values outweigh a wrong label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import shielded
from ..functions.unitlabels import readings

#: name -> (slope, intercept) to °C
UNITS = {"C": (1.0, 0.0), "F": (5.0 / 9.0, -32.0 * 5.0 / 9.0), "K": (1.0, -273.15), "dC": (0.1, 0.0)}
#: plausible °C: set points when heating, readings at rest, readings while heating
NOZZLE = {"set": (100.0, 330.0), "rest": (5.0, 70.0), "hot": (15.0, 350.0)}
BED = {"set": (25.0, 130.0), "rest": (5.0, 60.0), "hot": (10.0, 140.0)}
SET_WEIGHT, READING_WEIGHT, LABEL_WEIGHT = 6.0, 2.0, 1.0
ROUNDING = 0.06


_LABELS = {("C", 0, 1): "C", ("F", 0, 1): "F", ("K", 0, 1): "K", ("C", -1, 1): "dC"}


def label_prior(label: str | None) -> dict[str, float]:
    """{unit: weight} that the readings of a label give; what is no temperature unit of UNITS bears no witness."""
    out: dict[str, float] = {}
    for (dimension, *unit), weight in readings(label):
        if dimension == "temperature" and tuple(unit) in _LABELS:
            out[_LABELS[tuple(unit)]] = weight
    return out


def _evidence(unit: str, target: np.ndarray, reading: np.ndarray, ranges: dict) -> np.ndarray:
    """How well set points and readings fit °C ranges if taken in `unit`; a missing value weighs nothing."""
    a, b = UNITS[unit]
    t, r = target * a + b, reading * a + b
    within = lambda x, k: (x >= ranges[k][0]) & (x <= ranges[k][1])
    known = ~np.isnan(t)
    zero = np.abs(t) < ROUNDING
    whole = np.abs(t - np.round(t)) < ROUNDING
    out = np.where(known, np.where(zero | (whole & within(t, "set")), SET_WEIGHT, -SET_WEIGHT), 0.0)
    calm, hot = within(r, "rest"), within(r, "hot")
    fits = np.where(zero, calm, np.where(known, hot & (r < t + 40), calm | hot))  # without a set point a reading must do for rest or heat
    return out + np.where(np.isnan(r), 0.0, np.where(fits, READING_WEIGHT, -READING_WEIGHT))


_EVIDENCE = T.StructType([T.StructField("label_unit", T.StringType()), *[T.StructField(u, T.DoubleType()) for u in UNITS]])


@F.pandas_udf(_EVIDENCE)
def unit_evidence(label: pd.Series, t_nozzle: pd.Series, nozzle: pd.Series, t_bed: pd.Series, bed: pd.Series) -> pd.DataFrame:
    """What the label names, and each unit's score; each distinct label is segmented once a batch."""
    priors = {x: label_prior(x) for x in label.dropna().unique()}
    named = label.map({x: max(p, key=p.get) for x, p in priors.items() if p}).astype(object)
    named = named.where(named.notna(), None)
    tn, n, tb, b = (x.to_numpy(dtype=float, na_value=np.nan) for x in (t_nozzle, nozzle, t_bed, bed))
    with np.errstate(invalid="ignore"):
        scores = {u: _evidence(u, tn, n, NOZZLE) + _evidence(u, tb, b, BED) + LABEL_WEIGHT * label.map({x: p.get(u, 0.0) for x, p in priors.items()}).astype(float).fillna(0.0).to_numpy() for u in UNITS}
    return pd.DataFrame({"label_unit": named, **scores})


def to_celsius(x: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, (a, b) in UNITS.items():
        out = F.when(unit == u, x if u == "C" else ((x - 32) / F.lit(1.8) if u == "F" else x * a + b)).otherwise(out)
    return out


@shielded
def status_units(events: DataFrame) -> DataFrame:
    """Status rows with ``unit`` (true unit: C, F, K or dC), ``label_unit`` (what the label says) and bed_c, nozzle_c, target_bed_c, target_nozzle_c.

    Nulls: a missing value bears no witness; a row without any evidence follows its label, else is C (ties go to C, F, K, dC in that order).
    Repeated rows stay. NaN is no evidence. Extra columns pass through; columns with the names above are replaced.
    """
    new = ["unit", "label_unit", "bed_c", "nozzle_c", "target_bed_c", "target_nozzle_c"]
    rows = events.drop(*new).where("kind = 'status'").withColumn("_e", unit_evidence("temp_unit", "target_nozzle_temp", "nozzle_temp", "target_bed_temp", "bed_temp"))
    rows = rows.select("*", "_e.label_unit", *[F.col(f"_e.{u}").alias(f"_{u}") for u in UNITS]).drop("_e")
    best = lambda: _argmax({u: F.col(f"_{u}") for u in UNITS})
    jobs = rows.where("job_id is not null").groupBy("device_id", "job_id").agg(*[F.sum(f"_{u}").alias(f"_{u}") for u in UNITS]).select("device_id", "job_id", best().alias("_job"))
    alone = rows.where("job_id is null").withColumn("_job", F.lit(None).cast("string"))
    done = rows.where("job_id is not null").join(jobs, ["device_id", "job_id"], "left").select(*alone.columns).unionByName(alone)
    done = done.withColumn("unit", F.coalesce("_job", best())).drop("_job", *[f"_{u}" for u in UNITS])
    return done.select(
        "*",
        *[to_celsius(F.col(f"{x}_temp"), F.col("unit")).alias(f"{x}_c") for x in ("bed", "nozzle", "target_bed", "target_nozzle")],
    )


def _argmax(scores: dict) -> Column:
    top = F.greatest(*scores.values())
    out = F.lit("C")
    for u in reversed(list(scores)):
        out = F.when(scores[u] == top, u).otherwise(out)
    return out


def foreign_units(events: DataFrame) -> DataFrame:
    """(path, line_number, unit) of status rows not in °C."""
    need = ["path", "line_number", "device_id", "job_id", "kind", "temp_unit", "bed_temp", "nozzle_temp", "target_bed_temp", "target_nozzle_temp"]
    return status_units(events.select(*need)).where("unit <> 'C'").select("path", "line_number", "unit")
