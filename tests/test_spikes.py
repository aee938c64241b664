import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from layerlog.operators import spikes

SCHEMA = "dedupe_key string, device_id string, kind string, event_ts timestamp, state string, job_id string, bed_c double, nozzle_c double, target_bed_c double, target_nozzle_c double, source string"


def fleet(seed=1, devices=12, jobs=6):
    """Devices with their own bias and scatter; jobs warm up, hold, and rest. Returns rows and the planted (key, field)."""
    rnd, rows, planted = random.Random(seed), [], set()
    for d in range(devices):
        sd, bias, at = rnd.choice([0.1, 0.5, 1.5]), rnd.gauss(0, 1), dt.datetime(2025, 10, 6)
        for j in range(jobs if d else jobs * 6):
            temps = rnd.choice([(60.0, 210.0), (90.0, 250.0)])
            warm, flat = [25.0, 25.0], None
            for k in range(45):
                at += dt.timedelta(seconds=90)
                hot = k >= 4
                goal = [t + bias if hot else 25.0 for t in temps]
                warm = [w + (g - w) * 0.5 for w, g in zip(warm, goal)] if k < 14 else goal
                v = [round(w + rnd.gauss(0, sd), 2) for w in warm]
                key = f"{d}-{j}-{k}"
                if k == 30 and rnd.random() < 0.5:
                    v[1] = round(goal[1] + rnd.choice([-1, 1]) * 16 * sd, 2)
                    planted.add((key, "nozzle_c"))
                if k == 20 and rnd.random() < 0.2:
                    v[0] = rnd.choice([-127.0, 2047.0])
                    planted.add((key, "bed_c"))
                if 33 <= k < 41 and d % 3 == 0:
                    flat = v[0] if flat is None else flat
                    v[0] = flat
                    planted.add((key, "bed_c"))
                elif k >= 41 and flat is not None:
                    flat = v[0] if v[0] == flat else None  # by chance it goes on
                    planted |= {(key, "bed_c")} if flat is not None else set()
                if rnd.random() < 0.01:
                    v[1] = None
                    planted.discard((key, "nozzle_c"))
                rows.append((key, f"d{d}", "status", at, "PRINTING" if hot else "IDLE", f"j{j}" if hot else None, *v, *(temps if hot else (0.0, 0.0)), "genB"))
            at += dt.timedelta(hours=3)
    rows.append(("odd", "d1", "job_end", dt.datetime(2025, 10, 6), None, None, None, None, None, None, "genB"))
    return rows, planted


def test_planted_readings_and_blocks(spark):
    rows, planted = fleet()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in spikes.implausible(df).collect()}
    assert got == planted
    cut = {(r.dedupe_key, r.field) for r in spikes.score_readings(df, block_rows=300, only_found=True).collect()}
    assert cut == planted
    # one forest a device: blocks give the readings of a device the scores of one and the same forest
    few, many = ({(r.dedupe_key, r.field): r.score for r in spikes.score_readings(df.where("device_id = 'd0'"), block_rows=k).collect()} for k in (700, 300))
    assert few.keys() == many.keys() and sum(abs(few[k] - many[k]) > 1e-9 for k in few) < 0.02 * len(few)
    scored = spikes.score_readings(df)
    assert scored.count() == sum((r[6] is not None) + (r[7] is not None) for r in rows)
    high = scored.groupBy(F.col("reason") == "spike").agg(F.avg("score").alias("s")).orderBy(F.col("(reason = spike)")).collect()
    assert high[1].s > high[0].s + 0.2
    # the score by itself finds every spike and leaves out most other readings; without it nothing would be found
    assert scored.where("reason = 'spike'").agg(F.min("score")).first()[0] >= spikes.ANOMALOUS
    assert scored.agg(F.avg((F.col("score") >= spikes.ANOMALOUS).cast("int"))).first()[0] < 0.25


def test_score_decides(spark, monkeypatch):
    import pandas as pd

    rows, _ = fleet(devices=2)
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).query("kind == 'status'").sort_values(["device_id", "event_ts"]).reset_index(drop=True)
    g = pdf["device_id"].eq("d1").to_numpy().astype(int)
    lay = spikes.Layout(pdf, g, "nozzle_c")
    st = spikes._settle(spikes.own_stats(lay, 2))
    assert (lay.score(st, np.arange(2))["reason"] == "spike").any()
    monkeypatch.setattr(spikes, "forest_scores", lambda x, *a: np.zeros(len(x)))
    assert not (lay.score(st, np.arange(2))["reason"] == "spike").any()


def test_edges(spark):
    none = (None,) * 4
    rows = [("a", None, "status", None, None, None, *none, None)] * 2 + [("b", "x", "status", dt.datetime(2025, 1, 1), "IDLE", None, float("nan"), 9999.0, None, None, "s"), ("c", "x", "status", dt.datetime(2025, 1, 1), "PRINTING", "j", 60.0, float("inf"), 60.0, 210.0, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in spikes.implausible(df).collect()} == {("b", "nozzle_c"), ("c", "nozzle_c")}
    assert spikes.implausible(df.limit(0)).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x, group = [], []
    for g in range(5):
        a = rng.normal(size=(200, 3))
        a[:3] += 12
        x.append(a)
        group += [g] * 200
    score = spikes.forest_scores(np.vstack(x), np.array(group), np.arange(5), trees=25)
    for g in range(5):
        s = score[g * 200 : g * 200 + 200]
        assert s[:3].min() > np.quantile(s[3:], 0.97)
    assert len(spikes.forest_scores(np.zeros((0, 3)), np.zeros(0, int), np.zeros(0, int))) == 0
