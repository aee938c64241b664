import random
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from layerlog.operators import delivery

SCHEMA = "path string, line_number long, device_id string, dedupe_key string, kind string, device_ts_raw string, job_id string, state string, received_at timestamp, extra string"


def brute(rows):
    """Ids by definition, then everything but the first of each group."""
    keyed = {}
    for r in rows:
        if r["dedupe_key"] is not None:
            t = (r["device_id"], r["kind"], r["device_ts_raw"], r["job_id"], r["state"])
            keyed.setdefault(t, set()).add((r["device_id"], r["dedupe_key"].lower()))
    groups = {}
    for r in rows:
        t = (r["device_id"], r["kind"], r["device_ts_raw"], r["job_id"], r["state"])
        mid = (r["device_id"], r["dedupe_key"].lower()) if r["dedupe_key"] is not None else min(keyed[t]) if t in keyed and len(keyed[t]) == 1 else ("natural", t)
        groups.setdefault(mid, []).append(r)
    gone = []
    for g in groups.values():
        g.sort(key=lambda r: (r["received_at"] is not None, r["received_at"], r["path"], r["line_number"]))
        gone += g[1:]
    return sorted((r["path"], r["line_number"]) for r in gone)


def rows_of(seed, n=200):
    import datetime as dt

    rnd = random.Random(seed)
    out = []
    for i in range(n):
        d, m = rnd.choice("ab"), rnd.randrange(40)
        key = f"{m:04x}{'abcd'[m % 4] * 4}"
        out.append({"path": f"p{rnd.randrange(9)}", "line_number": i, "device_id": d, "dedupe_key": rnd.choice([key, key, key.upper(), None]), "kind": "status", "device_ts_raw": str(m), "job_id": None if m % 5 == 0 else "j",
                    "state": "IDLE" if m % 2 else None, "received_at": dt.datetime(2025, 1, 1, rnd.randrange(3)), "extra": "x"})
    return out


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
        got = sorted((r.path, r.line_number) for r in delivery.surplus(df).collect())
        assert got == brute(rows)
        kept = delivery.keep_one(df)
        assert kept.count() == len(rows) - len(got) and kept.columns == df.columns


def test_repeats_and_empty(spark):
    row = rows_of(3)[0]
    df = spark.createDataFrame([tuple(row.values())] * 3, SCHEMA)
    assert delivery.surplus(df).count() == 2 and delivery.keep_one(df).count() == 1
    assert delivery.surplus(df.limit(0)).count() == 0


def test_hot_messages_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(delivery, "HOT", 8)
    same = rows_of(3)[0]
    hot = [{**same, "dedupe_key": k, "line_number": n} for n in range(1000, 1300) for k in ("00aa", None)]
    bare = [{**same, "dedupe_key": None, "job_id": "hot", "line_number": n} for n in range(2000, 2300)]
    rows = [r for r in rows_of(4) if r["device_ts_raw"] != same["device_ts_raw"]] + hot + bare
    again = [{**same, "dedupe_key": "77", "device_ts_raw": "t", "line_number": 5000}] * 300
    df = spark.createDataFrame([tuple(r.values()) for r in rows + again], SCHEMA).repartition(8)
    got = sorted((r.path, r.line_number) for r in delivery.surplus(df).collect())
    assert got == brute(rows + again)
    assert sorted((r.path, r.line_number) for r in delivery.keep_one(df).collect()) == sorted((Counter((r["path"], r["line_number"]) for r in rows + again) - Counter(got)).elements())
    pieces = delivery._ranked(df, df.columns)[0].groupBy("_mid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_s").alias("s"), F.count_distinct("line_number").alias("lines")).where("n >= 300").collect()
    assert len(pieces) == 3 and all(p.s > 4 for p in pieces)  # 600 and 300 copies, and 300 exact repeats


def test_sequences_accept_each_number_once(spark):
    schema = "id string, dev string, received_at long"
    seen = spark.createDataFrame([], delivery.RANGES)
    taken = []
    rnd = random.Random(5)
    for batch in range(3):
        rows = [(f"m-{rnd.randrange(30)}", rnd.choice("xy"), batch * 100 + i) for i in range(40)] + [("zz", "x", 1), (None, "x", 1)]
        told = delivery.told_apart(spark.createDataFrame(rows, schema), "id", "dev", ())
        assert told.where("_seq is null").count() == 2
        fresh, seen = delivery.accept_sequences(told.where("_seq is not null"), seen, ("received_at",), block=8)
        fresh, seen = spark.createDataFrame(fresh.collect(), fresh.schema), spark.createDataFrame(seen.collect(), seen.schema)
        taken += [(r.dev, r.id) for r in fresh.collect()]
    assert len(taken) == len(set(taken))
    covered = {(r._producer.p, n) for r in seen.collect() for n in range(r.lo, r.hi + 1)}
    assert covered == {(d, int(i.split("-")[1])) for d, i in taken}
    spans = sorted((r._producer.p, r.lo, r.hi) for r in seen.collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_padded_numbers_are_sequences_of_their_own(spark):
    df = spark.createDataFrame([("m-7", "d"), ("m-07", "d"), ("m-007", "d"), ("m-0", "d"), ("m-7", "e"), ("M-7", "d")], "id string, dev string")
    told = delivery.told_apart(df, "id", "dev", ()).collect()
    assert len({(r._producer, r._seq) for r in told}) == len({bytes(r._key) for r in told}) == 6


def test_ranges_and_lookup_in_one_plan(spark):
    rows = [{**r, "dedupe_key": f"m-{i % 25}" if i % 3 else r["dedupe_key"] or "zz"} for i, r in enumerate(rows_of(8, 120))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert sorted((r.path, r.line_number) for r in delivery.surplus(df).collect()) == brute(rows)
    seen = spark.createDataFrame([(("a", "m-", 0), 3, 9)], delivery.RANGES)
    kept = sorted((r.path, r.line_number) for r in delivery.keep_one(df, seen=seen).collect())
    gone = sorted((r.path, r.line_number) for r in delivery.surplus(df, seen=seen).collect())
    assert sorted(kept + gone) == sorted((r["path"], r["line_number"]) for r in rows)
    again = {(r["device_id"], r["dedupe_key"]) for r in rows if (r["path"], r["line_number"]) in kept}
    assert not {("a", f"m-{k}") for k in range(3, 10)} & again and ("b", "m-4") in again


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=12))
def test_merge_ranges(spark, spans):
    df = spark.createDataFrame([(("p", "", 0), a, a + w) for a, w in spans], delivery.RANGES)
    got = [(r.lo, r.hi) for r in delivery.merge_ranges(df, block=16).collect()]
    assert {n for a, b in got for n in range(a, b + 1)} == {n for a, w in spans for n in range(a, a + w + 1)}
    assert sum(b - a + 1 for a, b in got) == len({n for a, b in got for n in range(a, b + 1)})


def test_message_ids_match_across_case(spark):
    df = spark.createDataFrame([("p", 1, "a", "AB", "k", "1", None, None, None, ""), ("p", 2, "a", "ab", "k", "2", None, None, None, ""), ("p", 3, "b", "ab", "k", "2", None, None, None, "")], SCHEMA)
    assert delivery.message_id(delivery.told_apart(df).withColumn("_row", F.monotonically_increasing_id())).select(F.count_distinct("_mid")).first()[0] == 2
