"""Every query runs on the smallest tables, has rows where it should and agrees with its SQL."""

import os

import pytest

import __spark_entry__ as entry

D = os.environ.get("LAYERLOG_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def canon(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or v != v else repr(round(float(v), 5)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith(("p8", "p9", "p10"))))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    got = entry.queries()[name](spark, D).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


@pytest.mark.parametrize("name, columns", [("p1_found", ["dedupe_key", "field"]), ("p3_found", ["path", "line_number", "reason"]), ("p6_found", ["path", "line_number", "event_us"]), ("p7_found", ["path", "change", "old_field", "new_field"])])
def test_found(spark, name, columns):
    df = entry.queries()[name](spark, D)
    assert df.columns == columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
