import os

import pytest

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["evaluate", "normalize_invoice_no", "candidate_pairs", "latest_decisions", "threshold_curve", "p1_found"])
def test_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("invoices", "invoice_pairs", "review_decisions"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = entry.queries()[name](spark, d)
    got, want = [tuple(r) for r in df.select(*sorted(df.columns)).collect()], con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in sorted(df.columns)]

    def plain(row):
        return tuple(str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row)

    assert sorted(map(plain, got)) == sorted(plain([r[i] for i in order]) for r in want.fetchall())
