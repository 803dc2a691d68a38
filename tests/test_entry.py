"""The driver's contract: every query runs at the smallest scale and equals its DuckDB form."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = ("op", "pipeline")


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(repr([f"{v:.9g}" if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(LLM)])
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
