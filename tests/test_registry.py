import glob
import os

import duckdb
import pandas as pd
import pytest

from effectsmith.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        own.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return own


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("~" if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in row))
    return sorted(out, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    expected = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
