"""Each query of the traffic library against its SQL in another engine, on the same files."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from roadweave import queries as Q

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = Q.load()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    ours = sorted(([plain(x) for x in r] for r in df.select(cols).collect()), key=str)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(([plain(x) for x in r] for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", ["throttled_emission", "hash_uniform", "leisure_preferences", "population", "trip_generation"])
def test_others_run_and_repeat(spark, name):
    a = sorted(map(tuple, QUERIES[name](spark, str(SF)).collect()))
    assert a and a == sorted(map(tuple, QUERIES[name](spark, str(SF)).collect()))
