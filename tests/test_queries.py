"""Every registered query of the spatial operators against its SQL, and the others for rows."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from terraloom.plans import queries_applications, queries_models, queries_more, queries_network, queries_sources, queries_space, queries_stats  # noqa: F401
from terraloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.7g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = db.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
