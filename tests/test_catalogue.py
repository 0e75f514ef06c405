import math

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from brasswell.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


def plain(rows):
    def told(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted(([told(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())
