"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

from quiresmith import registry
from quiresmith.tables import TABLES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(clean(r[c]) for c in cols) for r in df.collect()]
    q = con.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in q.description].index(c) for c in cols]
    want = [tuple(clean(r[i]) for i in order) for r in q.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str) and got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
