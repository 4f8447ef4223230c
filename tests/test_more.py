from __future__ import annotations

import duckdb
import pytest

from lexigrid.plans import more

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(more.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.sql(more.ORACLE_SQL[name])
    found = more.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    a = order(tuple(r[c] for c in columns) for r in found.collect())
    b = order(want.select(*columns).fetchall())
    assert len(a) > 0 and len(a) == len(b)
    assert sum(x != y for x, y in zip(a, b)) == 0, [(x, y) for x, y in zip(a, b) if x != y][:3]
