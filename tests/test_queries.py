import math
import os

import pytest

from episodelens.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    cursor = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(repr, r))
    rows = lambda rs: sorted((tuple(plain(v) for v in r) for r in rs), key=key)
    assert rows(got.select(*(f"`{n}`" for n in names)).collect()) == rows(cursor.fetchall())
