import math

import duckdb
import pytest

from sparkvec.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(found):
    same = lambda v: [same(x) for x in v] if isinstance(v, (list, tuple)) else "inf" if isinstance(v, float) and math.isinf(v) else f"{v + 0.0:.11g}" if isinstance(v, float) else str(v)
    return sorted(str([same(v) for v in r]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(expected)
