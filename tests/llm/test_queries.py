"""The opN_ queries as registered, on the smallest data: against their SQL where they have one."""

import math

import duckdb
import pytest

from brookmill.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(plain(v) for v in r) for r in con.sql(f"SELECT {quoted} FROM ({queries.oracle_sql()[name]})").fetchall()), key=repr)
    assert len(got) > 0 and got == want
