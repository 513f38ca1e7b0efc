"""Every query against its SQL, and every query for its rows."""

import os

import duckdb
import pytest

from bandloom.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        if isinstance(x, float):
            return ("f", round(x, 6) + 0.0)
        return repr(x)

    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = canon(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLES:
        cur = duck.execute(catalogue.ORACLES[name])
        want = canon([d[0] for d in cur.description], cur.fetchall())
        assert found[0] == want[0]
        assert len(found[1]) == len(want[1])
        for a, b in zip(found[1], want[1], strict=True):
            assert a == b
    else:
        assert found[1]
