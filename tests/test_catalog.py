"""Every query of the catalogue against its SQL, on the smallest of the sample tables."""

from pathlib import Path

import duckdb
import pytest

from strandloom import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the sample tables aren't here")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    cursor = tables.execute(catalog.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=repr)
    assert rows == want


def test_scratch_folder_is_the_sessions(spark):
    from strandloom.core import scratch_dir

    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
