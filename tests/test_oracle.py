"""Every named query against its SQL, on whole tables."""

import os

import pytest

from quadrat.plans.oracle import ORACLE
from quadrat.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows):
    return sorted((tuple("null" if v is None else "nan" if v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, views, name):
    df = QUERIES[name](spark, SF)
    found = views.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    assert normal(df.select(*[f"`{c}`" for c in order]).collect()) == normal(views.sql("SELECT " + ", ".join(f'"{c}"' for c in order) + f" FROM ({ORACLE[name]})").fetchall())
